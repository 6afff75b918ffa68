"""File sources and sinks.

Every reader passes an explicit schema; nothing is inferred.  Readers return
lazy DataFrames; sinks write with the DataFrame writer.  Keyless text files
(decode lines, prediction lists) get their row key once at ingest.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from turnlens import schemas as SC
from turnlens.functions.columns import clean_ws, escape_pipes, unescape_pipes
from turnlens.operators.ser import both_sides
from turnlens.operators.tokens import index_rows


# ------------------------------------------------------------------ S1 turns

def write_turns(turns: DataFrame, path: str) -> None:
    """Store turns as parquet partitioned by ``split`` (enables partition pruning in S1)."""
    turns.write.mode("overwrite").partitionBy("split").parquet(path)


def scan_turns(src, splits: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Turns of the given splits; ``src`` is a DataFrame or a path written by ``write_turns``."""
    if isinstance(src, str):
        df = spark.read.schema(SC.TURN).parquet(src)
    else:
        df = src
    return df.filter(F.col("split").isin(splits)) if splits else df


# ------------------------------------------------------------------ S2 raw dialogues

def read_dialogues(spark: SparkSession, split_dir: str, multi_line: bool = True) -> DataFrame:
    """Every dialogue JSON file of a split dir; files named ``schema*`` are skipped.

    ``multi_line`` reads JSON list files (one list per file); otherwise JSON lines.
    """
    df = (spark.read.schema(SC.RAW_DIALOGUE).option("multiLine", multi_line).json(split_dir)
          .select("*", F.col("_metadata.file_name").alias("_file")))
    return df.filter(~F.col("_file").startswith("schema")).drop("_file")


def dialogue_turns(dialogues: DataFrame, dialog_ids: DataFrame | None = None) -> DataFrame:
    """Dialogues -> one row per turn ``dialog_id, pos, speaker, utterance, frames``.

    A dialogue filter (few-shot ids) is applied as a left-semi join *before* the
    explode so unwanted dialogues are never expanded.
    """
    return _listed(dialogues, dialog_ids).select(F.col("dialogue_id").alias("dialog_id"), F.posexplode("turns").alias("pos", "t")) \
        .select("dialog_id", "pos", "t.speaker", "t.utterance", "t.frames")


def _listed(dialogues: DataFrame, dialog_ids: DataFrame | None) -> DataFrame:
    if dialog_ids is None:
        return dialogues
    return dialogues.join(dialog_ids.select(F.col("dialog_id").alias("dialogue_id")), "dialogue_id", "left_semi")


def system_turn_rows(turns: DataFrame) -> DataFrame:
    """P3 + W1: SYSTEM turns with their ordinal among the dialogue's system turns (from 0)."""
    w = Window.partitionBy("dialog_id").orderBy("pos")
    return turns.filter(F.col("speaker") == "SYSTEM").withColumn("turn_id", F.row_number().over(w) - 1)


def dialogue_system_turns(dialogues: DataFrame, dialog_ids: DataFrame | None = None) -> DataFrame:
    """P3 + W1 of whole dialogues -> ``dialog_id, turn_id, speaker, utterance, frames`` of every SYSTEM turn.

    A dialogue's turns stand in its record, so they are numbered there: no
    window, and no turn is shuffled.  Each record counts from 0.
    """
    own = F.filter("turns", lambda t: t["speaker"] == "SYSTEM")
    return _listed(dialogues, dialog_ids).select(F.col("dialogue_id").alias("dialog_id"), F.posexplode(own).alias("turn_id", "t")) \
        .select("dialog_id", "turn_id", "t.speaker", "t.utterance", "t.frames")


# ------------------------------------------------------------------ S3 schemas

def read_schemas(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """S3: service schema JSON lists, tagged with ``schema_order`` = position in ``paths``."""
    parts = [spark.read.schema(SC.SERVICE_SCHEMA).option("multiLine", multi_line).json(p)
             .withColumn("schema_order", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flatten_schema(schemas: DataFrame) -> DataFrame:
    """Nested schemas -> ``schema_slots`` (one row per service x slot, with ``slot_pos``)."""
    keep = ["schema_order"] if "schema_order" in schemas.columns else []
    return schemas.select(F.col("service_name").alias("service"), F.col("description").alias("service_desc"),
                          *keep, F.posexplode("slots").alias("slot_pos", "s")) \
        .select("service", "service_desc", *keep, "slot_pos", F.col("s.name").alias("slot"),
                F.col("s.description").alias("slot_desc"), F.col("s.is_categorical").alias("is_categorical"),
                F.coalesce(F.col("s.possible_values"), F.array().cast("array<string>")).alias("possible_values"))


def nest_schema(schema_slots: DataFrame) -> DataFrame:
    """Flat slot rows (``possible_values`` as comma text or array) -> nested service schemas."""
    pv = F.col("possible_values")
    if dict(schema_slots.dtypes)["possible_values"] == "string":
        pv = F.when(pv == "", F.array().cast("array<string>")).otherwise(F.split(pv, ","))
    pos = F.col("slot_pos") if "slot_pos" in schema_slots.columns else F.lit(0)
    return schema_slots.groupBy("service").agg(
        F.first("service_desc").alias("description"),
        F.sort_array(F.collect_list(F.struct(pos.alias("p"), F.col("slot").alias("name"),
                                             F.col("slot_desc").alias("description"),
                                             F.col("is_categorical"), pv.alias("possible_values")))).alias("s")
    ).select(F.col("service").alias("service_name"), "description",
             F.transform("s", lambda x: x.dropFields("p")).alias("slots"))


def union_schemas(parts: list[DataFrame]) -> DataFrame:
    """Concatenate the schemas of several splits.

    Slot descriptions: the last schema (highest ``schema_order``) naming a
    service replaces it whole.  Permissibility: a slot is permissible if *any*
    schema marks it non-categorical.
    """
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    last = u.groupBy("service").agg(F.max("schema_order").alias("schema_order"))
    desc = u.join(last, ["service", "schema_order"], "left_semi")
    perm = u.groupBy("service", "slot").agg(F.bool_or(~F.col("is_categorical")).alias("permissible"))
    return desc.join(perm, ["service", "slot"], "left")


# ------------------------------------------------------------------ S4 templates

def read_templates(spark: SparkSession, template_dir: str, partitioned: bool = False) -> DataFrame:
    """One ``<service>.tsv`` per service: ``act_key \\t template`` (no quoting).

    ``partitioned`` reads a Spark-written ``service=<name>/`` layout instead.
    """
    r = spark.read.option("sep", "\t").option("quote", "").option("header", False)
    if partitioned:
        schema = T.StructType(SC.TEMPLATE_TSV.fields + [T.StructField("service", T.StringType())])
        df = r.schema(schema).csv(template_dir)
        return df.select("service", F.trim("act_key").alias("act_key"), F.trim("template").alias("template"))
    df = r.schema(SC.TEMPLATE_TSV).csv(os.path.join(template_dir, "*.tsv"))
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv$", 1).alias("service"),
                     F.trim("act_key").alias("act_key"), F.trim("template").alias("template"))


def check_templates(templates: DataFrame, strict: bool = True) -> DataFrame:
    """A template must hold as many ``@`` as its key.

    ``strict`` raises on the first inconsistent row (when the plan runs);
    otherwise a ``consistent`` flag column is added (quarantine mode).
    """
    from turnlens.functions.columns import placeholder_count
    ok = placeholder_count("act_key") == placeholder_count("template")
    if strict:
        return templates.withColumn("consistent", F.when(ok, F.lit(True)).otherwise(F.raise_error(
            F.concat(F.lit("placeholders of key "), F.col("act_key"),
                     F.lit(" and template differ: "), F.col("template")))))
    return templates.withColumn("consistent", ok)


# ------------------------------------------------------------------ S5-S8 task TSV

def _read_tsv(spark: SparkSession, path: str) -> DataFrame:
    try:
        return (spark.read.schema(SC.TASK_TSV).option("sep", "\t").option("header", False)
                .option("escape", '"').csv(path))
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def read_task_tsv(spark: SparkSession, root: str, file_name: str) -> dict[str, DataFrame]:
    """``train/dev/test`` task TSVs (5 named columns); all three must exist."""
    paths = {s: os.path.join(root, s, file_name) for s in ("train", "dev", "test")}
    return {s: _read_tsv(spark, p) for s, p in paths.items()}


def task_path(root: str, version: str, kshot: str, split: str) -> str:
    """File pattern of a task; dev/test always use the ``_all`` file."""
    if version not in SC.TASK_VERSIONS or kshot not in SC.TASK_SHOTS:
        raise ValueError(f"unknown task {version}_{kshot}")
    size = kshot if split == "train" else "all"
    return os.path.join(root, split, f"{version}_{size}.tsv")


def read_task(spark: SparkSession, root: str, version: str, kshot: str, split: str) -> DataFrame:
    """Read one split of task ``{version}_{kshot}``."""
    return _read_tsv(spark, task_path(root, version, kshot, split))


def task_rows(turns: DataFrame, input_text, target_text, metainfo=None) -> DataFrame:
    """S7 rows: ``input, target, metainfo, dialog_id, turn_id`` with newlines/tabs removed."""
    meta = metainfo if metainfo is not None else F.to_json(F.struct("service", "dialog_acts"))
    return turns.select(clean_ws(input_text).alias("input"), clean_ws(target_text).alias("target"),
                        clean_ws(meta).alias("metainfo"), "dialog_id", F.col("turn_id").cast("int").alias("turn_id"))


def write_task_tsv(rows: DataFrame, path: str) -> None:
    """S7 sink: tab-separated, quotes doubled like Python's csv writer."""
    rows.write.mode("overwrite").option("sep", "\t").option("escape", '"').option("header", False).csv(path)


def read_fewshot_ids(spark: SparkSession, ids_dir: str, partitioned: bool = False) -> DataFrame:
    """``dialog_id, size`` — one text file of ids per split size (size = file name minus extension).

    ``partitioned`` reads a Spark-written ``size=<name>/`` layout instead.
    """
    if partitioned:
        df = spark.read.schema("value string, size string").text(ids_dir)
        return df.select(F.trim("value").alias("dialog_id"), "size").filter(F.col("dialog_id") != "")
    df = spark.read.text(ids_dir)
    return df.select(F.trim("value").alias("dialog_id"),
                     F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("size")) \
        .filter(F.col("dialog_id") != "")


def write_fewshot_ids(ids: DataFrame, ids_dir: str) -> None:
    """S8 sink: one id per line, one folder per split size."""
    ids.select(F.col("dialog_id").alias("value"), "size").write.mode("overwrite").partitionBy("size").text(ids_dir)


def turn_json(turns: DataFrame) -> DataFrame:
    """C11: turn record -> JSON text (``metainfo``) and back."""
    j = turns.select("turn_key", F.to_json(F.struct("service", "dialog_acts")).alias("json"))
    back = F.from_json("json", "struct<service:string, dialog_acts:array<struct<act:int,slot:string,values:array<string>>>>")
    return j.withColumn("record", back)


def fewshot(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of dialogues listed for each split size; an id listed twice counts once."""
    return rows.join(ids.select("dialog_id", "size").distinct(), "dialog_id", "inner").select(*rows.columns, "size")


# ------------------------------------------------------------------ S9 / S10 decode lines

def decode_lines(decodes: DataFrame) -> DataFrame:
    """``N|ref | pred | input`` text, pipes inside fields escaped."""
    return decodes.select("row_idx", F.concat(F.col("row_idx").cast("string"), F.lit("|"),
                                              F.concat_ws(" | ", escape_pipes("ref"), escape_pipes("pred"),
                                                          escape_pipes("sr"))).alias("value"))


def write_decodes(decodes: DataFrame, path: str) -> None:
    decode_lines(decodes).orderBy("row_idx").select("value").write.mode("overwrite").text(path)


def read_decodes(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    """Pipe-separated decode lines ``N|ref | pred | input``; no quoting.

    Lines with more than four fields (an unescaped ``|``) are dropped, missing
    trailing fields are null; pipes are unescaped.  Read as text and split
    natively, so there is no corrupt-record column to special-case.
    """
    f = F.split(F.col("value"), r"\|", -1)
    df = spark.read.text(path).filter(F.col("value") != "").select(f.alias("f")).filter(F.size("f") <= 4)
    g = (lambda c: F.trim(unescape_pipes(c))) if trim else unescape_pipes
    return df.select(F.get("f", 0).try_cast("long").alias("row_idx"), g(F.get("f", 1)).alias("ref"),
                     g(F.get("f", 2)).alias("pred"), g(F.get("f", 3)).alias("sr"))


# ------------------------------------------------------------------ S11 eval inputs

def with_line_index(lines: DataFrame, name: str = "line") -> DataFrame:
    """Key a keyless file table by line number, in the order of file names and of the lines in a file.

    ``lines`` is read from files.  A task reads a run of one or more file
    blocks from start to end, so a row's number within its task orders the rows
    of a block; file name and block start order the blocks.
    """
    keyed = lines.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return index_rows(keyed, [F.col("_file"), F.col("_block"), F.col("_at")], name).drop("_file", "_block", "_at")


def eval_inputs(spark: SparkSession, inputs_path: str, predictions_path: str) -> DataFrame:
    """Task TSV rows (JSON meaning record parsed) and predictions, paired by line.

    A line without a partner (files of unequal length) raises when the plan runs.
    """
    inp = with_line_index(_read_tsv(spark, inputs_path)).withColumn("_input", F.lit(True))
    pred = with_line_index(spark.read.text(predictions_path).withColumnRenamed("value", "prediction")) \
        .withColumn("_pred", F.lit(True))
    mr = F.from_json("metainfo", "struct<service:string, dialog_acts:array<struct<act:int,slot:string,values:array<string>>>>")
    return inp.join(pred, "line", "full").where(both_sides("line", "_input", "_pred")) \
        .select("line", "input", "target", "prediction", mr.alias("mr"))


# ------------------------------------------------------------------ S12 cache

def cached_prepare(spark: SparkSession, root: str, dataset: str, tokenizer: str, linearizer: str, split: str,
                   build, force: bool = False, save: bool = True) -> DataFrame:
    """Reuse ``root/dataset/tokenizer/linearizer/split`` unless ``force``; else build and store."""
    path = os.path.join(root, dataset, tokenizer, linearizer, split)
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise   # the cache is there but cannot be read
    df = build()
    if not save:
        return df
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ S13-S15 metric files

def write_metrics(df: DataFrame, path: str) -> None:
    """CSV with header (nested columns are written as JSON text)."""
    cols = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))
            else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def parent_export(rows: DataFrame, out_dir: str) -> None:
    """``ref.txt``, ``pred.txt`` (token lists) and JSON-lines ``table.jl`` (``[[[attr], [tokens]], ...]``)."""
    rows = rows.orderBy("row_idx")
    pairs = F.transform("table", lambda r: F.array(r["attr"], r["value"]))
    rows.select(F.to_json("ref_tokens").alias("value")).write.mode("overwrite").text(os.path.join(out_dir, "ref.txt"))
    rows.select(F.to_json("pred_tokens").alias("value")).write.mode("overwrite").text(os.path.join(out_dir, "pred.txt"))
    rows.select(F.to_json(pairs).alias("value")).write.mode("overwrite").text(os.path.join(out_dir, "table.jl"))


def read_results(spark: SparkSession, path: str, schema: T.StructType, run: str | None = None) -> DataFrame:
    """Read back a metric / case CSV; ``run`` defaults to the parent folder names."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    label = run if run is not None else "---".join(os.path.normpath(path).split(os.sep)[-3:-1])
    return df.withColumn("run", F.lit(label))
