"""File source / sink keys: each writes fixture rows in the original file format to a
scratch folder under ``spark.checkpoint.dir`` and reads them back (S2-S13)."""

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.columns import decode_acts
from turnlens.operators import linearize as L
from turnlens.plans.common import r6
from turnlens.plans.registry import register
from turnlens.session import scratch_folder
from turnlens.sources import fixtures as fx
from turnlens.sources import files


def scratch(spark, name):
    return scratch_folder(spark, name)


@register("decode_lines", """
SELECT row_idx, concat(CAST(row_idx AS VARCHAR), '|', replace(ref, '|', '<vstripe>'), ' | ', replace(pred, '|', '<vstripe>'),
  ' | ', replace(sr, '|', '<vstripe>')) AS value FROM decodes""")
def decode_lines(spark, d):
    return files.decode_lines(fx.decodes(spark, d))


@register("read_decodes", "SELECT row_idx, concat(ref, ' ') AS ref, concat(' ', pred, ' ') AS pred, concat(' ', sr) AS sr FROM decodes")
def read_decodes(spark, d):
    p = scratch(spark, "decodes")
    files.write_decodes(fx.decodes(spark, d), p)
    return files.read_decodes(spark, p)


SPLIT_DIRS = {"train": "train", "validation": "dev", "test": "test"}


def _write_tasks(spark, d, splits=("train", "validation", "test")):
    root = scratch(spark, "tasks")
    t = fx.turns(spark, d, splits=list(splits)).withColumn("dialog_acts", decode_acts("dialog_acts"))
    t = t.join(L.template_maps(fx.templates(spark, d)), "service", "left")
    t = t.withColumn("turn_id", F.col("turn_key") % 1000)
    for split in splits:
        part = t.filter(F.col("split") == split)
        r = files.task_rows(part, L.lin_tsv_t2g2("dialog_acts", "service", "tmpl", F.lit(fx.FRAME_INTENT)), F.col("target"))
        files.write_task_tsv(r, os.path.join(root, SPLIT_DIRS[split], "t2g2_all.tsv"))
    return root


TASK_SQL = """SELECT t.dialog_id, CAST(t.turn_key % 1000 AS INTEGER) AS turn_id, t.target,
  CASE t.split WHEN 'validation' THEN 'dev' ELSE t.split END AS split FROM turn_text t"""


@register("read_task_tsv", TASK_SQL)
def read_task_tsv(spark, d):
    root = _write_tasks(spark, d)
    parts = files.read_task_tsv(spark, root, "t2g2_all.tsv")
    out = None
    for s, df in parts.items():
        x = df.select("dialog_id", "turn_id", "target", F.lit(s).alias("split"))
        out = x if out is None else out.unionByName(x)
    return out


@register("read_task", f"SELECT dialog_id, turn_id, target FROM ({TASK_SQL}) WHERE split = 'test'")
def read_task(spark, d):
    root = _write_tasks(spark, d, ["test"])
    return files.read_task(spark, root, "t2g2", "5_shot", "test").select("dialog_id", "turn_id", "target")


@register("read_dialogues", """
SELECT dialog_id, CAST(row_number() OVER (PARTITION BY dialog_id ORDER BY pos) - 1 AS INTEGER) AS pos, speaker, utterance FROM raw_turns""")
def read_dialogues(spark, d):
    p = scratch(spark, "dialogues")
    r = fx.raw_turns(spark, d)
    dial = r.groupBy("dialog_id").agg(F.sort_array(F.collect_list(F.struct("pos", "speaker", "utterance"))).alias("t")) \
        .select(F.col("dialog_id").alias("dialogue_id"), F.array().cast("array<string>").alias("services"),
                F.transform("t", lambda x: F.struct(x["speaker"].alias("speaker"), x["utterance"].alias("utterance"),
                                                    F.array().cast("array<struct<service:string>>").alias("frames"))).alias("turns"))
    dial.write.mode("overwrite").json(os.path.join(p, "dialogues"))
    dl = files.read_dialogues(spark, os.path.join(p, "dialogues"), multi_line=False)
    return files.dialogue_turns(dl).select("dialog_id", F.col("pos").cast("int").alias("pos"), "speaker", "utterance")


@register("read_schemas", """
SELECT service, slot, slot_desc, is_categorical, possible_values,
  CAST(row_number() OVER (PARTITION BY service ORDER BY slot_pos) - 1 AS INTEGER) AS slot_pos FROM schema_slots""")
def read_schemas(spark, d):
    p = scratch(spark, "schemas")
    files.nest_schema(fx.schema_slots(spark, d)).write.mode("overwrite").json(p)
    s = files.flatten_schema(files.read_schemas(spark, [p], multi_line=False))
    return s.select("service", "slot", "slot_desc", "is_categorical",
                    F.array_join("possible_values", ",").alias("possible_values"), F.col("slot_pos").cast("int"))


@register("read_templates", "SELECT service, act_key, template FROM templates")
def read_templates(spark, d):
    p = scratch(spark, "templates")
    t = fx.templates(spark, d)
    t.write.mode("overwrite").partitionBy("service").option("sep", "\t").option("quote", "").csv(p)
    return files.check_templates(files.read_templates(spark, p, partitioned=True)).select("service", "act_key", "template")


@register("cached_prepare", "SELECT turn_key, sr AS text FROM paper_text")
def cached_prepare(spark, d):
    root = scratch(spark, "cache")

    def build():
        t = fx.turns(spark, d)
        return t.select("turn_key", L.lin_paper(decode_acts("dialog_acts")).alias("text"))

    files.cached_prepare(spark, root, "sgd", "ws", "paper", "all", build)          # first call builds
    return files.cached_prepare(spark, root, "sgd", "ws", "paper", "all", build)   # second call reuses


@register("write_metrics", "SELECT 'ser' AS metric, round(avg(CAST(has_slot_error AS INTEGER)), 6) AS value, 'r1---t1' AS run FROM row_ser")
def write_metrics(spark, d):
    from turnlens.plans.common import annotated
    from turnlens.operators import ser as S
    p = scratch(spark, "metrics")
    m = annotated(spark, d).agg(r6(S.ser_rate(F.col("has_slot_error"))).alias("value")).select(F.lit("ser").alias("metric"), "value")
    out = os.path.join(p, "r1", "t1", "metrics.csv")
    files.write_metrics(m, out)
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])
    return files.read_results(spark, out, schema)


@register("eval_inputs", """
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS line, sr AS input, ref AS target, pred AS prediction, a.service, n_acts
FROM decodes JOIN (SELECT turn_key, service, CAST(count(*) AS INTEGER) AS n_acts FROM acts GROUP BY turn_key, service) a ON a.turn_key = row_idx""")
def eval_inputs(spark, d):
    p = scratch(spark, "eval")
    j = fx.decodes(spark, d, with_acts=True).orderBy("row_idx")
    rows = j.select(F.col("sr").alias("input"), F.col("ref").alias("target"),
                    F.to_json(F.struct("service", "dialog_acts")).alias("metainfo"), F.lit("").alias("dialog_id"),
                    (F.col("row_idx") % 1000).cast("int").alias("turn_id"))
    files.write_task_tsv(rows, os.path.join(p, "inputs"))
    j.select("pred").write.mode("overwrite").text(os.path.join(p, "preds"))
    e = files.eval_inputs(spark, os.path.join(p, "inputs"), os.path.join(p, "preds"))
    return e.select("line", "input", "target", "prediction", "mr.service", F.size("mr.dialog_acts").alias("n_acts"))


@register("fewshot_ids", """
SELECT DISTINCT dialog_id, '5_shot' AS size FROM acts WHERE CAST(substr(dialog_id, 3) AS BIGINT) % 50 = 0
UNION ALL SELECT DISTINCT dialog_id, '20_shot' FROM acts WHERE CAST(substr(dialog_id, 3) AS BIGINT) % 10 = 0""")
def fewshot_ids(spark, d):
    """Few-shot id lists written one folder per size and read back."""
    from turnlens.plans.q_analysis import fewshot_ids as ids
    p = scratch(spark, "fewshot")
    files.write_fewshot_ids(ids(spark, d), p)
    return files.read_fewshot_ids(spark, p, partitioned=True).select("dialog_id", "size")


@register("turn_json", "SELECT DISTINCT turn_key, service, TRUE AS same FROM acts")
def turn_json(spark, d):
    """C11: turn -> JSON -> record; ``same`` is true when the round trip is lossless."""
    j = files.turn_json(fx.turns(spark, d))
    t = fx.turns(spark, d).select("turn_key", "service", "dialog_acts")
    return j.join(t, "turn_key").select(
        "turn_key", "record.service", ((F.col("record.service") == F.col("service")) &
                             (F.to_json("record.dialog_acts") == F.to_json("dialog_acts"))).alias("same"))
