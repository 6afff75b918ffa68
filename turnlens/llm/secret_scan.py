"""Secret scan with an incremental blob ledger.

Every text version is addressed by the SHA-256 of its bytes (a blob). The ledger keeps two Parquet
tables in a shared folder: ``scanned`` (blob, rule, version) and ``findings`` (blob, rule, version,
start, end). A scan runs only the pairs of blob and rule version that the ledger does not hold, once
per blob however many paths share it, and then joins the findings back to all paths.

Positions count code points, the end is exclusive. They come from built-in functions: the pieces
between the matches and the matches themselves alternate, so a running sum of their lengths gives
each start. Null and empty texts have no findings. Rows that repeat a text share its blob. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.llm.common import fresh_name, scratch_path, text_or_empty

# The rules' patterns. A rule of a minimal length keeps a match whose group ``group`` has it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``version`` changes whenever the pattern does, so that old blobs are scanned anew."""
    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    needs: str = ""


RULES = [Rule("assign", ASSIGN, group=2, least=6), Rule("access", ACCESS, needs="AKIA"), Rule("hex", HEX)]
LEDGER = "blob binary, rule string, version int"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def matches(text: Column, rule: Rule) -> Column:
    """Array of (gap, size, keep) of the rule's matches from left to right; gap: code points since the last match."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    keeps = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    found = F.transform(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), keeps.alias("keep")),
                        lambda m, i: F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"),
                                              i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"),
                                              m["keep"].alias("keep")))
    has = text.rlike(rule.pattern) if not rule.needs else text.contains(rule.needs) & text.rlike(rule.pattern)
    return F.when(has, F.filter(found, lambda m: m["size"].isNotNull()))


def scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``blob, rule, version, start, end`` of all kept matches in rows of ``blob, text, todo``.

    ``todo`` lists the kinds to run on a blob.
    """
    none = F.array().cast("array<struct<rule:string,version:int,i:int,gap:int,size:int,keep:boolean>>")
    found = [F.when(F.array_contains("todo", r.kind), matches(F.col("text"), r)) for r in rules]
    rows = blobs.select("blob", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("m")) \
        .select("blob", "m.*")
    running = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(running)
    return rows.withColumn("end", end).where("keep") \
        .select("blob", "rule", "version", (F.col("end") - F.col("size")).alias("start"), "end")


class Ledger:
    """The blob ledger in ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, ddl: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")
        columns = [c.strip().split(" ") for c in ddl.split(",")]
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in columns])

    def _current(self, df: DataFrame, rules: list[Rule]) -> DataFrame:
        """Rows of the given rule versions."""
        now = F.lit(False)
        for r in rules:
            now = now | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
        return df.where(now)

    def scanned(self, rules: list[Rule]) -> DataFrame:
        return self._current(self._read("scanned", LEDGER), rules)

    def findings(self, rules: list[Rule]) -> DataFrame:
        return self._current(self._read("findings", LEDGER + ", start bigint, end bigint"), rules).distinct()

    def update(self, docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> None:
        """Scan the unseen pairs of blob and rule version of ``docs`` and add them.

        Findings are written before the pairs are marked: a run that breaks off between the two
        scans again, and ``findings`` drops the repeats. Only hashes of texts and ids are compared with
        the ledger; a text moves once, and only if its blob has something to scan.
        """
        rows = docs.select(F.xxhash64(id_col).alias("key"), text_or_empty(text_col).alias("text")).where("text != ''") \
            .withColumn("blob", blob_of(F.col("text")))
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        seen = self.scanned(rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>")))
        fresh = f"{self.path}/todo-{uuid.uuid4().hex}"
        rows.groupBy("blob").agg(F.min("key").alias("key")).join(seen, "blob", "left") \
            .select("blob", "key", todo.alias("todo")).where("size(todo) > 0").write.parquet(fresh)
        pairs = self.spark.read.parquet(fresh)
        # rows may agree in id and text: one of them is scanned (partitioned as the join, so the texts stay where they are)
        texts = rows.join(pairs, ["blob", "key"]).dropDuplicates(["blob", "key"]).select("blob", "text", "todo")
        scan_blobs(texts, rules).write.mode("append").parquet(f"{self.path}/findings")
        version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        pairs.select("blob", F.explode("todo").alias("rule")) \
            .select("blob", "rule", version[F.col("rule")].alias("version")) \
            .write.mode("append").parquet(f"{self.path}/scanned")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of (start, place, kind, end), in order, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))))


def findings_by_blob(found: DataFrame, rules: list[Rule]) -> DataFrame:
    """``blob, spans``: a blob's findings in order of start, then of the rules."""
    place = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule"))
    return found.groupBy("blob").agg(F.collect_list(F.struct("start", place.alias("place"), "rule", "end"))
                                     .alias("spans"))


def scan_documents(docs: DataFrame, ledger_path: str | None = None, rules: list[Rule] = RULES,
                   id_col: str = "doc_id", text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """All columns of every row of ``docs`` and ``spans_col``, its findings in order (never null).

    Without ``ledger_path`` a new ledger is made; with it, blobs scanned before are not scanned again.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or scratch_path(spark, "ledger"))
    ledger.update(docs, rules, id_col, text_col)
    blob_col, found_col = fresh_name(docs, "blob"), fresh_name(docs, "found")
    by_blob = findings_by_blob(ledger.findings(rules), rules) \
        .select(F.col("blob").alias(blob_col), F.col("spans").alias(found_col))
    none = F.array().cast("array<struct<start:bigint,place:bigint,rule:string,end:bigint>>")
    return docs.join(by_blob, blob_of(text_or_empty(text_col)) == F.col(blob_col), "left") \
        .withColumn(spans_col, F.array_sort(F.coalesce(found_col, none))).drop(blob_col, found_col)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["rule"] == kind


def secret_report(docs: DataFrame, ledger_path: str | None = None, rules: list[Rule] = RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_<kind>`` of each rule, ``base_sha256`` (hash of the spans) and ``spans`` of every row."""
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = scan_documents(slim, ledger_path, rules, "id", "text")
    counts = [F.size(F.filter("secret_spans", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules]
    spans = span_list(F.col("secret_spans"))
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
                       spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``; spans may overlap, they are in order of start."""
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] + 1, acc["at"])
        gap = F.substring(text, acc["at"].cast("int"), (begin - acc["at"]).cast("int"))
        mark = F.when(s["end"] + 1 > acc["at"], F.concat(F.lit("["), s["rule"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(s["end"] + 1, acc["at"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"].cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
