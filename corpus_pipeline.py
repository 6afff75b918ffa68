"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return the columns of their input. Rows are told apart by id and text together
(a 128-bit digest that marks nulls and lengths): a null id or text is a value of its own, and rows that
share an id are different rows if their texts differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.llm.byte_bpe import round_trip
from turnlens.llm.common import fresh_name, scratch_path, table
from turnlens.llm.decontaminate import contaminated
from turnlens.llm.ngram_join import similar_classes
from turnlens.llm.secret_scan import redacted, scan_documents
from turnlens.llm.toxicity import THRESHOLD, held_out, train, with_score

BYTE_VOCAB = "byte_bpe_multi_50k.tiktoken"
#: Near duplicates: words of a shingle and percent of similarity.
WORDS, PERCENT = 5, 80


def told_apart(*cols: str) -> Column:
    """A digest of several columns: equal only if each is equal, or null in both rows."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("null;")))
    return F.unhex(F.md5(F.concat(*parts)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts."""
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    score = fresh_name(docs, "score")
    return with_score(docs, model, score_col=score).where(F.col(score) < THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the smallest id (of rows that agree in id and text, one).

    Texts without words are in no class: every row of them stays.
    """
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), told_apart("doc_id", "text").alias("key")).alias("row"), "text")
    classes = similar_classes(keyed, WORDS, PERCENT, id_col="row")
    key, own = fresh_name(docs, "row_key"), fresh_name(docs, "own_row")
    kept = classes.where("n_shingles = 0 OR component_id = row").groupBy(F.col("row.key").alias(key)) \
        .agg(F.min(F.col("n_shingles") > 0).alias(own))
    one = F.when(F.col(own), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return docs.withColumn(key, told_apart("doc_id", "text")).join(kept, key).withColumn(own, one) \
        .dropDuplicates([key, own]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = fresh_name(docs, "row_key")
    keyed = docs.withColumn(key, told_apart("doc_id", "text"))
    bench = table(spark, sf_dir, "benchmark")  # items without an id count as well
    item = fresh_name(bench, "item_key")
    bench = bench.withColumn(item, told_apart("item_id", "text"))
    found = contaminated(keyed, bench, id_col=key, item_col=item).select(key).distinct()
    return keyed.join(found, key, "left_anti").drop(key)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; where a text changes, a column ``n_chars`` follows it."""
    spans, new = fresh_name(docs, "secret_spans"), fresh_name(docs, "new_text")
    found = scan_documents(docs, spans_col=spans).withColumn(new, redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        size = F.length(new).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(new).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(size))
    return found.withColumn("text", F.col(new)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them."""
    return round_trip(docs, BYTE_VOCAB, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("byte_bpe", byte_bpe)]

#: No SQL: the stages train a model, follow links and encode. tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
