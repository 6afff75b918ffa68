"""Incremental SER and BLEU with Structured Streaming.

The original pipeline accumulates decoded rows batch by batch (``add_batch``)
and computes once at the end.  Here decoded rows arrive as files; each row's
SER flag is a column expression and its BLEU statistics are computed inside
the row (no per-row regroup, which a streaming query could not follow with a
second stateful aggregation); one stateful ``groupBy(domain)`` keeps
additive sums.  The
state is one row per domain.  Scores are computed from the sums when read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.columns import domain_of
from turnlens.operators.ngram import BLEU_ORDER, bleu_from_sums, bleu_row_stats_rowwise
from turnlens.operators.metric_state import MetricState
from turnlens.operators.ser import slot_error
from turnlens.session import checkpoint_dir

DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STREAM_ROW = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("ref", T.StringType()),
    T.StructField("pred", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("dialog_acts", T.ArrayType(T.StructType([
        T.StructField("act", T.IntegerType()), T.StructField("slot", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType()))]))),
])


def stream_stats(rows: DataFrame, perm: DataFrame, bleu: bool = True) -> DataFrame:
    """Per-domain running sums over a (streaming or batch) DataFrame of decoded rows.

    ``perm`` is the static ``permissible_slots`` table.  Without ``bleu`` only
    the error counts are kept.
    """
    j = rows.join(perm.withColumnRenamed("slots", "perm"), "service", "left")
    j = j.select("ref", "pred", domain_of("service").alias("domain"),
                 slot_error("dialog_acts", "pred", "perm").cast("int").alias("err"))
    counts = [F.count(F.lit(1)).alias("n_rows"), F.sum("err").alias("n_err")]
    if not bleu:
        return j.groupBy("domain").agg(*counts)
    x = bleu_row_stats_rowwise(j)
    keys = [f"m{n}" for n in range(1, BLEU_ORDER + 1)] + [f"h{n}" for n in range(1, BLEU_ORDER + 1)] + ["hyp_len", "ref_len"]
    return x.groupBy("domain").agg(*counts, *[F.sum(k).alias(k) for k in keys])


def scores(sums: DataFrame) -> DataFrame:
    """SER and, where its sums are kept, BLEU per domain from the additive sums."""
    ser = (F.col("n_err") / F.col("n_rows")).alias("ser")
    if "hyp_len" not in sums.columns:
        return sums.select("domain", ser, "n_rows")
    orders = range(1, BLEU_ORDER + 1)
    bleu = bleu_from_sums([F.col(f"m{n}") for n in orders], [F.col(f"h{n}") for n in orders],
                          F.col("hyp_len"), F.col("ref_len"))
    return sums.select("domain", ser, bleu.alias("bleu"), "n_rows")


def run_stream(spark: SparkSession, source_dir: str, perm: DataFrame, work_dir: str,
               max_files_per_trigger: int | None = None, bleu: bool = True) -> DataFrame:
    """Run the stream over the files in ``source_dir`` until they are consumed (AvailableNow).

    Each micro-batch's complete aggregate replaces the result table under
    ``work_dir``; the checkpoint makes a restarted query resume where it stopped.
    Returns the final sums as a batch DataFrame.
    """
    out = os.path.join(work_dir, "result")
    # The static side of a stream-static join is re-evaluated on every trigger;
    # it is one row per service, so materialise it once (reliable checkpoint).
    checkpoint_dir(spark)
    perm = perm.checkpoint()
    reader = spark.readStream.schema(STREAM_ROW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    agg = stream_stats(reader.parquet(source_dir), perm, bleu)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", os.path.join(work_dir, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out)


def run_stream_once(spark: SparkSession, source_dir: str, perm: DataFrame, work_dir: str, key: str = "row_idx",
                    max_files_per_trigger: int | None = None, schema: T.StructType = STREAM_ROW,
                    event_time: str | None = None, delay: str = "1 day") -> MetricState:
    """R1 with every row counted once, however often its file is delivered.

    The stream keeps the keys it has seen as keyed state (in RocksDB on the executors, where a
    session names no other store) and lets a row through the first time only; rows that agree in
    their key are the same row. Each micro-batch then adds its sums to a ``MetricState`` under its batch
    number: a batch that is repeated after a failure replaces itself. With ``event_time`` keys are forgotten
    ``delay`` after their time, which bounds the state; without it they are kept for good.
    """
    checkpoint_dir(spark)
    perm = perm.checkpoint()
    state = MetricState(spark, os.path.join(work_dir, "sums"))
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir)
    rows = rows.dropDuplicates([key]) if event_time is None else \
        rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    store = "spark.sql.streaming.stateStore.providerClass"
    named = spark.conf.get(store, DEFAULT_STORE)
    if named == DEFAULT_STORE:
        spark.conf.set(store, ROCKSDB_STORE)
    try:
        q = (rows.writeStream.outputMode("append")
             .foreachBatch(lambda batch, number: state.add_batch(batch, perm, f"{number:012d}") and None)
             .option("checkpointLocation", os.path.join(work_dir, "checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    finally:
        spark.conf.set(store, named)
    return state
