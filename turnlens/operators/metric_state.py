"""Metrics whose partial results are kept as a table of sums.

Every metric here is a formula over sums of row statistics (rows, errors, clipped n-grams, lengths), so
batches can be added in any order and split: ``add_batch`` appends the sums of its rows, one row per
group, and ``compute`` adds all kept rows up and applies the formula. A batch is written under its own
name and a second writing of the same batch replaces the first, so a batch that is repeated after a
failure counts once. The row statistics are computed within the row; what is shuffled and kept is one
row per group and batch.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.functions.columns import domain_of
from turnlens.operators.ngram import BLEU_ORDER, bleu_from_sums, bleu_row_stats_rowwise
from turnlens.operators.ser import slot_error, slot_error_3v

ORDERS = range(1, BLEU_ORDER + 1)
#: Additive statistics of a group: rows, strict errors, rows with a permissible value and their errors, exact matches, BLEU sums.
SUMS = ["n_rows", "n_err", "n_applicable", "n_applicable_err", "n_same", *[f"m{n}" for n in ORDERS], *[f"h{n}" for n in ORDERS],
        "hyp_len", "ref_len"]


def row_statistics(rows: DataFrame, perm: DataFrame) -> DataFrame:
    """``domain`` and the statistics of every decoded row (needs ``ref, pred, service, dialog_acts``).

    ``perm`` is ``permissible_slots``. Null texts count as empty.
    """
    j = rows.join(perm.withColumnRenamed("slots", "perm"), "service", "left")
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("ref", "pred")}
    three = slot_error_3v("dialog_acts", text["pred"], "perm")
    j = j.select(text["ref"].alias("ref"), text["pred"].alias("pred"), domain_of("service").alias("domain"),
                 F.lit(1).cast("long").alias("n_rows"), slot_error("dialog_acts", text["pred"], "perm").cast("long").alias("n_err"),
                 three.isNotNull().cast("long").alias("n_applicable"), F.coalesce(three, F.lit(False)).cast("long").alias("n_applicable_err"),
                 (text["ref"] == text["pred"]).cast("long").alias("n_same"))
    return bleu_row_stats_rowwise(j).select("domain", *SUMS)


def grouped_sums(statistics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The statistics added up, per group or over all."""
    return statistics.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in SUMS])


def from_sums(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``ser, ser_applicable, bleu, seq_accuracy, n_rows`` of summed statistics; null where no row applies."""
    bleu = bleu_from_sums([F.col(f"m{n}") for n in ORDERS], [F.col(f"h{n}") for n in ORDERS], F.col("hyp_len"), F.col("ref_len"))

    def share(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of))

    return sums.select(*(by or []), share("n_err", "n_rows").alias("ser"), share("n_applicable_err", "n_applicable").alias("ser_applicable"),
                       bleu.alias("bleu"), (share("n_same", "n_rows") * 100).alias("seq_accuracy"), "n_rows")


class MetricState:
    """Partial sums under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add_batch(self, rows: DataFrame, perm: DataFrame, name: str | None = None) -> str:
        """Append the sums of ``rows``; a batch of the same name is replaced. Returns the name."""
        name = uuid.uuid4().hex if name is None else name
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"a batch name has letters, digits, dots, dashes and underscores only: {name}")
        grouped_sums(row_statistics(rows, perm), ["domain"]).write.mode("overwrite").parquet(f"{self.path}/batch={name}")
        return name

    def sums(self) -> DataFrame:
        """All kept sums, ``batch, domain`` and the statistics; no rows before the first batch."""
        fields = ", ".join(f"{c} bigint" for c in SUMS)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"batch string, domain string, {fields}")
        return self.spark.read.schema(f"domain string, {fields}, batch string").parquet(self.path)

    def compute(self, by: list[str] | None = None) -> DataFrame:
        """The metrics over all batches, per group of ``by`` (``["domain"]``) or overall."""
        return from_sums(grouped_sums(self.sums(), by), by)
