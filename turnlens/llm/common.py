"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.session import checkpoint_dir, scratch_folder

#: Rows of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger (no result depends on it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder named by ``spark.checkpoint.dir``, deleted when the driver ends."""
    return scratch_folder(spark, name)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def literal_rows(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A small frame of driver-side rows as a native literal (callers state the bound on their number)."""
    names = re.findall(r"(\w+) \w+", ddl)
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl.replace(' ', ':')}>>"
                                                      .replace(",:", ","))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, of which later reads take single columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """Bitmap of ``2 ** bits`` bits over the upper bits of a column ``hash``; the executors build its parts."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    parts = hashes.select(at.alias("at")).select(F.bitmap_bucket_number("at").alias("n"),
                                                 F.bitmap_bit_position("at").alias("bit")) \
        .groupBy("n").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # 2 ** (bits - 3) bytes at most
    out = np.zeros((1 << (bits - 3)) + 4096, dtype=np.uint8)
    for r in parts:
        # bucket n > 0 holds the values from (n - 1) * 32768 + 1 on, bucket 0 those up to 0
        value = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little"))
        value = value + (r["n"] - 1) * 32768 + 1 if r["n"] > 0 else value
        np.bitwise_or.at(out, value >> 3, (1 << (value & 7)).astype(np.uint8))
    return out.tobytes()


def in_bitmap(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds each of the 64-bit hashes (some it holds by chance)."""
    at = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
