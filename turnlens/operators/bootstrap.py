"""Seeded bootstrap intervals of row metrics.

A bootstrap replicate draws as many rows as there are, with replacement. How often a row is drawn
is, for many rows, a Poisson number of mean 1, independent of the other rows. So every row gets its
own weight for each replicate from a hash of its key: no row is moved or drawn, all replicates of a
task's rows are products of a matrix of weights and the metrics, and only ``replicates`` rows of partial
sums of each task are shuffled. A row weighs the same however the table is partitioned or split into batches, and the sums
of two tables add up.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLICATES, CONFIDENCE, SEED = 1000, 0.95, 42
#: Weights taken from one md5 of 128 bits, 32 bits each.
PER_HASH = 4
#: Upper ends of the 32-bit numbers that mean weight 0, 1, 2, ...: the Poisson distribution of mean 1.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


#: Rows whose weights are held at a time: this many times ``replicates`` numbers.
PART_ROWS = 1024


def replicate_weights(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """Weights of rows by their keys: one row for each key, one column for each replicate."""
    blocks = [b":%d" % b for b in range(-(-replicates // PER_HASH))]
    starts = [f"{seed}:{key}".encode() for key in keys]
    digests = b"".join([hashlib.md5(start + block).digest() for start in starts for block in blocks])
    numbers = np.frombuffer(digests, dtype=">u4").astype(np.uint32).reshape(len(keys), -1)[:, :replicates]
    return np.searchsorted(np.array(POISSON, dtype=np.uint32), numbers, side="right")


def bootstrap_sums(rows: DataFrame, key: str, metrics: list[str], replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """``replicate, n_<metric>, sum_<metric>``: weighted counts and sums; sums of parts of a table add up.

    Rows whose metric is null don't count for it. A null key counts as a key of its own.
    """
    names = [f"{s}_{m}" for m in metrics for s in ("n", "sum")]

    def sums(batches):
        drawn = np.zeros(replicates, dtype=np.int64)
        n, total = (np.zeros((replicates, len(metrics))) for _ in "nt")
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                w = replicate_weights(part.column(0).to_pylist(), replicates, seed).astype(np.float64)
                drawn += (w > 0).sum(axis=0)
                for i in range(len(metrics)):
                    c = part.column(i + 1)
                    known = c.is_valid().to_numpy(zero_copy_only=False)
                    v = c.fill_null(0.0).to_numpy(zero_copy_only=False)
                    odd = ~np.isfinite(v)
                    n[:, i] += known.astype(np.float64) @ w
                    total[:, i] += np.where(odd, 0.0, v) @ w
                    for x, one in zip(v[odd], w[odd]):   # a row that is not drawn adds nothing, not 0 * inf
                        total[one > 0, i] += x
        here = np.flatnonzero(drawn)
        out = [pa.array(here.astype(np.int32))]
        for i in range(len(metrics)):
            none = n[here, i] == 0
            out += [pa.array(n[here, i].astype(np.int64), mask=none), pa.array(total[here, i], mask=none)]
        yield pa.RecordBatch.from_arrays(out, names=["replicate", *names])

    schema = ", ".join(["replicate int", *[f"`{c}` {'long' if c.startswith('n_') else 'double'}" for c in names]])
    keyed = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)])
    return keyed.mapInArrow(sums, schema).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])


def intervals(sums: DataFrame, metrics: dict[str, str], confidence: float = CONFIDENCE) -> DataFrame:
    """``metric, low, mid, high``: percentiles of the replicates' means; ``metrics`` maps columns to names."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), (F.col(f"sum_{m}") / F.col(f"n_{m}")).alias("mean"))
                               for m, name in metrics.items()]))
    tail = round((1.0 - confidence) / 2.0, 12)
    means = sums.select(each.alias("x")).select("x.metric", "x.mean")
    return means.groupBy("metric").agg(*[F.percentile("mean", F.lit(p)).alias(c) for p, c in ((tail, "low"), (0.5, "mid"), (1 - tail, "high"))])


def bootstrap(rows: DataFrame, key: str, metrics: dict[str, str], replicates: int = REPLICATES, confidence: float = CONFIDENCE,
              seed: int = SEED) -> DataFrame:
    """``metric, low, mid, high`` of the mean of each metric column of ``rows``."""
    return intervals(bootstrap_sums(rows, key, list(metrics), replicates, seed), metrics, confidence)
