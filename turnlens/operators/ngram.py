"""N-gram statistics shared by corpus BLEU (A8, A9), ROUGE-1/2 (A11) and sequence accuracy.

Plan shape (batch): the row table is hash-partitioned once on its key and the
rows of a key stand together; an Arrow UDF then counts the n-grams of a whole
batch inside its rows, so neither an exchange nor a sort ever moves n-grams.
Clipped match counts are additive, so corpus and per-group scores are sums of
row statistics followed by one closed formula (no second pass over the text, no
per-row Python).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.columns import _col, bleu_tokens, rouge_tokens
from turnlens.operators import arraykernels as AK

BLEU_ORDER = 4


#: Rows of a batch are counted in parts of about this many tokens, which bounds the arrays of a part.
PART_TOKENS = 500_000


def _counts_udf(orders: list[int]):
    """Arrow UDF: ``ARRAY<STRUCT<r, h>>`` of a group's token lists -> ``m{n}``, the clipped matches of the whole group."""
    out = T.StructType([T.StructField(f"m{n}", T.LongType()) for n in orders])

    @F.arrow_udf(out)
    def counts(texts: pa.Array) -> pa.Array:
        group = np.repeat(np.arange(len(texts)), AK.sizes_of(texts))
        flat = texts.flatten()
        ref, hyp = flat.field("r"), flat.field("h")
        found = np.zeros((max(orders) + 1, len(texts)), dtype=np.int64)
        part = np.cumsum(AK.sizes_of(ref) + AK.sizes_of(hyp)) // PART_TOKENS
        start = np.searchsorted(group, np.arange(len(texts)))   # a group stays in one part: that of its first row
        for rows in np.split(np.arange(len(flat)), np.flatnonzero(np.diff(part[start][group])) + 1):
            if len(rows):
                lo, hi = int(rows[0]), int(rows[-1]) + 1
                h, r = AK.coded(hyp.slice(lo, hi - lo), ref.slice(lo, hi - lo))
                for n, found_n in enumerate(AK.gram_overlap(h, r, max(orders), group=group[lo:hi] - group[lo]), 1):
                    found[n, group[lo]:group[hi - 1] + 1] = found_n["both"]
        return pa.StructArray.from_arrays([pa.array(found[n]) for n in orders], names=out.fieldNames())
    return counts


def match_stats(df: DataFrame, key: str, ref_tokens: Column, hyp_tokens: Column, orders: list[int],
                keep: list[str] | None = None, repartition: bool = True) -> DataFrame:
    """Per row: ``m{n}`` clipped matches, ``h{n}`` hyp n-grams, ``r{n}`` ref n-grams, ``hyp_len``, ``ref_len``.

    Rows that agree in key, ``keep`` columns (e.g. domain) and lengths are one
    row whose n-grams are counted together; rows without one of the texts are
    left out.  Once the rows are hash-partitioned on the key, putting such rows
    together needs no other exchange; the n-grams are counted inside the row by
    an Arrow UDF and never become rows.  Totals come from the token counts.
    """
    keep = keep or []
    base = df.select(key, *keep, ref_tokens.alias("_r"), hyp_tokens.alias("_h"))
    if repartition:
        base = base.repartition(key)    # elided by Catalyst when already partitioned on the key
    ids = [key, *keep, "hyp_len", "ref_len"]
    sized = base.filter(F.col("_r").isNotNull() & F.col("_h").isNotNull()).select(
        key, *keep, F.size("_h").alias("hyp_len"), F.size("_r").alias("ref_len"), F.struct(F.col("_r").alias("r"), F.col("_h").alias("h")).alias("_t"))
    per_row = sized.groupBy(*ids).agg(F.collect_list("_t").alias("_t")).withColumn("_m", _counts_udf(list(orders))("_t"))
    totals = []
    for n in orders:
        totals += [F.greatest(F.col("hyp_len") - n + 1, F.lit(0)).alias(f"h{n}"),
                   F.greatest(F.col("ref_len") - n + 1, F.lit(0)).alias(f"r{n}")]
    return per_row.select(*ids, *totals, *[F.col(f"_m.m{n}").alias(f"m{n}") for n in orders])


def bleu_row_stats(df: DataFrame, key: str = "row_idx", ref: str = "ref", pred: str = "pred",
                   keep: list[str] | None = None) -> DataFrame:
    """BLEU sufficient statistics per row (13a tokens, orders 1-4)."""
    return match_stats(df, key, bleu_tokens(ref), bleu_tokens(pred), list(range(1, BLEU_ORDER + 1)), keep)


def bleu_from_sums(m: list[Column], t: list[Column], sys_len: Column, ref_len: Column) -> Column:
    """Corpus BLEU (0-100) from summed statistics; exponential smoothing of zero-match orders.

    A zero-match order n gets ``1 / (2^k * total_n)`` with k the running count of
    zero-match orders.  The score is 0 if any order has no n-gram or no order
    has a match.  Brevity penalty ``exp(1 - ref/sys)`` when ``sys < ref``.
    """
    logs, k = [], F.lit(0)
    for mi, ti in zip(m, t):
        k = k + F.when(mi == 0, 1).otherwise(0)
        p = F.when(mi == 0, F.lit(1.0) / (F.pow(F.lit(2.0), k) * ti)).otherwise(mi / ti)
        logs.append(F.log(p))
    any_total_zero = F.greatest(*[ti == 0 for ti in t]) if len(t) > 1 else (t[0] == 0)
    no_match = F.greatest(*[mi for mi in m]) == 0 if len(m) > 1 else (m[0] == 0)
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len == 0, F.lit(0.0)) \
        .otherwise(F.exp(F.lit(1.0) - ref_len / sys_len))
    mean_log = sum(logs[1:], logs[0]) / len(logs)
    return F.when(any_total_zero | no_match, F.lit(0.0)).otherwise(F.lit(100.0) * bp * F.exp(mean_log))


def bleu_agg(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Corpus BLEU overall (``by`` empty) or per group from row statistics."""
    orders = range(1, BLEU_ORDER + 1)
    sums = stats.groupBy(*(by or [])).agg(*[F.sum(f"m{n}").alias(f"m{n}") for n in orders],
                                          *[F.sum(f"h{n}").alias(f"h{n}") for n in orders],
                                          F.sum("hyp_len").alias("sys_len"), F.sum("ref_len").alias("ref_len"))
    score = bleu_from_sums([F.col(f"m{n}") for n in orders], [F.col(f"h{n}") for n in orders],
                           F.col("sys_len"), F.col("ref_len"))
    return sums.select(*(by or []), score.alias("bleu"))


def rouge_n_rows(df: DataFrame, key: str = "row_idx", ref: str = "ref", pred: str = "pred",
                 orders=(1, 2), keep: list[str] | None = None) -> DataFrame:
    """ROUGE-N precision / recall per row (no stemming): ``rouge{n}_prec``, ``rouge{n}_recall``."""
    s = match_stats(df, key, rouge_tokens(ref), rouge_tokens(pred), list(orders), keep)
    cols = []
    for n in orders:
        cols += [(F.col(f"m{n}") / F.greatest(F.col(f"h{n}"), F.lit(1))).alias(f"rouge{n}_prec"),
                 (F.col(f"m{n}") / F.greatest(F.col(f"r{n}"), F.lit(1))).alias(f"rouge{n}_recall")]
    return s.select(key, *(keep or []), *cols)


def seq_accuracy(target, pred) -> Column:
    """Share of exact matches x100 (an aggregate expression)."""
    return F.avg((_col(target) == _col(pred)).cast("int")) * 100


# ---------------------------------------------------------------- row-local (streaming) variant

_ROW_STATS = T.StructType([T.StructField(f"{k}{n}", T.LongType()) for k in "mh" for n in range(1, BLEU_ORDER + 1)])


@F.arrow_udf(_ROW_STATS)
def _clipped_counts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    h, r = AK.coded(hyp, ref)
    orders = AK.gram_overlap(h, r, BLEU_ORDER)
    parts = [g["both"] for g in orders] + [g["a"] for g in orders]
    return pa.StructArray.from_arrays([pa.array(x.astype("int64")) for x in parts], names=_ROW_STATS.fieldNames())


def bleu_row_stats_rowwise(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """BLEU statistics of each row computed inside the row (no explode, no grouping).

    Tokens come from the same native 13a expression as the batch plan; one
    Arrow UDF counts the clipped n-grams of a whole batch.  Used by the stream, where a second stateful aggregation
    after a per-row regroup is not allowed.
    """
    x = df.withColumns({"_r": bleu_tokens(ref), "_h": bleu_tokens(pred)})
    x = x.withColumn("_s", _clipped_counts("_r", "_h"))
    return x.select(*[c for c in df.columns], *[F.col(f"_s.{k}").alias(k) for k in _ROW_STATS.fieldNames()],
                    F.size("_h").cast("bigint").alias("hyp_len"), F.size("_r").cast("bigint").alias("ref_len"))
