"""Metrics that need sequence alignment: ROUGE-L, token-sort ratio / fuzzy SER, PARENT (METEOR: ``meteor.py``).

These run as Arrow-batched pandas UDFs (one Python call per batch of rows,
never per row on the driver).  Everything that can be decided natively is
decided before the UDF: normalised keys, exact hits and length bounds prune
fuzzy candidates, and a row's window keys reach Python once per value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.functions.columns import _col, rouge_tokens, ws_tokens
from turnlens.operators import arraykernels as AK
from turnlens.operators.meteor import meteor_one, meteor_rows  # noqa: F401 - one place for the text metrics
from turnlens.operators.ser import slot_error_rows


# ---------------------------------------------------------------- LCS / ROUGE-L

@F.arrow_udf(T.IntegerType())
def lcs_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(AK.common_subsequence(*AK.coded(a, b)).astype("int32"))


def rouge_l_rows(df: DataFrame, key: str = "row_idx", ref: str = "ref", pred: str = "pred") -> DataFrame:
    """ROUGE-L precision / recall per row (LCS over ROUGE tokens; 0 when a side is empty)."""
    x = df.select(key, rouge_tokens(ref).alias("_r"), rouge_tokens(pred).alias("_h"))
    x = x.withColumn("_l", lcs_udf("_r", "_h"))
    empty = (F.size("_r") == 0) | (F.size("_h") == 0)
    return x.select(key, F.when(empty, 0.0).otherwise(F.col("_l") / F.size("_h")).alias("rougeL_prec"),
                    F.when(empty, 0.0).otherwise(F.col("_l") / F.size("_r")).alias("rougeL_recall"))


# ---------------------------------------------------------------- token-sort ratio / fuzzy match

def sort_key(c) -> Column:
    """Normalised token-sort key: drop chars U+0080-U+00FF, non-word -> space, lowercase, sort tokens."""
    s = F.regexp_replace(_col(c), "[\\x{80}-\\x{FF}]", "")
    s = F.lower(F.regexp_replace(s, "(?U)\\W", " "))
    return F.array_join(F.array_sort(ws_tokens(s)), " ")


def ratio_of_keys(a: str, b: str) -> int:
    """Integer ratio of two normalised keys (matching blocks, half-even rounding); every character counts."""
    return int(AK.similarity(AK.letters(pa.array([a])), AK.letters(pa.array([b])))[0])


@F.arrow_udf(T.IntegerType())
def ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(AK.similarity(AK.letters(a), AK.letters(b)).astype("int32"))


def token_sort_ratio(a, b) -> Column:
    """C3 as a column: exact keys -> 100 natively, else the Arrow UDF."""
    ka, kb = sort_key(a), sort_key(b)
    return F.when(ka == kb, F.lit(100)).otherwise(ratio_udf(ka, kb))


FUZZY_MIN = 91        # ratio / 100 > 0.9 on an integer ratio
LENGTH_BOUND = 0.905  # 2*min(len)/(sum len) below this cannot reach FUZZY_MIN


@F.arrow_udf(T.BooleanType())
def any_ratio_udf(vk: pa.Array, cands: pa.Array) -> pa.Array:
    """True if some candidate key reaches the fuzzy threshold against the value key; null for a null value."""
    row = np.repeat(np.arange(len(vk)), AK.sizes_of(cands))
    hit = AK.similarity(AK.letters(cands.flatten()), AK.letters(vk).take(row), FUZZY_MIN) >= FUZZY_MIN
    found = np.bincount(row[hit], minlength=len(vk)) > 0
    return pa.array(found, mask=vk.is_null().to_numpy(zero_copy_only=False))


def fuzzy_match(text, value) -> Column:
    """Does some window of ``len(value.split())`` space-split tokens of ``text``
    reach token-sort ratio >= 91 against ``value``?

    A value that stands in the text between spaces (or before a final dot) is a
    hit at once: its window has the same key.  For the others windows,
    normalised keys, exact hits and the length bound are native expressions;
    only the surviving distinct window keys of a row reach the Arrow UDF (an
    empty list where the row is decided).
    """
    words = ws_tokens(value)
    n = F.size(words)
    plain = F.array_join(words, " ")
    padded = F.concat(F.lit(" "), _col(text), F.lit(" "))
    stands = (plain == _col(value)) & (plain != "") & (
        padded.contains(F.concat(F.lit(" "), plain, F.lit(" "))) | padded.contains(F.concat(F.lit(" "), plain, F.lit(". "))))
    toks = F.split(_col(text), " ")
    wins = F.transform(F.sequence(F.lit(1), F.size(toks)), lambda i: F.array_join(F.slice(toks, i, n), " "))
    vk = sort_key(value)
    none = F.array().cast("array<string>")
    wks = F.when(stands, none).otherwise(F.array_distinct(F.transform(wins, lambda w: sort_key(w))))
    exact = stands | F.array_contains(wks, vk)
    cands = F.filter(wks, lambda k: (k != vk) &
                     (F.least(F.length(k), F.length(vk)) * 2 >= (F.length(k) + F.length(vk)) * LENGTH_BOUND))
    return exact | any_ratio_udf(vk, F.when(exact, none).otherwise(cands))


def fuzzy_value_matches(pairs: DataFrame, key: list[str], text: str = "pred", value: str = "value") -> DataFrame:
    """C2 over a table of (key..., text, value): ``matched`` per row (one pass, no join)."""
    return pairs.select(*key, fuzzy_match(text, value).alias("matched"))


def ser_fuzzy_rows(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A4: three-valued fuzzy slot error per row (needs ``row_idx, pred, dialog_acts, perm``).

    Texts and values are lowercased first, as in the strict metric.
    """
    return slot_error_rows(rows.withColumn("pred", F.lower("pred")), lambda text, v: fuzzy_match(text, F.lower(v)), keep, "ser_fuzzy")


# ---------------------------------------------------------------- PARENT

def parent_one(pred: list, ref: list, table: list, lambda_weight: float = 0.5, smoothing: float = 1e-5,
               max_order: int = 4) -> tuple[float, float, float]:
    """PARENT precision, recall, F of one instance (Dhingra et al. 2019), table = [(attr, value_tokens)]."""
    strings = pa.list_(pa.string())
    a, b, v = AK.coded(pa.array([pred], strings), pa.array([ref], strings), pa.array([list(v) for _, v in table], strings))
    return tuple(AK.parent_scores(a, b, v, np.zeros(len(table), dtype=np.int64), lambda_weight, smoothing, max_order)[0].tolist())


PARENT_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "fscore")])


def make_parent_udf(lambda_weight: float = 0.5, smoothing: float = 1e-5, max_order: int = 4):
    @F.arrow_udf(PARENT_TYPE)
    def parent_udf(pred: pa.Array, ref: pa.Array, values: pa.Array) -> pa.Array:
        a, b, v = AK.coded(pred, ref, values.flatten())
        rows = np.repeat(np.arange(len(a)), AK.sizes_of(values))
        scores = AK.parent_scores(a, b, v, rows, lambda_weight, smoothing, max_order)
        return pa.StructArray.from_arrays([pa.array(scores[:, i]) for i in range(3)], names=PARENT_TYPE.fieldNames())
    return parent_udf


def act_table(acts) -> Column:
    """``(slot, value tokens)`` records: slot ``intent`` dropped, values split on whitespace,
    true/false tokens dropped, acts kept when they have a slot and tokens."""
    recs = F.transform(F.filter(_col(acts), lambda a: a["slot"] != "intent"), lambda a: F.struct(
        F.array(a["slot"]).alias("attr"),
        F.filter(F.flatten(F.transform(a["values"], lambda v: ws_tokens(v))),
                 lambda t: ~F.lower(t).isin("true", "false")).alias("value")))
    return F.filter(recs, lambda r: (r["attr"][0] != "") & (F.size(r["value"]) > 0))


def parent_rows(rows: DataFrame, lambda_weight: float = 0.5, smoothing: float = 1e-5, max_order: int = 4,
                ref_as_prediction: bool = True) -> DataFrame:
    """Per-row PARENT over rows with >= 1 reference token and >= 1 table record.

    ``ref_as_prediction`` keeps the original pipeline's argument order, which
    passes the reference text in the prediction slot and the prediction in the
    reference slot.  Scores are rounded half-even to 3 places (C8).
    """
    x = rows.select("row_idx", ws_tokens("ref").alias("ref_tokens"), ws_tokens("pred").alias("pred_tokens"),
                    act_table("dialog_acts").alias("table"))
    x = x.filter((F.size("ref_tokens") >= 1) & (F.size("table") >= 1))
    a, b = ("ref_tokens", "pred_tokens") if ref_as_prediction else ("pred_tokens", "ref_tokens")
    udf = make_parent_udf(lambda_weight, smoothing, max_order)
    s = x.withColumn("p", udf(a, b, F.transform("table", lambda r: r["value"])))
    return s.select("row_idx", "ref_tokens", "pred_tokens", "table",
                    F.col("p.precision").alias("parent_precision"), F.col("p.recall").alias("parent_recall"),
                    F.col("p.fscore").alias("parent_fscore"))
