"""Slot error rate.

A slot error is a value of a permissible (non-categorical) slot that the
prediction does not contain.  The check is a row-local higher-order
expression (``exists`` over acts x values), so the only exchange in a SER
query is the one that brings decodes and turns together on the row key, plus
tiny final aggregates with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.functions.columns import _col, contains_ci, domain_of

Match = Callable[[Column, Column], Column]


def permissible_slots(schema_slots: DataFrame) -> DataFrame:
    """A1: ``service, slots ARRAY<STRING>`` — non-categorical slots of any split's schema (a set)."""
    return (schema_slots.filter(~F.col("is_categorical"))
            .groupBy("service").agg(F.array_sort(F.collect_set("slot")).alias("slots")))


def _perm_values(acts, perm) -> Column:
    p = F.coalesce(_col(perm), F.array().cast("array<string>"))
    return F.filter(_col(acts), lambda a: F.array_contains(p, a["slot"]))


def slot_error(acts, pred, perm, match: Match = contains_ci) -> Column:
    """A2: true if some permissible value is not matched in the prediction.

    ``match(pred, value)`` is the pluggable containment test (X1), a native
    column expression; the default is case-insensitive substring (C1).  For
    UDF predicates see :func:`slot_error_rows`.  A service without schema has no
    permissible slots (never an error).
    """
    return F.exists(_perm_values(acts, perm),
                    lambda a: F.exists(a["values"], lambda v: ~match(_col(pred), v)))


def slot_error_3v(acts, pred, perm, match: Match = contains_ci) -> Column:
    """A5: like A2 but null when the turn has no permissible value at all."""
    has = F.exists(_perm_values(acts, perm), lambda a: F.size(a["values"]) > 0)
    return F.when(has, slot_error(acts, pred, perm, match))


def join_decodes(decodes: DataFrame, turns: DataFrame, strict: bool = True) -> DataFrame:
    """Decode rows meet their test turns on the row key (``row_idx = turn_key``).

    With ``strict`` every decode needs its turn and every turn its decode: the
    join is a full outer join, and a row without a partner raises when the plan
    runs.  Otherwise rows without a partner are left out.
    """
    t = turns.withColumnRenamed("turn_key", "row_idx")
    keep = [c for c in t.columns if c not in decodes.columns or c == "row_idx"]
    if not strict:
        return decodes.join(t.select(*keep), "row_idx")
    both = decodes.withColumn("_decode", F.lit(True)).join(t.select(*keep, F.lit(True).alias("_turn")), "row_idx", "full")
    return both.where(both_sides("row_idx", "_decode", "_turn")).drop("_decode", "_turn")


def both_sides(key: str, left: str, right: str) -> Column:
    """True where both sides of a full outer join are there; a row without a partner is an error."""
    lone = F.concat(F.lit("no partner on the other side for row "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), F.lit(True)).otherwise(F.raise_error(lone).cast("boolean"))


def with_permissible(df: DataFrame, schema_slots: DataFrame) -> DataFrame:
    """Attach the service's permissible slot array (one row per service; AQE picks the join)."""
    return df.join(permissible_slots(schema_slots).withColumnRenamed("slots", "perm"), "service", "left")


def annotate_ser(decodes: DataFrame, turns: DataFrame, schema_slots: DataFrame,
                 match: Match = contains_ci) -> DataFrame:
    """Row table: decodes + acts + ``domain, has_slot_error, ser_applicable``."""
    return annotate_rows(join_decodes(decodes, turns), schema_slots, match)


def annotate_rows(rows: DataFrame, schema_slots: DataFrame, match: Match = contains_ci) -> DataFrame:
    """SER flags for rows that already carry ``service, dialog_acts, pred``."""
    j = with_permissible(rows, schema_slots)
    return j.select("*", domain_of("service").alias("domain"),
                    slot_error("dialog_acts", "pred", "perm", match).alias("has_slot_error"),
                    slot_error_3v("dialog_acts", "pred", "perm", match).alias("ser_applicable"))


def ser_rate(flag: Column) -> Column:
    """Mean of a boolean flag (cast, since ``avg`` rejects booleans)."""
    return F.avg(flag.cast("int"))


def ser_by(rows: DataFrame, by: list[str] | None, flag: str = "has_slot_error",
           coalesce_null: bool = False) -> DataFrame:
    """SER mean grouped by ``by`` (None = overall); nulls excluded unless ``coalesce_null``."""
    f = F.col(flag)
    if coalesce_null:
        f = F.coalesce(f, F.lit(False))  # P14
    agg = ser_rate(f).alias("ser")
    return rows.groupBy(*(by or [])).agg(agg)


def ser_by_tag(rows: DataFrame, tag_col: str = "tag") -> DataFrame:
    """Overall and per-tag error rate, x100, via ``rollup``; rows without a tag are a null row of their own."""
    r = rows.rollup(tag_col).agg((F.avg(F.col("has_slot_error").cast("int")) * 100).alias("ser"),
                                 F.grouping(tag_col).alias("_total"))
    return r.select(F.when(F.col("_total") == 1, F.lit("overall")).otherwise(F.col(tag_col)).alias(tag_col), "ser")


def slot_error_rows(rows: DataFrame, matched: Match, keep: list[str] | None = None, out: str = "slot_error") -> DataFrame:
    """X1 with any predicate: three-valued slot error per row (needs ``row_idx, pred, dialog_acts, perm``).

    Values are exploded, so ``matched(pred, value)`` may be a Python or pandas
    UDF, which a higher-order function cannot call; rows without a permissible
    value stay, with null.  The regrouping is on the row key, which is already
    the partitioning key of the turn table.
    """
    keep = keep or []
    vals = F.flatten(F.transform(_perm_values("dialog_acts", "perm"), lambda a: a["values"]))
    x = rows.select("row_idx", *keep, "pred", F.posexplode_outer(vals).alias("_vi", "_value"))
    m = x.select("row_idx", *keep, F.when(F.col("_value").isNotNull(), matched(F.col("pred"), F.col("_value"))).alias("_matched"))
    return m.groupBy("row_idx", *keep).agg(F.bool_or(~F.col("_matched")).alias(out))


class RowMetric:
    """A row metric with a column result and grouped summaries.

    ``row(df)`` returns the per-row ``Column``; ``summary(df, by)`` the mean
    per group (or overall); ``full(df)`` the table with the metric column.
    """

    def __init__(self, name: str, row: Callable[[DataFrame], Column]):
        self.name, self._row = name, row

    def row(self, df: DataFrame) -> Column:
        return self._row(df).alias(self.name)

    def full(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, self._row(df))

    def column(self, df: DataFrame) -> DataFrame:
        return df.select(self.row(df))

    def summary(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        v = self._row(df)
        v = v.cast("int") if dict(df.select(v.alias("x")).dtypes)["x"] == "boolean" else v
        return df.groupBy(*(by or [])).agg(F.avg(v).alias(self.name))


def ser_metric(name: str = "ser-strict", match: Match = contains_ci) -> RowMetric:
    """SER as a :class:`RowMetric` over an annotated table (needs dialog_acts, pred, perm)."""
    return RowMetric(name, lambda df: slot_error_3v("dialog_acts", "pred", "perm", match))
