"""Analysis operators: corpus statistics, unseen entities, dataset diff, run comparison,
bad-case mining, sorting / sampling and reshaping (A13-A22, J6-J12, O1-O6, U2-U5, P11, P12, P15).

Global totals (a denominator over the whole table) are scalar subqueries
(``DataFrame.scalar()``): computed once with partial aggregation and used as a
literal, never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.functions.columns import decode_acts, domain_of, seeded_hash, sp_tokens


def acts_long(turns: DataFrame, named: bool = True) -> DataFrame:
    """One row per act: turn columns + ``act_pos, act, slot, values``."""
    a = decode_acts("dialog_acts") if named else F.col("dialog_acts")
    keep = [c for c in turns.columns if c != "dialog_acts"]
    return turns.select(*keep, F.posexplode(a).alias("act_pos", "a")) \
        .select(*keep, "act_pos", "a.act", "a.slot", "a.values")


def slot_examples(turns: DataFrame, slot: str) -> DataFrame:
    """Turns having ``slot``, once per matching act (no distinct)."""
    return acts_long(turns).filter(F.col("slot") == slot).select(*[c for c in turns.columns if c != "dialog_acts"])


# ---------------------------------------------------------------- bad cases

CRITERIA = ("has_slot_error", "ser_fuzzy", "parent_precision", "parent_recall")


def bad_cases(rows: DataFrame, by: str = "has_slot_error", limit: int = 0) -> DataFrame:
    """Bad cases by a criterion; ``limit <= 0`` keeps all.

    By an error flag: the flagged rows in row order.  By a PARENT score: all
    rows, worst first, nulls last, ties by row.  Other criteria are an error.
    """
    if by not in CRITERIA:
        raise ValueError(f"unknown criterion for bad cases: {by}; one of {', '.join(CRITERIA)}")
    if by.startswith("parent"):
        return bad_cases_sorted(rows, by, limit)
    out = rows.filter(F.col(by)).orderBy("row_idx")
    return out.limit(limit) if limit > 0 else out


def bad_cases_sorted(rows: DataFrame, by: str, limit: int = 0) -> DataFrame:
    """O2: worst rows by a score ascending, nulls last, ties by row key; ``limit <= 0`` keeps all."""
    out = rows.orderBy(F.col(by).asc_nulls_last(), "row_idx")
    return out.limit(limit) if limit > 0 else out


def bad_cases_of_domain(rows: DataFrame, domain: str, cols: list[str], n: int = 20) -> DataFrame:
    """Slot errors of one domain, chosen columns, first ``n`` rows."""
    return rows.filter(F.col("has_slot_error") & (F.col("domain") == domain)).orderBy("row_idx").select(*cols).limit(n)


# ---------------------------------------------------------------- corpus statistics

def unigram_freq(turns: DataFrame) -> DataFrame:
    """``token, count, freq`` over ``target.split(' ')`` (unsplit on dots)."""
    toks = turns.select(F.explode(sp_tokens("target")).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    total = turns.select(F.sum(F.size(sp_tokens("target")))).scalar()
    return counts.withColumn("freq", F.col("count") / total)


def slot_freq(turns: DataFrame) -> DataFrame:
    """``slot, count, freq`` — acts per slot over the number of turns (may exceed 1)."""
    counts = acts_long(turns).groupBy("slot").agg(F.count(F.lit(1)).alias("count"))
    n_turns = turns.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("freq", F.col("count") / n_turns)


def slot_value_tokens(turns: DataFrame) -> DataFrame:
    """Distinct ``(slot, token)`` over space-split slot values."""
    a = acts_long(turns).select("slot", F.explode("values").alias("v"))
    return a.select("slot", F.explode(F.split("v", " ")).alias("token")).distinct()


# ---------------------------------------------------------------- entities

def entity_rows(turns: DataFrame, perm: DataFrame) -> DataFrame:
    """Lowercased values of permissible slots, one row per (act, value): ``split, domain, turn_key, act_pos, value``.

    ``perm`` is ``permissible_slots`` (one row per service).
    """
    a = acts_long(turns).join(perm.withColumnRenamed("slots", "perm"), "service", "left")
    a = a.filter(F.coalesce(F.array_contains("perm", F.col("slot")), F.lit(False)))
    return a.select("split", domain_of("service").alias("domain"), "turn_key", "act_pos",
                    F.explode("values").alias("v")).withColumn("value", F.lower("v")).drop("v")


def entity_counts(ents: DataFrame) -> DataFrame:
    """``split, value, count``."""
    return ents.groupBy("split", "value").agg(F.count(F.lit(1)).alias("count"))


def entity_distinct(ents: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct entities per split (exact, or HyperLogLog++ with ``approx``)."""
    f = F.approx_count_distinct("value") if approx else F.countDistinct("value")
    return ents.groupBy("split").agg(f.alias("n_entities"))


def unseen_entities(ents: DataFrame, test: str = "test", train: str = "train") -> DataFrame:
    """Values seen in ``test`` but never in ``train`` (left-anti)."""
    t = ents.filter(F.col("split") == test).select("value").distinct()
    tr = ents.filter(F.col("split") == train).select("value")
    return t.join(tr, "value", "left_anti")


def unseen_occurrences(ents: DataFrame, unseen: DataFrame, test: str = "test") -> DataFrame:
    """Test occurrences of test-only values (left-semi)."""
    return ents.filter(F.col("split") == test).join(unseen, "value", "left_semi")


def unseen_totals(ents: DataFrame, unseen: DataFrame, test: str = "test") -> DataFrame:
    """Distinct unseen values, their test occurrences, all test occurrences (one row)."""
    t = ents.filter(F.col("split") == test).join(unseen.withColumn("u", F.lit(True)), "value", "left")
    return t.agg(F.countDistinct(F.when(F.col("u"), F.col("value"))).alias("n_unseen"),
                 F.count_if(F.coalesce("u", F.lit(False))).alias("unseen_occurrences"),
                 F.count(F.lit(1)).alias("all_occurrences"))


def unseen_by_domain(ents: DataFrame, unseen: DataFrame, test: str = "test") -> DataFrame:
    """Per domain — acts with >= 1 unseen value, unseen occurrences, distinct unseen values."""
    occ = unseen_occurrences(ents, unseen, test)
    return occ.groupBy("domain").agg(
        F.countDistinct("turn_key", "act_pos").alias("unseen_acts"),
        F.count(F.lit(1)).alias("occurrences"),
        F.countDistinct("value").alias("n_entities"))


def unseen_entity_set(ents: DataFrame, unseen: DataFrame, test: str = "test") -> DataFrame:
    """The sets themselves: every unseen value of each domain with its occurrences, one row each.

    Values are counted before they meet the set of unseen ones, so a frequent value is one row of the join.
    """
    counts = ents.filter(F.col("split") == test).groupBy("domain", "value").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(unseen, "value", "left_semi").select("domain", "value", "occurrences")


#: Registers of an entity sketch as a power of two: a standard error of 1.04 / sqrt(2 ** 12), about 1.6 %.
SKETCH_BITS = 12


def entity_sketches(ents: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``split, domain, sketch``: one HyperLogLog sketch of the values of each split and domain.

    Sketches are kept as a table; those of further turns, splits or domains are merged without the turns.
    """
    return ents.groupBy("split", "domain").agg(F.hll_sketch_agg("value", bits).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged over everything but ``by``, with the estimated number of distinct values."""
    m = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return m.withColumn("estimate", F.hll_sketch_estimate("sketch"))


def unseen_ratio(ents: DataFrame, unseen: DataFrame, test_turns: DataFrame, test: str = "test") -> DataFrame:
    """Acts with an unseen value / number of test turns (two scalars)."""
    n_acts = unseen_occurrences(ents, unseen, test).select(F.countDistinct("turn_key", "act_pos")).scalar()
    n_turns = test_turns.select(F.count(F.lit(1))).scalar()
    return test_turns.sparkSession.range(1).select(
        n_acts.alias("unseen_acts"), n_turns.alias("test_turns"), (n_acts / n_turns).alias("ratio"))


def top_entities(counts: DataFrame, n: int) -> DataFrame:
    """O1: the ``n`` most frequent values (ties by value) — a top-k report."""
    return counts.orderBy(F.desc("count"), "value").limit(n)


# ---------------------------------------------------------------- dataset diff

def turn_positions(raw_turns: DataFrame) -> DataFrame:
    """W2 + W1: system turns with their original position and 1-based system ordinal."""
    w = Window.partitionBy("dialog_id").orderBy("pos")
    return raw_turns.filter(F.col("speaker") == "SYSTEM").withColumn("ordinal", F.row_number().over(w))


def dataset_diff(prepared: DataFrame, raw_turns: DataFrame) -> DataFrame:
    """Prepared target vs the original n-th system utterance.

    ``status`` is ``same``, ``diff`` or ``missing`` (no such ordinal).  The
    compared original utterance is the one reported.
    """
    orig = turn_positions(raw_turns).select("dialog_id", F.col("ordinal").cast("bigint").alias("turn_id"),
                                            F.col("utterance").alias("original"))
    j = prepared.join(orig, ["dialog_id", "turn_id"], "left")
    status = (F.when(F.col("original").isNull(), "missing")
              .when(F.col("original") != F.col("target"), "diff").otherwise("same"))
    return j.select("dialog_id", "turn_id", "target", "original", status.alias("status"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """Sizes of the diff and missing lists."""
    return diff.agg(F.count_if(F.col("status") == "diff").alias("n_diff"),
                    F.count_if(F.col("status") == "missing").alias("n_missing"),
                    F.count(F.lit(1)).alias("n_rows"))


def dialog_regroup(raw_turns: DataFrame) -> DataFrame:
    """Dialogue -> system utterances in order, with their original positions.

    Each group is one conversation (bounded by dialogue length).
    """
    s = raw_turns.filter(F.col("speaker") == "SYSTEM")
    g = s.groupBy("dialog_id").agg(F.sort_array(F.collect_list(F.struct("pos", "utterance"))).alias("xs"))
    return g.select("dialog_id", F.transform("xs", lambda x: x["pos"]).alias("positions"),
                    F.transform("xs", lambda x: x["utterance"]).alias("utterances"))


# ---------------------------------------------------------------- runs

def compare_runs(base: DataFrame, others: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """The reference run's rows plus each other run's ``cols`` as ``<col>_<run>`` (left joins on row_idx)."""
    out = base
    for name, df in others.items():
        out = out.join(df.select("row_idx", *[F.col(c).alias(f"{c}_{name}") for c in cols]), "row_idx", "left")
    return out


def metric_filter(run: DataFrame, base: DataFrame) -> DataFrame:
    """Keep the metrics of ``run`` that the base table has (left-semi on metric name)."""
    return run.join(base.select("metric"), "metric", "left_semi")


def metric_compare(base: DataFrame, run: DataFrame, run_name: str) -> DataFrame:
    """Add one run's metric column to a baseline ``(metric, ...)`` table, joined on metric name."""
    return base.join(metric_filter(run, base).select("metric", F.col("value").alias(run_name)), "metric", "left")


def case_lookup(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Annotated rows of the given case keys (equi join on row_idx)."""
    return rows.join(cases.select("row_idx").distinct(), "row_idx")


def take_idx(rows: DataFrame, idx: list[int]) -> DataFrame:
    """Rows whose key is in a given (short, user-supplied) list."""
    return rows.filter(F.col("row_idx").isin(list(idx)))


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """A24 building block: one aggregate pass -> long ``(metric, value)`` rows."""
    one = df.agg(*[c.cast("double").alias(k) for k, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value")


def domain_union(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack several runs' domain tables with a ``model_name`` column."""
    out = None
    for name, df in tables.items():
        x = df.withColumn("model_name", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def domain_pivot(long: DataFrame, value: str, domains: list[str] | None = None) -> DataFrame:
    """Long ``(metric, domain, value)`` -> one column per domain; with ``domains`` no job looks for them first."""
    return long.groupBy("metric").pivot("domain", domains).agg(F.first(value))


# ---------------------------------------------------------------- ordering / sampling

def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Seeded, repeatable shuffle: a distributed sort on ``md5(key:seed)``."""
    return df.orderBy(seeded_hash(key, seed), key)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, seeded (top-n of a hash order; no driver loop)."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)
