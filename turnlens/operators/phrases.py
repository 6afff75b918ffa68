"""Slot-indicative phrase mining.

Level-wise mining of gapped token patterns in the sentences of turns that
carry a slot.  Semantics (one pass per level):

* sentence = ``target.split('.')``, token = ``sentence.split(' ')``;
* ``first_pos(root) = -1``; ``first_pos(p + t)`` = first ``j > first_pos(p)`` with
  ``tok[j] = t``; ``t`` must differ from ``last(p)`` (the root's token is ``''``);
* ``count(p + t)`` = number of positions ``j > first_pos(p)`` with ``tok[j] = t``
  over all sentences (every occurrence counts);
* prune: keep ``count > min_count``, rank, keep the ``top_k`` best per parent
  with rank > 0 (ties by token ascending).

Spark plan per level: a row holds one sentence's tokens and one pattern active
in it (``toks, pid, fp, last``).  Exploding the tokens after ``fp`` gives the
extensions, one group-by with map-side combine counts them, and a window keeps
the top-k per parent: at most ``top_k ** level`` rows, which are checkpointed.
Joined back to the rows on the pattern they give the next level's rows; a
sentence's tokens are never joined again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.operators.analysis import acts_long, slot_value_tokens, unigram_freq
from turnlens.session import checkpoint_dir

#: Patterns that are sent to every task; more are joined by a shuffle.
MOST_PATTERNS = 100_000

RankFn = Callable[[DataFrame], DataFrame]


def example_sentences(turns: DataFrame, slot: str) -> tuple[DataFrame, DataFrame]:
    """Token arrays ``toks`` of the examples' sentences (one example per act carrying ``slot``), and the examples."""
    ex = acts_long(turns).filter(F.col("slot") == slot).select("turn_key", "act_pos", "target")
    sents = ex.select(F.explode(F.split("target", "[.]")).alias("s"))
    return sents.select(F.split("s", " ").alias("toks")), ex


def bayes_rank(turns: DataFrame, slot: str, n_examples: int, min_unigram: int = 20) -> RankFn:
    """M2 as a ranking function over candidate extensions.

    ``rank = (count / n_examples) * P(slot) / prod(P(token))``; -1 when a token is
    rare (< ``min_unigram``), unknown or one of the slot's value tokens.
    Input columns: ``count, prod`` (product of the parent's token
    probabilities), ``tok``; adds ``rank`` and the new ``prod``.
    """
    checkpoint_dir(turns.sparkSession)
    uni = unigram_freq(turns).select(F.col("token").alias("tok"), F.col("count").alias("ucount"),
                                     F.col("freq").alias("ufreq")).checkpoint()
    vals = slot_value_tokens(turns).filter(F.col("slot") == slot).select(F.col("token").alias("tok"),
                                                                          F.lit(True).alias("is_value"))
    p_slot = n_examples / max(turns.count(), 1)   # one example per act carrying the slot

    def rank(c: DataFrame) -> DataFrame:
        x = c.join(uni, "tok", "left").join(vals, "tok", "left")
        bad = F.col("ucount").isNull() | (F.col("ucount") < min_unigram) | F.coalesce("is_value", F.lit(False))
        prod = F.col("prod") * F.col("ufreq")
        return x.withColumn("rank", F.when(bad, F.lit(-1.0)).otherwise((F.col("count") / n_examples) * p_slot / prod)) \
            .withColumn("prod", F.when(bad, F.lit(None)).otherwise(prod)) \
            .drop("ucount", "ufreq", "is_value")

    return rank


def top_k_per_parent(c: DataFrame, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` best candidates per parent (rank desc, token asc), skew-safe.

    A parent can have a huge candidate list (at level 1 the root's candidates
    are the whole vocabulary), so the top-k is taken first inside
    ``(parent, hash(token) % salts)`` and then over the at most ``k * salts``
    survivors of each parent.  The result is exactly the global top-k.
    """
    order = [F.desc("rank"), F.col("tok")]
    salted = c.withColumn("_salt", F.pmod(F.xxhash64("tok"), F.lit(salts)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("pid", "_salt").orderBy(*order))) \
        .filter(F.col("_r") <= k).drop("_r", "_salt")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("pid").orderBy(*order))) \
        .filter(F.col("_r") <= k).drop("_r")


def mine_patterns(turns: DataFrame, slot: str, n_grams: int = 4, min_count: int = 10, top_k: int = 5,
                  rank: RankFn | None = None) -> DataFrame:
    """M1 + M3: all kept patterns ``(pattern, level, count, rank)``, root ``('', 0, 0, 0)`` included.

    ``rank`` (X2) maps a candidate table (``pid, tok, count, prod``) to one
    with a ``rank`` column; the default is :func:`bayes_rank`.
    """
    spark = turns.sparkSession
    checkpoint_dir(spark)
    # Statistics, examples and ranks all read the turns: keep them for the run
    # (a lost executor recomputes its blocks from lineage).
    turns = turns.persist()
    toks, ex = example_sentences(turns, slot)
    toks = toks.checkpoint()
    rank = rank or bayes_rank(turns, slot, ex.count())
    # root: every sentence, pattern [] (pid ''), first position -1, last token ''
    state = toks.select("toks", F.lit("").alias("pid"), F.lit(-1).alias("fp"), F.lit("").alias("last"))
    front = spark.range(1).select(F.lit("").alias("pid"), F.array().cast("array<string>").alias("pattern"),
                                  F.lit(1.0).alias("prod"))
    levels = [spark.range(1).select(F.lit("").alias("pattern"), F.lit(0).alias("level"),
                                    F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("rank"))]
    rest = F.slice("toks", F.col("fp") + 2, F.size("toks"))
    for level in range(1, n_grams + 1):
        ext = state.select("pid", "last", F.explode(rest).alias("tok")).filter(F.col("tok") != F.col("last"))
        cand = ext.groupBy("pid", "tok").agg(F.count(F.lit(1)).alias("count")) \
            .filter(F.col("count") > min_count).join(front, "pid")
        ranked = rank(cand)
        kept = top_k_per_parent(ranked.filter(F.col("rank") > 0), top_k) \
            .select("pid", "tok", "count", "rank", "prod", F.concat("pattern", F.array("tok")).alias("pattern"))
        kept = kept.withColumn("npid", F.array_join("pattern", "\u0001")).checkpoint()
        levels.append(kept.select(F.array_join("pattern", " ").alias("pattern"), F.lit(level).alias("level"),
                                  "count", "rank"))
        if level == n_grams:
            break
        at = F.array_position(rest, F.col("tok")).cast("int")   # 1-based, 0: not there
        state = state.join(kept.select("pid", "tok", "npid"), "pid") \
            .select("toks", F.col("npid").alias("pid"), "fp", at.alias("at"), F.col("tok").alias("last")) \
            .filter(F.col("at") > 0).select("toks", "pid", (F.col("fp") + F.col("at")).alias("fp"), "last")
        front = kept.select(F.col("npid").alias("pid"), "pattern", "prod")
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    turns.unpersist()   # every level is checkpointed, so the result no longer needs them
    return out


def active_patterns(sentences: DataFrame, patterns: DataFrame, toks: str = "toks") -> DataFrame:
    """M3 ``get_current_patterns`` for a table: ``sentences``' columns but the tokens, ``pattern, count`` of every active pattern.

    A kept pattern is active at the end of a sentence if its tokens occur in order by the greedy
    first-position rule, so it is active only where its parent (all tokens but the last) is. Level by level
    the sentences meet the extensions of their active patterns. The patterns are a bounded table
    (``top_k ** level`` at a level) whose size is measured: up to ``MOST_PATTERNS`` it is broadcast, since all
    sentences share the root; a larger one is joined on the parent and the token, which spreads the root.
    """
    keep = [c for c in sentences.columns if c != toks]
    kept = patterns.filter(F.col("level") > 0).select("pattern", "level", "count", F.split("pattern", " ").alias("_p")) \
        .select("pattern", "level", "count", F.array_join(F.slice("_p", F.lit(1), F.size("_p") - 1), " ").alias("_parent"),
                F.element_at("_p", -1).alias("_tok"))
    checkpoint_dir(sentences.sparkSession)
    kept = kept.checkpoint()
    levels = [r["level"] for r in kept.select("level").distinct().orderBy("level").collect()]  # one row a level
    few = kept.count() <= MOST_PATTERNS
    state = sentences.select(*keep, F.col(toks).alias("_toks"), F.lit("").alias("_pid"), F.lit(-1).alias("_fp"))
    out = None
    rest = F.slice("_toks", F.col("_fp") + 2, F.size("_toks"))
    for level in levels:
        step = kept.filter(F.col("level") == level).drop("level")
        if few:
            met = state.join(F.broadcast(step), state["_pid"] == step["_parent"])
        else:
            tokens = state.withColumn("_next", F.explode(F.array_distinct(rest)))
            met = tokens.join(step, (tokens["_pid"] == step["_parent"]) & (tokens["_next"] == step["_tok"])).drop("_next")
        at = F.array_position(rest, F.col("_tok")).cast("int")
        state = met.withColumn("_at", at).filter(F.col("_at") > 0) \
            .select(*keep, "_toks", F.col("pattern").alias("_pid"), (F.col("_fp") + F.col("_at")).alias("_fp"), "count")
        found = state.select(*keep, F.col("_pid").alias("pattern"), "count")
        out = found if out is None else out.unionByName(found)
        state = state.drop("count")
    none = sentences.select(*keep, F.lit("").alias("pattern"), F.lit(0).cast("long").alias("count")).filter(F.lit(False))
    return none if out is None else out


def current_patterns(tokens: list[str], patterns: DataFrame) -> DataFrame:
    """M3 ``get_current_patterns``: kept patterns active at the end of one text.

    A pattern is active when its tokens occur in order with the greedy
    first-position rule; the text is a literal array, so no join is needed.
    """
    toks = F.array(*[F.lit(x) for x in tokens]).cast("array<string>")
    pt = F.split("pattern", " ")

    def step(acc, tok):
        j = F.array_position(F.slice(toks, acc + 2, F.greatest(F.size(toks), F.lit(1))), tok).cast("int")
        return F.when(acc == -2, F.lit(-2)).when(j == 0, F.lit(-2)).otherwise(acc + j)

    fp = F.aggregate(pt, F.lit(-1), step)
    return patterns.filter(F.col("level") > 0).select("pattern", "count", fp.alias("fp")) \
        .filter(F.col("fp") >= 0).drop("fp")
