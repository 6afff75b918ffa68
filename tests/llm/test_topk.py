"""Exact top-k search against brute force, with pruning at work."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.llm import topk_search
from turnlens.llm.topk_search import Block, search_block, top_k


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, q in ok:
        if qi % every == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi))[:k]
            out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, v string")


@pytest.mark.parametrize("spread, first", [(0.0, 1 << 18), (1.5, 1 << 18), (1.5, 20)])
def test_as_brute_force(spark, monkeypatch, spread, first):
    monkeypatch.setattr(topk_search, "FIRST_GROUP", first)
    monkeypatch.setattr(topk_search, "GROWTH", 2)
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 8)
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] * math.exp(spread * r.normal()) + 0.2 * r.normal(size=12)).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(15)]  # ties
    rows += [(800, None), (900, [1.0, None]), (1000, [float("nan")]), (1100, [float("inf")]), (None, [1.0] * 12), (1200, [0.0] * 12),
             (1300, []), (1400, [0.5])]
    got = {tuple(x) for x in top_k(vectors(spark, rows), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), 10).collect()}
    assert got == brute(rows, 10, 20)


def test_fewer_than_k_repeats_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    got = [tuple(x) for x in top_k(vectors(spark, rows), F.col("vec_id") == 0, 10).orderBy("rank").collect()]
    assert [(g[0], g[2], g[3]) for g in got] == [(0, 1, 1572864), (0, 1, 1572864), (0, 2, -1048576)]
    assert top_k(vectors(spark, rows).where("false"), F.col("vec_id") == 0, 10).count() == 0


def test_pruning_leaves_little(monkeypatch):
    r = np.random.default_rng(2)
    x = (r.normal(size=(3000, 8)) * 1000).astype(np.int64)
    q = np.zeros(8, dtype=np.int64)
    q[3] = 5000
    block = Block(np.arange(3000), x)
    best = np.sort(x @ q)[-10]
    part = block.by_coordinate(q, 5000.0, float(best))
    assert part is not None and len(part) < 0.25 * 3000 and set(block.ids[part]) >= set(np.flatnonzero(x @ q >= best))
    n = block.by_length(5000.0, float(best))
    assert set(block.ids[:n]) >= set(np.flatnonzero(x @ q >= best))
    assert topk_search.products(np.array([[2**40]]), np.array([[2**20]]))[0, 0] == 2**60
    assert search_block.__doc__


def test_candidates_go_only_where_they_are_asked_for(spark, monkeypatch):
    """With ten times the rows of short vectors the pairs that are shuffled stay the same."""
    monkeypatch.setattr(topk_search, "BLOCK", 32)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "FIRST_GROUP", 40)
    r = np.random.default_rng(6)
    seen = []
    real = topk_search.dealt

    def counting(base, queries, group):
        cands, asked = real(base, queries, group)
        seen.append(cands.count())
        return cands, asked

    monkeypatch.setattr(topk_search, "dealt", counting)
    monkeypatch.setattr(topk_search, "SEEDS", 4)
    sent = []
    long = [(20 * i, (40 * r.normal(size=6) + 60).tolist()) for i in range(12)]
    for n in (300, 3000):
        rows = long + [(1001 + 20 * i + i % 19, (0.02 * r.normal(size=6)).tolist()) for i in range(n)]
        seen.clear()
        got = {tuple(x) for x in top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 3).collect()}
        assert got == brute(rows, 3, 20)
        sent.append(sum(seen))
    assert max(sent) <= 12 * 3  # the long vectors, once for each block of queries


def test_a_repeated_id_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    rows = [(7, [1.0, float(i % 50)]) for i in range(400)] + [(20, [1.0, 1.0]), (21, [0.5, 2.0])]
    got = {tuple(x) for x in top_k(vectors(spark, rows), F.col("vec_id") == 20, 5).collect()}
    assert got == brute(rows, 5, 20)
    base = spark.range(400).select(F.pmod(F.xxhash64("id"), F.lit(25)).alias("b")).groupBy("b").count()
    assert base.count() == 25 and max(x["count"] for x in base.collect()) < 40
    with pytest.raises(Exception, match="64 bits"):
        top_k(vectors(spark, [(20, [1e9, 1e9]), (1, [1e9, 1e9])]), F.col("vec_id") == 20, 2).collect()
