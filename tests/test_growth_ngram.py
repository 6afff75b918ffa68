"""N-gram statistics: the n-grams of a row never become rows of a table."""

import pyarrow as pa

from turnlens.operators import ngram as N


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_never_become_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c x e"), (2, None, "q"), (3, "", "")], "row_idx long, ref string, pred string")
    for stats in (N.bleu_row_stats(df), N.rouge_n_rows(df)):
        assert "Generate" not in plan(stats)
        assert plan(stats).count("Exchange hashpartitioning") == 1
        assert {r["row_idx"] for r in stats.collect()} == {1, 3}


def test_rows_of_one_key_count_together(spark):
    rows = [(1, "a b", "b a"), (1, "b a", "a b"), (1, "a b c", "a b c"), (2, "a b", "b a"), (None, "x x", "x y"), (None, "x x", "y x")]
    df = spark.createDataFrame(rows, "row_idx long, ref string, pred string")
    got = sorted((r["row_idx"] or 0, r["hyp_len"], r["h1"], r["m1"], r["m2"], r["m3"]) for r in N.bleu_row_stats(df).collect())
    assert got == [(0, 2, 2, 2, 0, 0), (1, 2, 2, 4, 2, 0), (1, 3, 3, 3, 2, 1), (2, 2, 2, 2, 0, 0)]


def test_parts_of_a_batch_keep_their_groups(monkeypatch):
    rows = [(i // 2, "a b a c " * (i % 3), "a c a b " * (i % 2 + 1)) for i in range(60)]
    fn = N._counts_udf([1, 2, 3, 4]).func
    monkeypatch.setattr(N, "PART_TOKENS", 7)
    texts = pa.array([[{"r": r.split(), "h": h.split()} for i, r, h in rows if i == k] for k in range(30)])
    small = fn(texts).to_pylist()
    monkeypatch.setattr(N, "PART_TOKENS", 10**9)
    assert small == fn(texts).to_pylist()
