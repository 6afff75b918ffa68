"""Bootstrap sums: the weights of a row never become rows of a table."""

from turnlens.operators import bootstrap as B


def test_replicate_weights_are_not_rows(spark):
    df = spark.createDataFrame([(1, 0.5, None), (None, float("inf"), 2.0), (3, 0.25, 1.0)], "k long, a double, b double")
    sums = B.bootstrap_sums(df, "k", ["a", "b"], 40)
    assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()
    got = {r["replicate"]: r for r in sums.collect()}
    weights = B.replicate_weights(["1", "", "3"], 40, B.SEED)
    assert set(got) == {i for i in range(40) if weights[:, i].any()}
    for i, r in got.items():
        w1, w2, w3 = (int(x) for x in weights[:, i])
        assert r["n_a"] == w1 + w2 + w3 and r["n_b"] == (w2 + w3 or None)
        assert r["sum_a"] == (float("inf") if w2 else w1 * 0.5 + w3 * 0.25)
        assert r["sum_b"] == (2.0 * w2 + w3 if w2 + w3 else None)
