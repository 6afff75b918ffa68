"""Bootstrap weights and intervals against the same definition in plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.operators import bootstrap as B


def weight(seed, key, replicate):
    digest = hashlib.md5(f"{seed}:{key}:{replicate // 4}".encode()).hexdigest()
    u = int(digest[8 * (replicate % 4):8 * (replicate % 4) + 8], 16) / 2**32
    k, p = 0, math.exp(-1)
    total = p
    while u >= total and k < 12:
        k += 1
        p /= k
        total += p
    return k


def rows(spark):
    return spark.createDataFrame([(i, (i * 37 % 101) / 101, None if i % 7 == 0 else i / 300) for i in range(300)], "k long, a double, b double")


def test_as_plain_replicates(spark):
    df = rows(spark)
    got = {r["metric"]: (r["low"], r["mid"], r["high"]) for r in B.bootstrap(df, "k", {"a": "A", "b": "B"}, 98, 0.9, seed=5).collect()}
    data = [(r["k"], r["a"], r["b"]) for r in df.collect()]
    for name, at in (("A", 1), ("B", 2)):
        means = []
        for rep in range(98):
            w = [(weight(5, r[0], rep), r[at]) for r in data if r[at] is not None]
            means.append(sum(x * v for x, v in w) / sum(x for x, _ in w))
        assert got[name] == pytest.approx(tuple(np.percentile(means, [5, 50, 95])))
    true = sum(r[1] for r in data) / 300
    assert got["A"][0] < true < got["A"][2]


def test_partitions_and_parts_change_nothing(spark):
    df = rows(spark)
    whole = B.bootstrap_sums(df, "k", ["a"], 40)
    spread = B.bootstrap_sums(df.repartition(13), "k", ["a"], 40)
    parts = B.bootstrap_sums(df.where("k < 100"), "k", ["a"], 40).unionByName(B.bootstrap_sums(df.where("k >= 100"), "k", ["a"], 40)) \
        .groupBy("replicate").agg(F.sum("n_a").alias("n_a"), F.sum("sum_a").alias("sum_a"))
    read = lambda x: {r["replicate"]: (r["n_a"], round(r["sum_a"], 9)) for r in x.collect()}
    assert read(whole) == read(spread) == read(parts) and len(read(whole)) == 40
    n = [v[0] for v in read(whole).values()]
    assert 280 < sum(n) / 40 < 320  # as many draws as rows
    assert B.bootstrap(df.where("false"), "k", {"a": "A"}, 8).count() == 0
