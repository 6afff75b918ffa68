"""Centroid clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from turnlens.llm import clustering
from turnlens.llm.clustering import History, assign, cluster_vectors


def brute(rows, width, clusters, rounds, seed=1, scale=64):
    """``(id, cluster, distance, cluster_inertia, inertia, digest)`` of every usable row."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    by = {j: sum(d for d, o in last if o == j) for j in range(len(cents))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, by[j], sum(by.values()), names[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows],
                                 "vec_id long, embedding array<double>, id string, own int, v string")


def got(df):
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("shape", ["spread", "coarse"])
def test_as_plain_rounds(spark, shape):
    r = np.random.default_rng(3)
    centres = r.normal(size=(9, 8))
    step = 0.15 if shape == "spread" else 0.0
    rows = [(i, (np.round(centres[i % 9] * 4) / 4 + step * r.normal(size=8)).tolist()) for i in range(400)]
    rows += [(500, [0.0] * 8), (500, [0.0] * 8), (501, [float("nan")] + [0.0] * 7), (502, None), (503, [1.0] * 7), (504, []),
             (505, [None] + [1.0] * 7), (506, [float("inf")] * 8), (None, [0.5] * 8), (507, [-1000.0] * 8), (508, [1000.0] * 8)]
    out = cluster_vectors(frame(spark, rows), clusters=7, rounds=4, width=8)
    assert got(out) == brute(rows, 8, 7, 4)


def test_few_rows_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert got(cluster_vectors(frame(spark, rows), width=2)) == brute(rows, 2, 16, 3)
    empty = cluster_vectors(frame(spark, rows).where("false"), width=2)
    assert empty.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.count() == 0


def test_too_large(spark):
    with pytest.raises(Exception, match="larger than"):
        cluster_vectors(frame(spark, [(1, [1e30, 0.0])]), width=2).collect()
    with pytest.raises(ValueError, match="64 bits"):
        cluster_vectors(frame(spark, []), width=1000)


def test_bounds_save_distances_and_use_the_whole_displacement():
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, size=(12, 16))
    x = (centres[r.integers(0, 12, 3000)] + r.integers(-40, 40, size=(3000, 16))).astype(np.int64)
    history = History(x[:12].copy())
    own, known, seen = np.zeros(3000, np.int64), np.zeros((3000, 12)), np.zeros((3000, 12), np.int64)
    work = [int(assign(x, own, known, seen, history).sum())]
    for _ in range(5):
        cents = history.centroids[-1].copy()
        for j in range(12):
            if (own == j).any():
                cents[j] = x[own == j].sum(axis=0) // (own == j).sum()
        history.centroids.append(cents)
        work.append(int(assign(x, own, known, seen, history).sum()))
        full = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
        assert (own == full.argmin(axis=1)).all()
    assert work[0] == 36000 and work[-1] < 3600
    # a centroid that went away and came back loosens no bound
    back = History(np.array([[0, 0], [9, 9]]))
    back.centroids += [np.array([[50, 0], [9, 9]]), np.array([[0, 0], [9, 9]])]
    assert back.moved()[0].tolist() == [0.0, 0.0] and clustering.MARGIN < 1e-4
