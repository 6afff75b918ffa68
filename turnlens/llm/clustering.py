"""Centroid clustering of integer vectors with bounds from centroid histories (ns-bounds).

For every vector and centroid the last distance that was computed is kept, with the round it belongs
to. The history of all centroids is kept as well (rounds x clusters x width numbers, sent to every
task). A stored distance bounds today's distance from both sides by the norm of the centroid's whole
displacement since that round: ``|d(old) - d(now)| <= |c(now) - c(old)|``. One norm of a sum is never
longer than the sum of the norms of every round's drift, so the bounds are tighter than added ones.

A round assigns a vector without any distance if its centroid's upper bound is below the lower bounds
of all others. Where that fails the distance to its own centroid is computed, then those to the
centroids whose lower bounds still fail. Distances are exact integers; bounds are compared with a
margin above their rounding, so ties are always computed and go to the smaller number.

Each round reads the state that the last one wrote to the shared folder, with no shuffle but the sums
of the new centroids (clusters x partitions rows). Only centroids come to the driver.

Rows whose vector is null, has another width than ``width`` or holds a null or non-finite component
take no part. A null id counts as the empty text in the hash that picks the first centroids; rows that
agree in id are ordered by their vectors. Repeated rows count each for itself. With fewer rows than
clusters each row starts a centroid; an empty table gives no rows. Components beyond ``LARGEST`` after
scaling raise an error, since their squared distances don't fit into 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import bounded_batches, literal_rows, stored

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest size of a scaled component: squared distances of 64 components stay below 2 ** 62.
LARGEST = 1 << 27
#: Part of a distance by which bounds are loosened: more than the rounding of stored single-precision distances.
MARGIN = 1e-5
BATCH = 4000


def usable(col: str, width: int) -> Column:
    """Whether a vector has ``width`` components, none null or non-finite."""
    x = F.col(col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")),
                                              F.lit(False)))
    return F.coalesce(F.size(x) == width, F.lit(False)) & F.coalesce(finite, F.lit(False))


def scaled(col: str, scale: int) -> Column:
    """Components as integers: ``floor(scale * x)``."""
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double")) * scale <= LARGEST, y.cast("int")) \
            .otherwise(F.raise_error(F.lit(f"clustering: a scaled component is larger than {LARGEST}")).cast("int"))
    return F.transform(F.col(col), one)


def distances(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one centroid."""
    diff = rows - centroid
    return np.einsum("ij,ij->i", diff, diff)


class History:
    """All centroids so far: ``centroids[t]`` is the table that round ``t`` assigns by."""

    def __init__(self, first: np.ndarray):
        self.centroids = [first]

    def moved(self) -> np.ndarray:
        """``[t, j]``: norm of centroid j's displacement from round t to now."""
        now = self.centroids[-1].astype(np.float64)
        return np.sqrt(((now[None] - np.stack(self.centroids).astype(np.float64)) ** 2).sum(axis=2))


def assign(x: np.ndarray, own: np.ndarray, known: np.ndarray, at: np.ndarray, history: History) -> np.ndarray:
    """New cluster of every row; ``known`` and ``at`` (distance and its round by centroid) are brought up to date.

    Returns the number of distances computed for each row.
    """
    now, moved = history.centroids[-1], history.moved()
    n, k = known.shape
    each = np.arange(k)
    work = np.zeros(n, dtype=np.int64)

    def evaluate(rows: np.ndarray, j: int) -> None:
        square[rows, j] = distances(x[rows], now[j])
        known[rows, j] = np.sqrt(square[rows, j].astype(np.float64))
        at[rows, j] = len(history.centroids) - 1
        work[rows] += 1

    square = np.full((n, k), np.iinfo(np.int64).max)
    gap = moved[at, each[None, :]]
    lower = known * (1 - MARGIN) - gap * (1 + MARGIN)
    upper = known[np.arange(n), own] * (1 + MARGIN) + gap[np.arange(n), own] * (1 + MARGIN)
    lower[np.arange(n), own] = np.inf
    open_rows = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    for j in each:  # the distance to the row's own centroid, where a bound failed
        evaluate(open_rows[own[open_rows] == j], j)
    exact = np.where(square.min(axis=1) < np.iinfo(np.int64).max, known[np.arange(n), own] * (1 + MARGIN), -np.inf)
    failed = lower <= exact[:, None]
    for j in each:  # and to those centroids whose bounds still fail
        evaluate(np.flatnonzero(failed[:, j]), j)
    new = own.copy()
    new[open_rows] = square[open_rows].argmin(axis=1)  # the first of equal ones: the smaller number
    own[:] = new
    return work


STATE = "id {kind}, v array<int>, own int, known array<float>, seen array<smallint>, work int"


def run_round(rows: DataFrame, history: History, kind: str) -> DataFrame:
    """State of every row after it has been assigned by the last centroids of ``history``."""
    first = "own" not in rows.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(history.centroids[0])
        for b in batches:
            n = b.num_rows
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            if first:  # nothing is known: every bound fails
                own, seen = np.zeros(n, np.int64), np.zeros((n, k), np.int64)
                known, work = np.zeros((n, k)), np.zeros(n, np.int64)
            else:
                own, work = b.column(2).to_numpy().astype(np.int64), b.column(5).to_numpy().astype(np.int64)
                known = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, k)
                seen = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, k)
            work = work + assign(x, own, known, seen, history)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(own.astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(known.astype(np.float32).ravel())),
                pa.ListArray.from_arrays(offsets, pa.array(seen.astype(np.int16).ravel())),
                pa.array(work.astype(np.int32))], names=["id", "v", "own", "known", "seen", "work"])

    return rows.mapInArrow(step, STATE.format(kind=kind))


def next_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every cluster; empty clusters keep their centroid."""
    width = now.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(now), width), dtype=np.int64)  # of one partition: far from 2 ** 63
        count = np.zeros(len(now), dtype=np.int64)
        for b in batches:
            own = b.column(0).to_numpy().astype(np.int64)
            np.add.at(held, own, b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width))
            np.add.at(count, own, 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(at.astype(np.int32)), pa.array(count[at]),
            pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(held[at].ravel()))],
            names=["own", "n", "sums"])

    parts = state.select("own", "v").mapInArrow(sums, "own int, n bigint, sums array<bigint>")
    rows = parts.select("own", "n", F.posexplode("sums").alias("place", "part")).groupBy("own", "place") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")) \
        .collect()  # clusters x width rows
    out = now.copy()
    for r in rows:
        out[r["own"], r["place"]] = int(r["total"]) // int(r["n"])
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
                    width: int = WIDTH, scale: int = SCALE, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """Cluster of every usable row after ``rounds`` updates of the centroids.

    Columns: id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and
    n_distances, the number of distances that were computed for the row in all rounds.
    """
    spark = vectors.sparkSession
    if width * (2 * LARGEST) ** 2 >= 1 << 63:
        raise ValueError(f"width {width}: squared distances don't fit into 64 bits")
    bounded_batches(spark, BATCH)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stored(vectors.where(usable(vec_col, width)).select(F.col(id_col).alias("id"), scaled(vec_col, scale).alias("v")),
                  "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select("v", order.alias("hash")).orderBy("hash", "v").limit(clusters).collect()
    if not first:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in (
            "distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).alias("n_distances"))
    history = History(np.array([r["v"] for r in first], dtype=np.int64))
    state = rows
    for i in range(rounds):
        state = stored(run_round(state, history, kind), f"clusters-{i}")
        history.centroids.append(next_centroids(state, history.centroids[-1]))
    last = run_round(state, history, kind)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history.centroids[-1].tolist()]
    centroids = literal_rows(spark, [(j, c) for j, c in enumerate(history.centroids[-1].tolist())], "own int, c array<int>")
    result = stored(last.join(F.broadcast(centroids), "own").select(  # as many centroids as clusters
        "id", "own", "work", F.aggregate(F.zip_with("v", "c", lambda a, b: a.cast("long") - b), F.lit(0).cast("long"),
                                         lambda s, d: s + d * d).alias("distance")), "clustered")
    inertia = {r["own"]: int(r["total"]) for r in result.groupBy("own").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row a cluster
    held = literal_rows(spark, [(j, names[j], str(t), str(sum(inertia.values()))) for j, t in sorted(inertia.items())],
                        "own int, centroid_sha256 string, cluster_inertia string, inertia string")
    return result.join(F.broadcast(held), "own").select(
        F.col("id").alias(id_col), F.col("own").alias("cluster"), "distance", F.col("cluster_inertia").cast("long"),
        F.col("inertia").cast("long"), "centroid_sha256", F.col("work").alias("n_distances"))
