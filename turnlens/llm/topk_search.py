"""Exact top-k inner-product search by norm buckets.

Vectors are grouped by length (Euclidean norm, geometric bins). A few of the longest vectors give
every query a first threshold: its k-th best score among them. A bucket whose longest vector cannot
reach the threshold, even if it points along the query, is skipped for that query. In the remaining
buckets the threshold divided by the lengths of the query and the bucket is a cosine threshold. It
selects the pruning: by coordinate, if the query's largest coordinate confines the candidates to a
small part of the bucket's list sorted by that coordinate, otherwise by length. What is left is
verified by exact products.

Queries and buckets are cut into blocks of bounded size, so no task holds more than one block of
each; rows are dealt to blocks by their own number, so a repeated id fills no block alone. A block of
candidates is sent only to the query blocks of which some query asks for its bucket. Buckets are searched
in groups, the longest vectors first and each group ``GROWTH`` times as large as the last: after a group
the thresholds rise to the k-th best scores so far, and fewer queries ask for the next. Nothing is
approximate: recall is 1 and ties go to the smaller id.

Components are scaled and floored to integers; inner products that may not fit into 64 bits raise an error. Rows with a null id, a null vector, a null or
non-finite component take no part. Missing trailing components count as 0. A query's own id is never
among its results. Repeated rows are candidates each for itself; repeated query rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import saved, stored

SCALE = 1024
#: Rows of a block of candidates and of queries; bounds a task's memory.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Longest vectors that give the first thresholds (a fixed number, broadcast).
SEEDS = 512
#: Rows of the first group of buckets, and the growth of the next ones; pairs of buckets and query blocks that are broadcast.
FIRST_GROUP, GROWTH, MOST_PAIRS = 1 << 18, 4, 200_000
#: Ratio of the lengths within a bucket.
RATIO = 1.02
#: The list of a coordinate is used if it leaves at most this share of a block.
SHARE = 0.25


def scaled(col: str) -> Column:
    return F.transform(F.col(col), lambda x: F.floor(x.cast("double") * SCALE))


def usable(id_col: str, col: str) -> Column:
    x = F.col(col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")),
                                              F.lit(False)))
    return F.col(id_col).isNotNull() & x.isNotNull() & finite


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("top-k search: inner products of these vectors may not fit into 64 bits")
    return a @ b.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


class Block:
    """One block of candidates, longest first, with a sorted list of each coordinate that is asked for."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        size = lengths(x)
        order = np.argsort(-size, kind="stable")
        self.ids, self.x, self.size = ids[order], x[order], size[order]
        self.unit = self.x / np.maximum(self.size, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, q: np.ndarray, size: float, threshold: float) -> np.ndarray | None:
        """Candidates within the feasible interval of the query's largest coordinate; None: too many, or unbounded."""
        cosine = threshold / (size * self.size[0]) if size * self.size[0] > 0 else 0.0
        if not 0 < cosine <= 1:
            return None
        f = int(np.abs(q).argmax())
        along = q[f] / size
        spread = np.sqrt(max(0.0, (1 - cosine**2) * (1 - along**2)))
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        order, values = self.lists[f]
        if along >= 0:
            part = order[np.searchsorted(values, along * cosine - spread - 1e-9):]
        else:
            part = order[:np.searchsorted(values, along * cosine + spread + 1e-9, side="right")]
        return part if len(part) <= SHARE * len(order) else None

    def by_length(self, size: float, threshold: float) -> int:
        """Number of the longest candidates that are long enough."""
        if threshold <= 0 or size == 0:
            return len(self.ids)
        return int(np.searchsorted(-self.size, -(threshold / size) * (1 - 1e-9), side="right"))


def search_block(cands: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query of one block, of those that reach its threshold."""
    found = {"query_id": [], "vec_id": [], "score": []}
    if len(cands) and len(queries):
        width = max(max(map(len, cands["v"])), max(map(len, queries["v"])), 1)
        block = Block(cands["id"].to_numpy(), matrix(cands["v"], width))
        qid, q = queries["id"].to_numpy(), matrix(queries["v"], width)
        least, size = queries["threshold"].to_numpy(dtype=np.float64), lengths(q)

        def keep(i: int, ids: np.ndarray, scores: np.ndarray) -> None:
            good = (ids != qid[i]) & (scores >= least[i])
            ids, scores = ids[good], scores[good]
            at = best(ids, scores, k)
            found["query_id"].append(np.full(len(at), qid[i]))
            found["vec_id"].append(ids[at])
            found["score"].append(scores[at])

        rest = []
        for i in range(len(q)):
            part = block.by_coordinate(q[i], size[i], least[i])
            if part is None:
                rest.append(i)
            elif len(part):
                keep(i, block.ids[part], products(q[i:i + 1], block.x[part])[0])
        for a in range(0, len(rest), 256):
            rows = rest[a:a + 256]
            reach = max(block.by_length(size[i], least[i]) for i in rows)
            scores = products(q[rows], block.x[:reach])
            for i, s in zip(rows, scores):
                keep(i, block.ids[:reach], s)
    return pd.DataFrame({n: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)
                         for n, v in found.items()})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for every row where ``is_query`` holds."""
    spark = vectors.sparkSession
    v = F.col("v")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    base = vectors.where(usable(id_col, vec_col)) \
        .select(F.col(id_col).cast("long").alias("id"), scaled(vec_col).alias("v"), is_query.alias("is_query")) \
        .withColumn("norm", norm) \
        .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / float(np.log(RATIO)))).otherwise(-1)
                    .cast("long"))
    base = saved(base.withColumn("row", F.monotonically_increasing_id()))
    seeds = base.orderBy(F.desc("norm"), "id").limit(SEEDS).select("id", "v").collect()  # SEEDS rows
    seed_ids = np.array([r["id"] for r in seeds], dtype=np.int64)
    seed_rows = [r["v"] for r in seeds]

    def thresholds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            width = max([1, *map(len, seed_rows), *map(len, b["v"])])
            scores = products(matrix(list(b["v"]), width), matrix(seed_rows, width)).astype(np.float64)
            scores[b["id"].to_numpy()[:, None] == seed_ids[None, :]] = -np.inf
            few = np.full((len(b), max(0, k - len(seed_ids))), -np.inf)
            scores = np.concatenate([scores, few], axis=1)
            yield b.assign(threshold=np.sort(scores, axis=1)[:, -k])

    queries = saved(base.where("is_query").select("id", "v", "norm").distinct()
                    .mapInPandas(thresholds, "id bigint, v array<bigint>, norm double, threshold double"))
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks)))
    # one row for each occupied bin of the norm's logarithm: their number does not grow with the rows
    known = base.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.desc("bucket")).collect()
    if not known:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0).cast("long").alias("score"))
    groups, room = [[]], FIRST_GROUP
    for r in known:
        if groups[-1] and sum(x["n"] for x in groups[-1]) + r["n"] > room:
            groups.append([])
            room *= GROWTH
        groups[-1].append(r)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for i, group in enumerate(groups):
        part = search_group(base, queries, group, k)
        found = part if found is None else found.unionByName(part)
        if i + 1 < len(groups):
            found = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
            kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k) \
                .select(F.col("query_id").alias("id"), "kth")
            queries = stored(queries.join(kth, "id", "left").withColumn("threshold", F.greatest("threshold", F.col("kth").cast("double")))
                             .drop("kth"), "queries")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def dealt(base: DataFrame, queries: DataFrame, group: list) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries of a group of buckets at the pairs of blocks where they meet (``bucket, block, q_block``)."""
    numbers = [F.lit(r["bucket"]).cast("long") for r in group]
    blocks = F.element_at(F.map_from_arrays(F.array(*numbers), F.array(*[F.lit(-(-r["n"] // BLOCK)).cast("long") for r in group])),
                          F.col("bucket"))
    bins = F.array(*[F.struct(n.alias("bucket"), F.lit(r["longest"]).alias("longest")) for n, r in zip(numbers, group)])
    asked = queries.withColumn("bin", F.explode(F.filter(
        bins, lambda b: F.col("norm") * b["longest"] * (1 + 1e-9) >= F.col("threshold")))) \
        .select(F.col("bin.bucket").alias("bucket"), "q_block", "id", "v", "threshold")
    pairs = saved(asked.select("bucket", "q_block").distinct())
    pairs = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
    cands = base.join(pairs, "bucket").withColumn("block", F.pmod(F.xxhash64("row"), blocks)) \
        .select("bucket", "block", "q_block", "id", "v")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))) \
        .select("bucket", "block", "q_block", "id", "v", "threshold")
    return cands, asked


def search_group(base: DataFrame, queries: DataFrame, group: list, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the candidates of a group of buckets that may be among the k best."""
    cands, asked = dealt(base, queries, group)
    keys = ["bucket", "block", "q_block"]
    return cands.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(
        lambda c, q: search_block(c, q, k), "query_id bigint, vec_id bigint, score bigint")
