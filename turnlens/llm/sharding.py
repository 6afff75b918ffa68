"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Every shard owns ``vnodes`` points on it, and a row belongs to
the first point at or after its cell. No shard takes more than its capacity: the rows of an arc
beyond it continue clockwise to the next points until a shard has room. Capacities are the row count
divided by the shards (at most one apart), or with ``slack`` that share times ``1 + slack``.

Only counts decide how many rows of a cell go where, so the allocation needs one number per cell (a
fixed bound, whatever the table's size). Within a cell the rows are ranked by their hash; a rank
range of a cell goes to one shard, and the same ranks give each row its gapless slot.

Null ids and null or empty texts are hashed like any other value. Rows that agree in id and text
share a ring point and are told apart by their rank only. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import literal_rows, text_or_empty

CELL_BITS = 14
VNODES = 64


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """``(cell, shard)`` of every virtual node, clockwise."""
    points = []
    for s in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()
            points.append((int(digest[:8], 16) >> (32 - CELL_BITS), digest, s))
    return [(cell, s) for cell, _, s in sorted(points)]


def allocate(counts: dict[int, int], n_shards: int, vnodes: int, slack: float) -> list[tuple]:
    """``(cell, first, until, shard, slot)``: ranks first <= r < until of a cell go to the shard, from a slot on.

    ``counts`` holds at most ``2 ** CELL_BITS`` numbers.
    """
    total = sum(counts.values())
    if slack:
        room = [math.ceil(total * (1 + slack) / n_shards)] * n_shards
    else:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    points = ring_points(n_shards, vnodes)
    # cells of each arc, clockwise; cells after the last point wrap to the first
    arcs: list[list[int]] = [[] for _ in points]
    p = 0
    for cell in sorted(counts):
        while p < len(points) and points[p][0] < cell:
            p += 1
        arcs[p % len(points)].append(cell)
    left = [sum(counts[c] for c in cells) for cells in arcs]
    given: list[list[tuple[int, int]]] = [[] for _ in points]
    waiting, step = [a for a in range(len(points)) if left[a]], 0
    while waiting:
        for a in waiting:
            shard = points[(a + step) % len(points)][1]
            take = min(left[a], room[shard])
            if take:
                given[a].append((shard, take))
                left[a] -= take
                room[shard] -= take
        waiting, step = [a for a in waiting if left[a]], step + 1
    out, slot = [], [0] * n_shards
    for cells, parts in zip(arcs, given):
        parts = parts[::-1]
        for cell in cells:
            first = 0
            while first < counts[cell]:
                shard, n = parts.pop()
                take = min(n, counts[cell] - first)
                out.append((cell, first, first + take, shard, slot[shard]))
                slot[shard] += take
                first += take
                if take < n:
                    parts.append((shard, n - take))
    return out


def shard_rows(docs: DataFrame, n_shards: int = 24, vnodes: int = VNODES, slack: float = 0.0,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` of every row."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("point", F.md5(F.concat_ws(
        " ", F.coalesce(F.col("id").cast("string"), F.lit("none")), "text_crc32", "size")))
    cell = F.shiftright(F.conv(F.substring("point", 1, 8), 16, 10).cast("long"), 32 - CELL_BITS).cast("int")
    rows = rows.withColumn("cell", cell)
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most 2 ** CELL_BITS rows
    ranges = literal_rows(docs.sparkSession, allocate(counts, n_shards, vnodes, slack),
                          "cell int, first bigint, until bigint, shard int, base bigint")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("point")) - 1)
    placed = ranked.join(ranges, "cell").where("rank >= first AND rank < until")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard",
                         (F.col("base") + F.col("rank") - F.col("first")).alias("slot"))
