"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import stored

#: A key is hot if it has more than this part of a table's rows; so fewer keys than ``HOT`` can be hot.
HOT = 64


def hot_keys(rows: DataFrame, key: str) -> list[int]:
    """Keys that more than one in ``HOT`` rows have (and more than ``HOT`` rows): fewer than ``HOT`` keys at any size."""
    least = rows.count() // HOT
    return [r[key] for r in rows.groupBy(key).count().where(F.col("count") > least).where(F.col("count") > HOT).collect()]


def looked_up(rows: DataFrame, key: str, pairs: DataFrame, hot: list[int], spread: str) -> DataFrame:
    """``rows`` with a column ``found``: the value that ``pairs`` (k, v; unique k) have for ``key``, else null.

    The pairs of ``hot`` keys are broadcast (fewer than ``HOT`` rows). The other rows meet their pairs by a
    shuffle in which rows of hot keys are spread over all tasks by ``spread``, so no task gets a hot key whole.
    """
    if not hot:
        return rows.join(pairs, F.col(key) == F.col("k"), "left").select(*rows.columns, F.col("v").alias("found"))
    few = F.broadcast(pairs.where(F.col("k").isin(hot)).select(F.col("k").alias("hot_k"), F.col("v").alias("hot_v")))
    salt = F.when(F.col(key).isin(hot), F.xxhash64(spread)).otherwise(0).alias("salt")
    met = pairs.select(F.struct("k", F.lit(0).cast("bigint").alias("salt")).alias("there"), "v")
    return rows.join(few, F.col(key) == F.col("hot_k"), "left") \
        .withColumn("here", F.struct(F.col(key).alias("k"), salt)) \
        .join(met, F.col("here") == F.col("there"), "left") \
        .select(*rows.columns, F.coalesce("hot_v", "v").alias("found"))


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (columns a, b): the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours; the node that gave a class its label
    takes the smallest that any node of the class met, and all take the label of their label. So whole classes
    join at once and long chains halve. Every round is written as a table: its size is then
    known, while sizes estimated through a checkpoint multiply with every round's joins. A node with very many
    links and a label that very many nodes have are spread over all tasks.
    """
    both = stored(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "sides")
    hubs = hot_keys(both, "b")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low"))
                    .select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        pairs = labels.select(F.col("node").alias("k"), F.col("label").alias("v"))
        near = looked_up(both, "b", pairs, hubs, "a").groupBy(F.col("a").alias("other")).agg(F.min("found").alias("low"))
        nearest = stored(labels.join(near, labels["node"] == near["other"])
                         .select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")), "nearest")
        hooks = nearest.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("hook"))
        raised = nearest.join(hooks, F.col("node") == F.col("root"), "left") \
            .select(F.col("node").alias("k"), F.least("label", "hook").alias("v"))
        new = stored(looked_up(nearest, "label", raised, hot_keys(nearest, "label"), "node")
                     .select("node", "old", F.least("label", "found").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
