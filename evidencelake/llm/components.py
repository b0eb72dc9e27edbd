"""Connected components of links, without bringing them to the driver or a node's links to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import arrow_limits, cut, dealt_by_size

#: So many rows of links, 16 bytes each, fit in one task whatever the size of the input; more are contracted first.
LAST = 250_000


def components(links: DataFrame, rounds: int = 80, last: int = LAST) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) can reach.

    Each round orders nodes by a hash of their own, and every node gives way to the first of its neighbours, or
    what that one has given way to; nodes that no other chose are gone, a third of a path's at least, so the number
    of rounds goes with the logarithm of the nodes. Links within what has become one node are dropped, and shuffles get
    as many partitions as the links that are left ask for. Once ``last`` rows or fewer are left, one task joins them up.
    The moves of all rounds are put together at the end, where the least node of each component is found. Each round
    is written in the shared folder.
    """
    spark = links.sparkSession
    both = links.select("a", "b").where("a <> b")
    edges = first = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = first.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    nodes = edges.count()
    if nodes <= last:
        return cut(joined_up(edges))
    for n in range(rounds):
        left = edges.count()
        if left <= last:
            with dealt_by_size(spark, nodes):
                up = joined_up(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
                labels = cut(labels.join(up, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
                least = labels.groupBy("component").agg(F.min("node").alias("least"))
                return cut(labels.join(least, "component").select("node", F.col("least").alias("component")))
        place = lambda c, n=n: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("to"))
        with dealt_by_size(spark, left):
            chosen = edges.groupBy("a").agg(F.min(place("b")).alias("best")).where(F.col("best") < place("a")).select("a", F.col("best.to").alias("to"))
            chosen = cut(chosen)
            hop = chosen.select(F.col("a").alias("to"), F.col("to").alias("up"))
            moves = chosen
            for _ in range(2):
                moves = moves.join(hop, "to", "left").select("a", F.coalesce("up", "to").alias("to"))
            moves = cut(moves)
            edges = cut(_moved(_moved(edges, moves, "a"), moves, "b").where("a <> b").distinct())
        labels = labels.join(moves.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    raise RuntimeError(f"links are left after {rounds} rounds")


def joined_up(edges: DataFrame) -> DataFrame:
    """(node, component) of few ``edges`` (a, b), in one task: roots give way to lower ones that a link leads to."""
    arrow_limits(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not sum(len(x[0]) for x in held):
            return
        nodes, at = np.unique(np.concatenate([x[0] for x in held] + [x[1] for x in held]), return_inverse=True)
        i, j = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[i] != root[j]).any():
            np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long")


def _moved(edges: DataFrame, moves: DataFrame, end: str) -> DataFrame:
    other: Column = F.col("b" if end == "a" else "a")
    return edges.join(moves.select(F.col("a").alias(end), "to"), end, "left").select(F.coalesce("to", end).alias(end), other)
