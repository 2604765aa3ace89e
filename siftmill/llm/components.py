"""Connected components over a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import Shelf, columns


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each batch of edges by edges from its nodes to the least node of their part of the batch."""
    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False) for c in columns(batch, "a", "b"))
        if not len(a):
            continue
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if np.array_equal(root, before):
                break
        moved = root != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return ways.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them (edges run from the larger end)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connect(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """node, root (the least node reachable) of every node that has an edge and is not its own root.

    ``edges`` has long columns a and b. Every step is written to the shelf. A node with very many
    edges is aggregated before the shuffle, and its join is one that Spark can split.
    """
    now = shelf.put(edges.filter("a <> b").mapInArrow(_contract, "a long, b long").distinct())
    mark = None
    while True:
        count, total = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if (count, total) == mark or not count:
            break
        mark = (count, total)
        step = shelf.put(_small(_large(now)))
        shelf.drop(now)
        now = step
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
