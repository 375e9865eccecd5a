"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: Edges up to which one task solves the whole graph by union and find, in about 300 MB at most.
ONE_TASK_EDGES = 1_000_000


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of a stored table of edges (a, b): the smallest node it reaches.

    Up to ``ONE_TASK_EDGES`` counted edges go to one task of an executor; more are solved by
    alternating large-star and small-star until nothing changes.  Each such step is a minimum per
    node, which partial aggregation shrinks before the shuffle, and a join, which adaptive execution
    can split, so a node with very many edges is no one task's load.  Each round's edges are written
    to the shared folder.  Both ways give the same labels.
    """
    if edges.count() <= ONE_TASK_EDGES:
        return edges.select("a", "b").coalesce(1).mapInArrow(_union_find, "node long, label long")
    return _stars(edges)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    labels = np.fromiter((find(x) for x in parent), np.int64, len(parent))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])


def _stars(edges: DataFrame) -> DataFrame:
    state = tables.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        state = tables.stored(small.where("a <> b").distinct(), "edges")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ends = state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")))
    return ends.groupBy("node").agg(F.min("label").alias("label"))
