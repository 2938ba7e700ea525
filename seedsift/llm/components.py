"""Connected components of a graph that may be of any size, in Spark.

Each task first reduces its edges to a spanning forest by union-find, which leaves fewer edges than nodes;
then large-star and small-star rounds hook every node to the smallest node that it can see, until nothing
changes. Hubs are safe: minima pre-aggregate, and joins on hubs can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import Scratch

EDGES = "u long, v long"
#: Edges that a task's union-find holds before it hands its forest on.
BLOCK_EDGES = 500_000


def forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union-find: every node with the smallest node of its tree, roots left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def made():
        rows = np.array(forest(held), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"u": rows[:, 0], "v": rows[:, 1]})

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if len(held) >= BLOCK_EDGES:
            yield made()
            held.clear()
    if held:
        yield made()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge; edges: (u, v) in any direction, component: the smallest node."""
    now = scratch.write(edges.select("u", "v").where("u <> v").mapInArrow(_forests, EDGES))
    digest = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large)
        # Every edge points to its smaller node now; all of a node's smaller neighbours meet at the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.where("u <> v").distinct())
        scratch.drop(now, large)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == digest:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        digest = seen
