"""Connected components by alternating large and small stars, as joins and aggregates.

Every round writes its edges to the shared folder, so a lost executor costs one round at most. Minima are aggregated map-side, and a
hub's minimum is broadcast to its edges (``looked_up``); no node's edges are gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import looked_up, written
from logloom.session import ensure_importable

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges thinned to stars (a > b): the same components from fewer edges."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        found = [(x, root(x)) for x in parent]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=EDGES)


def least_of(edges: DataFrame) -> DataFrame:
    """Each node ``a`` with its smallest ``b`` (m) and its number of edges (n)."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def large_star(edges: DataFrame) -> DataFrame:
    """``edges`` is a written table; so are those of ``small_star``."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(least_of(both).withColumn("m", F.least("a", "m")), "least")
    return looked_up(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = written(least_of(edges), "least")
    others = looked_up(edges, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; ``edges`` has long columns a and b, root is the component's smallest node."""
    ensure_importable(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.mapInArrow(forest, "a long, b long").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(now)
        edges = written(small_star(written(large_star(edges), "large")), "edges")
