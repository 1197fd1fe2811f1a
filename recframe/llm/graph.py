"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut, rows_of


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def union(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node that it reaches) of a few edges, by union and find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up)]


def components(edges: DataFrame, few: int = SMALL) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Up to ``few`` edges are joined in the driver: a megabyte, in place of dozens of stages that it would have to plan. Of more,
    large-star and small-star steps take turns, each linear in the edges; the number of rounds grows as the logarithm of
    a component's size. A node with very many edges is handled by pre-aggregated minima and joins that Spark can split.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(edges)
    if state[0] <= few:
        found = union(zip(*(c.to_pylist() for c in edges.toArrow().columns), strict=True))
        return rows_of(edges.sparkSession, found, pa.schema({"node": pa.int64(), "component": pa.int64()}))
    while True:
        both = _both_ways(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: every node's smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b"))
        edges = cut(small.filter("a <> b").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    # stable: every edge goes from a component's smallest node to another of its nodes
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
