"""Distributed connected components: alternating large-star and small-star steps over an edge table.

Every round is written to the shared folder. Minima combine on the map side, so a node with very many
edges is no bottleneck there; joins back to the edges are left to adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Edges up to which the nodes' minima are broadcast (at most two nodes an edge: 16 MB).
EDGES = 500_000


def _to_edges(edges: DataFrame, minima: DataFrame, few: bool) -> DataFrame:
    """Joins each node's minimum to its edges: by broadcast up to EDGES edges, so that a hub's edges stay spread out; else by shuffle."""
    return edges.join(F.broadcast(minima) if few else minima, "u")


def _large(edges: DataFrame, few: bool) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _to_edges(both.where("v > u"), low, few).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, few: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them; edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _to_edges(edges, low, few).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From undirected edges (u, v): node, component (its smallest member). Nodes without an edge to another node don't appear."""
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(now)
    while before[0]:
        few = before[0] <= EDGES
        old, now = now, written(_small(_large(now, few), few), "edges")
        removed(old)
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    out.table_path = now.table_path
    return out
