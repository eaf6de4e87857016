"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curves.functions.storage import remove, scratch, stored


def _size(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, path: str) -> DataFrame:
    """(u, m): the least neighbour of each node that has a smaller one. Written out, so that the joins with it read
    plain exchanges, of which Spark can split a hub's rows."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")), path).hint("merge")


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    """Each node moves from its smaller neighbour v to v's least neighbour. Edges go from u to a smaller v."""
    up = _least(edges, path).withColumnRenamed("u", "v")
    return edges.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, path: str) -> DataFrame:
    """All smaller neighbours of a node, and the node, move to the least of them."""
    both = edges.join(_least(edges, path), "u")
    pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return both.select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the (u, v) edges of longs but the roots; root is the least node of a component.

    Every round keeps at most one edge to a node's least neighbour, so edges never multiply; each round is
    written to the shared folder, the one before goes, and rounds end when the edges no longer change.
    """
    spark = edges.sparkSession
    base = scratch(spark)
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{base}/0")
    before = _size(edges)
    for turn in count(1):
        if not before[0]:
            break
        edges = stored(_small_star(_large_star(edges, f"{base}/{turn}-large"), f"{base}/{turn}-small"), f"{base}/{turn}")
        after = _size(edges)
        for old in (f"{turn - 1}", f"{turn}-large", f"{turn}-small"):
            remove(spark, f"{base}/{old}")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
