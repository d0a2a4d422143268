"""Connected components as Spark joins: the smallest node each node can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import store


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _mark(d: DataFrame):
    """Changes whenever the set of edges does: one row to the driver."""
    return d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def _is_stars(d: DataFrame) -> bool:
    """Whether each node points to one smaller node that points nowhere: then there is nothing to do."""
    forked = d.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    return forked.isEmpty() and d.join(d.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def smallest_reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Edges are rewritten to stars around ever smaller nodes (alternating large-star and small-star
    steps), a logarithmic number of rounds in practice.  A node's neighbours are never gathered: each
    step is a minimum per node, joined back to the edges, so a node with a third of all edges
    costs a skewed join that adaptive execution splits.  Any ordered node type will do.
    Null ends are ignored; an edge from a node to itself links nothing.
    """
    spark = edges.sparkSession
    now = edges.dropna(subset=[a, b]).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = store.keep(now.filter("u > v").distinct(), "edges")
    seen = None if _is_stars(now) else _mark(now)
    while seen is not None:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest neighbour
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = _least(large)
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        small = small.select("e.u", "e.v").filter("u > v").distinct()
        before, now = now, store.keep(small, "edges")
        mark = _mark(now)
        store.drop(spark, before)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
