"""Connected components of an edge table, by alternating large-star and small-star steps, wholly as joins and minima.

No node's neighbours are ever gathered: each step needs their minimum (combined before the shuffle), which goes back to
a node's edges by a join, or by broadcast for the few nodes that have a large share of all edges. The edge table is
written to the shared folder after each round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import FEW, Scratch, discard, materialise, with_least


def _large(e: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbourhood."""
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("o")), F.struct(F.col("b").alias("n"), F.col("a").alias("o")))).alias("x")).select("x.n", "x.o")
    return with_least(both, "n", "o", "m", scratch, 2 * rows).where("o > n").select(F.col("o").alias("a"), F.least("n", "m").alias("b")).distinct()


def _small(e: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them. In e, a > b."""
    moved = with_least(e, "a", "b", "m", scratch, rows).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
    return moved.select("x.a", "x.b").where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node reachable.

    edges: columns a, b of one orderable type; loops, repeated rows and either direction are fine, nulls are dropped.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = materialise(e, "edges")
    before = _state(e)
    while before[0]:
        with Scratch() as scratch:
            stars, n = _large(e, scratch, before[0]), 2 * before[0]
            if n > FEW:  # the next step reads them several times
                stars = scratch.keep(stars, "stars")
            new, at = materialise(_small(stars, scratch, n), "edges")
        discard(spark, path)
        e, path, now = new, at, _state(new)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(e.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).first())
