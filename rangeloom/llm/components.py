"""Connected components by alternating stars, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Parts that the links of a node are dealt into, so that a hub meets its least neighbour in as many tasks.
PARTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u.  No step needs the links of a node together: they
    are dealt by (u, part of v), and only a row for each part meets by u."""
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("u", "s").agg(F.min("v").alias("p"))
    least = parts.groupBy("u").agg(F.min("p").alias("m"))
    return dealt.join(parts.select("u", "s").join(least, "u"), ["u", "s"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = _with_least(edges.union(edges.select("v", "u")))
    return both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    known = _with_least(edges)
    moved = known.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(known.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another.

    edges has two long columns, in either order, repeated or not; loops and rows with a null are
    ignored; no edges give no rows.  Each round is a large star and a small star over a table in the
    shared folder.  Rounds go with the logarithm of the longest chain; most_rounds is a guard against
    a fault, and raising it only lets the work go on.
    """
    a, b = edges.columns
    pairs = edges.filter(f"`{a}` != `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = scratch.write(pairs)
    seen = None
    for _ in range(most_rounds):
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not mark[0] or tuple(mark) == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(mark)
        old = scratch.last
        pairs = scratch.write(_small(_large(pairs)))
        scratch.drop(old)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds; pass a larger most_rounds")
