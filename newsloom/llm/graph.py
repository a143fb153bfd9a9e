"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import pinned

#: Shares that the edges of a node are dealt out in.
SALTS = 8


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction of edges (u > v): link neighbours to the least node around them.

    The edges of a node are dealt out by salts. Each share has its own least neighbour, and a node has one
    row for each share that it has, so what goes back to the edges is never more than the edges.
    """
    around = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = around.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = around.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least(F.min("m").over(Window.partitionBy("u")), F.col("u")))
    met = around.join(least, ["u", "salt"])
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (columns ``a``, ``b``, integers).

    The component is its smallest node. Nodes without an edge are not listed; null ends are ignored.
    Rounds (logarithmic in the diameter) are cut by reliable checkpoints; a round ends the loop when
    it leaves the edges as they were, i.e. every component is a star around its smallest node.
    """
    now = edges.where("a <> b").select(
        F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")
    )
    now = pinned(now.distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        if not before[0]:
            break
        now = pinned(_star(_star(now, small=False), small=True))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges that ``found`` comes from and of more ``edges``. Only components that the
    new edges link are contracted, so the work follows the new edges."""
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    led = more.select(F.col("node").alias("component"), F.col("component").alias("least"))
    moved = found.join(led, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return pinned(moved.unionByName(more.join(found, "node", "left_anti")))
