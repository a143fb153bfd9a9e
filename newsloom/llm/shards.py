"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import pinned

#: Racks of a region and shards of a rack, filled in order; a shard past the last opens a new one.
RACKS, SHARDS = 2, 2

Tree = dict[int, dict[int, dict[int, float]]]


def layout(weights: Sequence[float]) -> Tree:
    """Region -> rack -> shard -> weight. Shard k lies in region k div 4, rack k div 2: a tree that
    grows past full regions opens a new region, so only that new subtree gains weight."""
    tree: Tree = {}
    for k, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("a shard's weight must be positive")
        tree.setdefault(k // (RACKS * SHARDS), {}).setdefault(k // SHARDS % RACKS, {})[k] = float(weight)
    return tree


def _draw(key: Column, level: str, node: Sequence[int], weight: float) -> Column:
    """Weighted draw of a node: an exponential variate of rate ``weight`` from a hash of key and node."""
    salt = f"{level}/{'/'.join(map(str, node))}"
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(uniform) / F.lit(float(weight))


def _least(options: list[tuple[Column, Column]]) -> Column:
    """The value whose draw is least; the earlier node wins a tie."""
    draws = [d for d, _ in options]
    least = F.least(*draws) if len(draws) > 1 else draws[0]
    pick = options[-1][1]
    for draw, value in reversed(options[:-1]):
        pick = F.when(draw == least, value).otherwise(pick)
    return pick


def assign(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: descend region, rack and shard, at each level to the child with the least draw.

    A node's draw depends on the key, the node's name and its subtree's weight only. When a weight
    grows, only that subtree can gain keys; nothing moves between the others.
    """
    regions = []
    for r, racks in layout(weights).items():
        rack_options = []
        for k, shards in racks.items():
            options = [(_draw(key, "shard", (s,), w), F.lit(s)) for s, w in shards.items()]
            rack_options.append((_draw(key, "rack", (r, k), sum(shards.values())), _least(options)))
        total = sum(w for shards in racks.values() for w in shards.values())
        regions.append((_draw(key, "region", (r,), total), _least(rack_options)))
    return _least(regions).cast("int")


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown: float = 1.0,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Every row with its shard and its place in it.

    Returns ``doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard``: ``size`` is the UTF-8
    bytes of the text (null: none) plus 1, ``slot`` runs without gaps from 0 in each shard, and
    ``grown_shard`` is the shard after one more of weight ``grown`` is added. The key alone decides
    (with the weights), so copies of a row share a shard; a null id hashes like a value of its own.

    Slots need no sort of the rows and no group per shard: each slice numbers its own rows, after the
    rows that earlier slices have in the shard. The narrow columns are checkpointed first, so the
    slices can't change when an executor is lost.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    placed = pinned(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(data) + 1).cast("bigint").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.lit("key").alias("law"),
            assign(key, weights).alias("shard"),
            assign(key, [*weights, grown]).alias("grown_shard"),
        ).withColumn("_slice", F.spark_partition_id())
    )
    counts = placed.groupBy("_slice", "shard").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_slice", "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_slice", "shard").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_own", F.row_number().over(own))
        .join(offsets, ["_slice", "shard"])
        .select(
            "doc_id", "size", "text_crc32", "law", "shard",
            (F.col("_before") + F.col("_own") - 1).cast("bigint").alias("slot"), "grown_shard",
        )
    )
