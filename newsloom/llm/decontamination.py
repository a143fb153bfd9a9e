"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import scratch_path

#: Words of a shingle.
SHINGLE = 5
#: Bits in which the fingerprints of a window and an item may differ.
RADIUS = 16


def words(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits, in order."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def shingles(column: str) -> Column:
    """Hash of each run of SHINGLE words of a column of word hashes, repeats included; fewer words make
    one shingle, none none."""
    n = F.size(column)
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(column, i + k) for k in range(SHINGLE)]))
    short = F.when(n > 0, F.array(F.xxhash64(column))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= SHINGLE, runs).otherwise(short)


def simhash(hashes: Column) -> Column:
    """Bit k is 1 if more than half of the hashes have it; a repeated shingle weighs as often as it occurs."""

    def bit(k: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.lit((1 << k) - ((1 << 64) if k == 63 else 0))).otherwise(F.lit(0)).cast("bigint")

    bits = [bit(k) for k in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle lists: each shingle weighs as often as it occurs."""
    count = lambda list_, x: F.size(F.filter(list_, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    total = F.size(a) + F.size(b) - common
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))


def _block(fp: str, i: int, blocks: int) -> Column:
    low, high = 64 * i // blocks, 64 * (i + 1) // blocks
    return F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _blocks(rows: DataFrame, fp: str, radius: int) -> DataFrame:
    blocks = radius + 1
    return rows.withColumn("_block", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _block(fp, i, blocks).alias("x")) for i in range(blocks)])))


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: its size is known, so the planner broadcasts it only if it is small."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    percent: int = 80,
    radius: int = RADIUS,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, start, similarity)``: the most similar window of each document and benchmark
    item that has a weighted shingle similarity of ``percent`` / 100 or more.

    A window is as long as the item (a shorter document is one window). Windows start where a shingle
    shared with the item puts the item's start; a window without a shared shingle has similarity 0. A
    document is looked at for an item only if enough of the item's shingles occur in it, which any
    window that is similar enough needs. The windows' 64-bit SimHashes are matched to the items' by
    ``radius`` + 1 blocks of bits, one of which any pair within the radius shares; candidates within
    the radius are verified on all shingles.

    ``start`` counts words from 0; of equal windows the first is given. Items and documents without
    words, and rows without an id, match nothing. Rows that repeat an id are all searched.
    """
    # Exact: least number of an item's shingles that a similar window shares.
    bench = items.where(F.col(item_id_col).isNotNull()).select(
        F.col(item_id_col).alias("item_id"), words(F.col(item_text_col)).alias("_w")
    )
    # Lists that a lambda reads stand in a column of their own, or they'd be made again for each element.
    bench = _written(
        bench.where(F.size("_w") > 0).select("item_id", F.size("_w").alias("m"), shingles("_w").alias("b")).distinct(), "shingled"
    )
    bench = _written(bench.withColumn("fq", simhash(F.col("b"))), "items")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    parts = bench.select("item_id", F.size("b").alias("size"), F.posexplode("b").alias("at", "h"))
    # An item of fewer words than a shingle is one shingle of its length; texts get runs of these lengths too.
    lengths = [r["m"] for r in bench.where(F.col("m") < SHINGLE).select("m").distinct().orderBy("m").collect()]
    runs = lambda k: F.transform(
        F.when(F.size("_w") >= k, F.sequence(F.lit(0), F.size("_w") - k)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("_w", i + 1, k)).alias("h")),
    )
    whole = F.transform(shingles("_w"), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    # What a text shorter than a shingle is as a whole, is its one run of that length.
    every = F.array_distinct(F.concat(whole, *[runs(k) for k in lengths])) if lengths else whole
    spans = texts.select("doc_id", words(F.col("_t")).alias("_w"))
    spans = spans.select("doc_id", F.greatest(F.lit(1), F.size("_w") - (SHINGLE - 1)).alias("held"), F.explode(every).alias("s"))
    hits = spans.select("doc_id", "held", "s.pos", "s.h").join(parts, "h")
    # A window is as long as the item, or the whole of a shorter document.
    need = F.ceil(percent * (F.least("size", "held") + F.col("size")) / F.lit(100 + percent))
    likely = _written(
        hits.groupBy("doc_id", "item_id", "size", "held")
        .agg(F.count_distinct("at").alias("n"), F.collect_set(F.col("pos") - F.col("at")).alias("starts"))
        .where(F.col("n") >= need)
        .select("doc_id", "item_id", "starts"),
        "likely",
    )
    wanted = likely.join(bench.select("item_id", "m"), "item_id")
    found = texts.join(wanted, "doc_id").select("doc_id", "item_id", "m", "starts", words(F.col("_t")).alias("_w"))
    clamp = lambda s: F.greatest(F.lit(0), F.least(s, F.size("_w") - F.col("m")))
    windows = found.select(
        "doc_id", "item_id", F.explode(F.array_distinct(F.transform("starts", clamp))).alias("start"), "m", "_w"
    ).select("doc_id", "item_id", "start", F.slice("_w", F.col("start") + 1, F.col("m")).alias("_v"))
    windows = windows.select("doc_id", "item_id", "start", shingles("_v").alias("a"))
    prints = _written(windows.withColumn("fp", simhash(F.col("a"))), "windows")
    met = _blocks(prints.select("doc_id", "item_id", "start", "fp"), "fp", radius).join(
        _blocks(bench.select("item_id", "fq"), "fq", radius), ["item_id", "_block"]
    )
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= radius).select("doc_id", "item_id", "start").distinct()
    scored = prints.join(near, ["doc_id", "item_id", "start"]).join(bench.select("item_id", "b"), "item_id")
    scored = scored.select("doc_id", "item_id", "start", similarity(F.col("a"), F.col("b")).alias("similarity"))
    best = scored.where(F.col("similarity") >= percent / 100).groupBy("doc_id", "item_id").agg(
        F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start"), F.max("similarity").alias("similarity")
    )
    return best.select("doc_id", "item_id", "start", "similarity")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which ``leaks`` finds no benchmark item; rows without an id stay."""
    dirty = _written(leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(dirty, F.col(id_col) == F.col("_leak"), "left_anti")
