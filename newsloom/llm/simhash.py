"""SimHash fingerprints and near-duplicate groups found with sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Forest, groups, salted_join, text_batches
from newsloom.llm.graph import components, joined
from newsloom.session import pinned

SEED = 42
#: Members of one shard tree; a larger bucket is cut into hashed shards and every pair of them is met.
SHARD = 4096
#: Hashes whose bits are counted at once.
CHUNK = 1 << 17
WORD = 0xFFFFFFFFFFFFFFFF


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included. A-Z is lower-cased; words are
    cut at ASCII white space; fewer words make one shingle, none makes none."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hashed(b" ".join(words), SEED)]
    return [hashed(b" ".join(run), SEED) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint_batch(texts: list[str | None], size: int) -> np.ndarray:
    """A bit of a fingerprint is 1 if more than half of the text's shingle hashes have it."""
    sums = np.zeros((len(texts), 64), np.int64)
    counts = np.zeros(len(texts), np.int64)
    kept: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def add() -> None:
        nonlocal held
        if kept:
            bits = np.unpackbits(np.concatenate(kept).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *(len(k) for k in kept[:-1])])
            part = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            np.add.at(sums, owner, part)
            kept.clear()
            owner.clear()
            held = 0

    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, size), np.uint64)
        counts[i] = len(hashes)
        for at in range(0, len(hashes), CHUNK):
            kept.append(hashes[at : at + CHUNK])
            owner.append(i)
            held += len(kept[-1])
            if held >= CHUNK:
                add()
    add()
    bits = (2 * sums > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0].view(np.int64)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row: the 64-bit SimHash of the whole text as a signed long. Null and
    wordless texts have fingerprint 0."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_batch(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree: a child hangs under the integer Hamming distance to its parent."""

    __slots__ = ("children", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Insert a value that isn't in the tree."""
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            distance = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = new
                return
            at = below

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of the values within the radius; only edges within it are followed."""
        found: list[int] = []
        todo = [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            below = children[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    todo += [x for d, x in below.items() if -radius <= d - distance <= radius]
                else:
                    for d in range(distance - radius, distance + radius + 1):
                        if d in below:
                            todo.append(below[d])
        return found


def _block(fp: Column, i: int, blocks: int) -> Column:
    """The i-th of ``blocks`` runs of bits of a fingerprint."""
    low, high = 64 * i // blocks, 64 * (i + 1) // blocks
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _shard_links(radius: int):
    """Per group: build the tree of one shard, ask it for the other's members, and keep a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("block", "key", "i", "j")):
            fps = [x & WORD for x in rows.column("fp").to_pylist()]
            ids = rows.column("rep").to_pylist()
            own = rows.column("own").to_pylist()
            alone = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            tree, members, forest = BKTree(), [], Forest()
            if not alone:
                for fp, rep, first in zip(fps, ids, own, strict=True):
                    if first:
                        tree.add(fp)
                        members.append(rep)
            for fp, rep, first in zip(fps, ids, own, strict=True):
                if alone or not first:
                    for at in tree.near(fp, radius):
                        forest.union(rep, members[at])
                if alone:
                    tree.add(fp)
                    members.append(rep)
            if links := list(forest.edges()):
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(classes: DataFrame, radius: int) -> DataFrame:
    """A spanning forest ``(a, b)`` of the links between classes ``(fp, rep)`` within ``radius`` bits.

    Of ``radius`` + 1 blocks of bits, two fingerprints within the radius share one, so a pair meets in
    the bucket of a shared block. A bucket's members form shard trees of bounded size; the tree of
    each shard goes to the members of every shard of its bucket. Trees of the whole corpus are never
    built, collected or broadcast. A group returns a forest, not its pairs.
    """
    blocks = radius + 1
    rows = classes.select(
        "fp", "rep", F.posexplode(F.array(*[_block(F.col("fp"), i, blocks) for i in range(blocks)])).alias("block", "key")
    )
    sizes = rows.groupBy("block", "key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.count("*").alias("n"))
    met = rows.join(sizes.where("n > 1").drop("n"), ["block", "key"])
    home = met.withColumn("home", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    dealt = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        "block", "key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"),
        (F.col("home") <= F.col("other")).alias("own"), "fp", "rep",
    )
    keys = ["block", "key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_shard_links(radius), "a long, b long")


def simhash_groups(
    docs: DataFrame, radius: int = 2, size: int = 3, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: groups of rows chained by fingerprints that differ
    in ``radius`` bits or fewer.

    ``component_id`` is the smallest doc_id reachable, the row's own included. Rows with equal
    fingerprints are one class, so copies are never paired. Rows without an id link nothing and have a
    null component. Repeated ids are repeated in the result. Empty texts share fingerprint 0.
    """
    prints = pinned(fingerprints(docs, text_col, id_col, size))
    classes = pinned(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes, radius))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return salted_join(prints, named, "fp", F.col("doc_id"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def hex_print(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# ---- near copies by similarity: a wider fingerprint, and verification

#: 64-bit words of a wide fingerprint, words that distances are taken on, and bits of a bucket's key.
WIDE, MEASURED, KEY_BITS = 16, 2, 16
#: Links a task holds beyond those of its forests, and the growth of the number of forests from round to round.
MET, GROWTH = 1 << 20, 8
#: Columns of a proposed link, or of a group that has more of them.
PROPOSED = {"a": pa.int64(), "b": pa.int64(), "block": pa.int32(), "key": pa.int64(), "i": pa.int32(), "j": pa.int32(), "shards": pa.int32()}


def wide_batch(texts: list[str | None], size: int) -> np.ndarray:
    """(texts, WIDE) words of SimHash bits: the shingle hashes, multiplied by odd constants for more bits."""
    odd = np.random.default_rng(SEED).integers(1, 1 << 62, WIDE, dtype=np.uint64) | np.uint64(1)
    odd[0] = 1
    out = np.zeros((len(texts), WIDE), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, size), np.uint64)
        if not len(hashes):
            continue
        sums = np.zeros(64 * WIDE, np.int64)
        for at in range(0, len(hashes), 1 << 12):
            mixed = hashes[at : at + (1 << 12), None] * odd
            mixed ^= mixed >> np.uint64(32)
            sums += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * sums > len(hashes), bitorder="little").view(np.uint64)
    return out


def _wide_prints(docs: DataFrame, size: int) -> DataFrame:
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            wide = wide_batch(texts, size).view(np.int64)
            some = [bool((t or "").split()) for t in texts]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * WIDE, pa.int32()), pa.array(wide.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values, pa.array(some)], names=["doc_id", "name", "wide", "some"])

    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("name"), "text")
    return rows.mapInArrow(run, "doc_id long, name string, wide array<long>, some boolean")


class Forests:
    """At most ``most`` edge-disjoint forests, each spanning what is left of the edges before it. Two
    nodes that a forest connects are connected in all forests before it."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.levels: list[Forest] = []

    def add(self, a: int, b: int) -> bool:
        """Put an edge into the first forest that doesn't connect its ends; False if all do."""
        low, high = 0, len(self.levels)
        while low < high:
            at = (low + high) // 2
            if self.levels[at].find(a) == self.levels[at].find(b):
                low = at + 1
            else:
                high = at
        if low == self.most:
            return False
        if low == len(self.levels):
            self.levels.append(Forest())
        self.levels[low].union(a, b)
        return True


def _nearest(met: list[tuple], most: int) -> list[tuple]:
    """The links ``(distance, a, b, set of a, set of b)`` of ``most`` forests over the sets, nearest first."""
    forests = Forests(most)
    return [x for x in sorted(met) if forests.add(x[3], x[4])]


def _shard_forests(radius: int, most: int):
    """Per group: of the links within the radius between members that verified links have not joined
    (``comp`` differs), those of ``most`` forests. If that leaves links out, the group is named too."""
    held = MET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("block", "key", "i", "j")):
            ids, own, comps = (rows.column(c).to_pylist() for c in ("rep", "own", "comp"))
            if len(set(comps)) < 2:
                continue
            prints = [sum((x & WORD) << (64 * k) for k, x in enumerate(v)) for v in rows.column("near").to_pylist()]
            alone = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            tree, members = BKTree(), []
            met: list[tuple] = []
            limit, whole = held, True
            if not alone:
                for value, rep, first, comp in zip(prints, ids, own, comps, strict=True):
                    if first:
                        tree.add(value)
                        members.append((rep, comp))
            for value, rep, first, comp in zip(prints, ids, own, comps, strict=True):
                if alone or not first:
                    for at in tree.near(value, radius):
                        other, joined = members[at]
                        if joined != comp:
                            pair = (rep, other, comp, joined) if rep < other else (other, rep, joined, comp)
                            met.append(((tree.values[at] ^ value).bit_count(), *pair))
                    if len(met) > limit:
                        kept = _nearest(met, most)
                        whole &= len(kept) == len(met)
                        met, limit = kept, len(kept) + held
                if alone:
                    tree.add(value)
                    members.append((rep, comp))
            kept = _nearest(met, most)
            whole &= len(kept) == len(met)
            links_ = [(a, b, None, None, None, None, None) for _, a, b, _, _ in kept]
            if not whole:
                links_.append((None, None, *(rows.column(c)[0].as_py() for c in ("block", "key", "i", "j", "shards"))))
            for at in range(0, len(links_), 1 << 16):
                columns = zip(*links_[at : at + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PROPOSED.values(), strict=True)], names=list(PROPOSED))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs whose sets of shingles have a Jaccard similarity of ``least`` or more, from whole texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    met = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    met = met.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = set(shingle_hashes(x, size)), set(shingle_hashes(y, size))
                both = len(p & q)
                close.append(bool(p or q) and both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return met.mapInArrow(run, "a long, b long")


def near_copies(
    docs: DataFrame, least: float = 0.8, size: int = 5, radius: int = 32, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """``(doc_id, component_id)`` of each row with an id: groups of texts chained by Jaccard
    similarities of ``least`` or more between their sets of ``size``-word shingles.

    Two bits of fingerprints in fifteen hundredths of all differ at 0.8, too many for the blocks of one
    64-bit fingerprint. So the fingerprint has 1024 bits in 64 keys of 16 bits: texts with a
    similarity of 0.8 share a key in 99 cases of 100, more similar ones nearly always. In a key's bucket a
    BK-tree (in shards of bounded size, as above) finds the members within ``radius`` of 128 bits.
    Only verified links join texts. In rounds, a bucket proposes the nearest links that span what
    verified links have not joined, and they are verified on whole texts. Refuted links are proposed
    again, so each round takes ``GROWTH`` times as many forests as the last; a bucket is done when it
    leaves no link out. So every candidate is verified, or its ends are joined by verified links.

    Equal texts are one class. Texts without words are one group if they are equal, and are otherwise
    similar to nothing. Rows of one id are one document. Rows without an id are not returned.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    prints = pinned(_wide_prints(source, size))
    classes = pinned(prints.groupBy("name").agg(F.min("doc_id").alias("rep"), F.min("some").alias("some"), F.min("wide").alias("wide")))
    per_word = 64 // KEY_BITS
    word = lambda k: F.get("wide", k // per_word)
    keys = [F.shiftrightunsigned(word(k), KEY_BITS * (k % per_word)).bitwiseAND(F.lit((1 << KEY_BITS) - 1)) for k in range(WIDE * per_word)]
    rows = classes.where("some").select("rep", F.slice("wide", 1, MEASURED).alias("near"), F.posexplode(F.array(*keys)).alias("block", "key"))
    sizes = rows.groupBy("block", "key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.count("*").alias("n"))
    sizes = sizes.where("n > 1").drop("n")
    by = ["block", "key", "i", "j"]
    # The class of a text and all ids that have it.
    same = prints.select("doc_id", "name").distinct()
    copies = salted_join(same, classes.select("name", "rep"), "name", F.col("doc_id")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = copies.where("a <> b")
    tested = found = left = None
    most = 1
    while True:
        named = rows.withColumn("comp", F.col("rep"))
        if found is not None:
            named = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        home = named.join(sizes, ["block", "key"]).withColumn("home", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
        dealt = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
            "block", "key", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"),
            (F.col("home") <= F.col("other")).alias("own"), "shards", "near", "rep", "comp",
        )
        if left is not None:
            dealt = dealt.join(left.select(*by), by, "left_semi")
        schema = "a long, b long, block int, key long, i int, j int, shards int"
        proposed = pinned(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_shard_forests(radius, most), schema))
        pairs = proposed.where("a <> b").select("a", "b").distinct()
        pairs = pinned(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        linked = pinned(_verified(source, pairs, size, least))
        found = components(copies.unionByName(linked)) if found is None else joined(found, linked)
        left = proposed.where("a IS NULL").select(*by, "shards")
        if left.isEmpty():
            break
        sizes = left.select("block", "key", "shards").distinct()
        most *= GROWTH
    return same.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id")
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` less those whose group has a smaller id; rows without an id stay."""
    groups_ = near_copies(docs, id_col=id_col, **options)
    gone = groups_.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy"))
    return docs.join(gone, F.col(id_col) == F.col("_copy"), "left_anti")
