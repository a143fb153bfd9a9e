"""Prefix trie of conversations, shard by shard as balanced parentheses.

Every turn gets the 128-bit hash of all turns up to it, so a trie node is a key and its members are
counted by aggregation. Nodes that follow each other with the same members are one class; classes form
a trie of at most two classes for each distinct conversation. The paths of the distinct conversations
through it are sorted and dealt out in ranges. A task writes its range as balanced parentheses and reads
off leaves, savings and children; only the paths at the borders of a range (its spines) lie in several
ranges too, and are added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import numbered, pinned

#: Path elements of a shard, and bytes of a piece of joined ids.
SHARD_ELEMENTS, JOINED = 1 << 20, 1 << 18
#: Parentheses of a block of the range min tree.
BLOCK = 64

NODE = ["ka", "kb", "depth"]
ELEMENT = ["a", "ka", "kb", "n", "m", "b", "cum_a", "cum_b"]
SHARD = "m long, n long, a long, b long, cum_b long, parent long, leaves long, below long, kids long, spine boolean"


class Parentheses:
    """A sequence of balanced parentheses (1 opens, 0 closes) with a range min tree over its excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = max(1, -(-len(bits) // BLOCK))
        self.width = 1 << (blocks - 1).bit_length()
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.least = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.least[self.width : self.width + blocks] = padded.reshape(blocks, BLOCK).min(axis=1)
        for k in range(self.width - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def _scan(self, at: np.ndarray, target: np.ndarray, out: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """From ``at`` to the end of its block for the first place with the target excess; the slots not found."""
        stop = np.minimum((at // BLOCK + 1) * BLOCK, len(self.bits))
        here, live = at.copy(), np.flatnonzero(at < stop)
        left = np.ones(len(at), bool)
        while len(live):
            hit = self.excess[here[live]] == target[live]
            out[slots[live[hit]]] = here[live[hit]]
            left[live[hit]] = False
            live = live[~hit]
            here[live] += 1
            live = live[here[live] < stop[live]]
        return np.flatnonzero(left)

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each of ``opens``: the next place of an excess one less."""
        out = np.full(len(opens), -1)
        target = self.excess[opens] - 1
        left = self._scan(opens + 1, target, out, np.arange(len(opens)))
        # An opening at the end of a block scans nothing of its own block.
        node = self.width + opens[left] // BLOCK
        want, moving = target[left], np.ones(len(left), bool)
        while moving.any():  # climb until the right sibling holds the target
            right = (node % 2 == 0) & (self.least[np.minimum(node + 1, len(self.least) - 1)] <= want)
            node = np.where(moving, np.where(right, node + 1, node // 2), node)
            moving &= ~right
        while (down := node < self.width).any():
            first = self.least[np.minimum(2 * node, len(self.least) - 1)] <= want
            node = np.where(down, np.where(first, 2 * node, 2 * node + 1), node)
        self._scan((node - self.width) * BLOCK, want, out, left)
        return out


def shard_classes(offsets: np.ndarray, columns: dict[str, np.ndarray], rep: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Classes of a shard of sorted paths (elements ``offsets[i]:offsets[i+1]`` of ``columns``).

    ``rep`` is the smallest conversation of a path's copies and ``weight`` their number. What a class
    adds to the ones above it (its own savings, one child) counts in the one shard whose paths hold the
    class's smallest conversation; a leaf counts where its path is.
    """
    paths = len(rep)
    length = np.diff(offsets)
    depth = int(length.max())
    ka, kb = columns["ka"], columns["kb"]
    # Elements that each path shares with the one before.
    shared = np.zeros(paths, np.int64)
    alive = np.arange(1, paths)
    for level in range(depth):
        alive = alive[(length[alive] > level) & (length[alive - 1] > level)]
        x, y = offsets[alive] + level, offsets[alive - 1] + level
        alive = alive[(ka[x] == ka[y]) & (kb[x] == kb[y])]
        if not len(alive):
            break
        shared[alive] = level + 1
    opened = length - shared
    closed = np.concatenate([[0], length[:-1] - shared[1:], [length[-1]]])
    runs = np.empty(2 * paths + 1, np.int64)
    runs[0::2], runs[1::2] = closed, opened
    tree = Parentheses(np.repeat(np.arange(2 * paths + 1) % 2, runs).astype(np.int8))
    opens = np.flatnonzero(tree.bits)
    closes = tree.find_close(opens)

    # Nodes in the order in which they open, the place of each among the elements, and each element's node.
    first = np.cumsum(opened) - opened
    path = np.repeat(np.arange(paths), opened)
    level = np.arange(len(path)) - first[path] + shared[path]
    element = offsets[path] + level
    node = np.empty(offsets[-1], np.int64)
    for k in range(depth):
        through = np.flatnonzero(length > k)
        node[offsets[through] + k] = np.maximum.accumulate(np.where(k >= shared[through], first[through] + k - shared[through], 0))
    whose = np.repeat(np.arange(paths), length)
    own = np.zeros(len(path), bool)
    own[node[columns["m"] == rep[whose]]] = True

    n = columns["n"][element]
    saved = np.where(own, (n - 1) * (columns["cum_b"] - columns["cum_a"])[element], 0)
    leaf = (level == length[path] - 1) & (weight[path] == n)
    at_open = np.zeros(len(tree.bits) + 1, np.int64)

    def up_to(values: np.ndarray) -> np.ndarray:
        """Sum of the values of the nodes that open before each place."""
        at_open[:] = 0
        at_open[1 + opens] = values
        return np.cumsum(at_open)

    pairs, sums = up_to(leaf), up_to(saved)
    kids = np.zeros(len(path), np.int64)
    order = np.argsort(level, kind="stable")  # nodes of a level, in order
    edges = np.searchsorted(level[order], np.arange(depth + 2))
    for k in range(depth - 1):
        above, below = order[edges[k] : edges[k + 1]], order[edges[k + 1] : edges[k + 2]]
        counted = np.concatenate([[0], np.cumsum(own[below])])
        kids[above] = counted[np.searchsorted(opens[below], closes[above])] - counted[np.searchsorted(opens[below], opens[above])]
    spine = np.zeros(len(path), bool)
    spine[node[offsets[0] : offsets[1]]] = True
    spine[node[offsets[-2] : offsets[-1]]] = True
    return {
        "m": columns["m"][element], "n": n, "a": columns["a"][element], "b": columns["b"][element], "cum_b": columns["cum_b"][element],
        "parent": np.where(level > 0, columns["m"][np.maximum(element - 1, 0)], -1), "top": level == 0,
        "leaves": pairs[closes] - pairs[opens], "below": sums[closes] - sums[opens] - saved, "kids": kids, "spine": spine,
    }


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted paths to the classes of their shards, of a bounded number of elements each."""

    def solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = {c: rows.column(c).combine_chunks() for c in ELEMENT}
        lists = {c: (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for c, x in lists.items()}
        length = np.array([0, *(lists["a"].value_lengths().to_numpy())], np.int64)
        columns = {c: x.flatten().to_numpy() for c, x in lists.items()}
        out = shard_classes(np.cumsum(length), columns, rows.column("rep").to_numpy(), rows.column("w").to_numpy())
        parent = pa.array(out["parent"], pa.int64(), mask=out.pop("top"))
        return pa.RecordBatch.from_arrays(
            [parent if c == "parent" else pa.array(out[c]) for c in (x.split()[0] for x in SHARD.split(", "))],
            names=[x.split()[0] for x in SHARD.split(", ")],
        )

    held, elements = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            elements += len(batch.column("a").flatten())
        if elements >= SHARD_ELEMENTS:
            yield solved(held)
            held, elements = [], 0
    if held:
        yield solved(held)


def lookup(rows: DataFrame, found: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row for each key, which ``count`` rows have).

    Keys with over an eighth of a task's share of all ``total`` rows go to where the rows are. Their rows
    are among the total, so there are fewer than eight for each task and their table is small at every
    size. The other keys are joined by a shuffle in which no task gets much more than its share.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(1000, total // (8 * slices))
    hot = F.broadcast(found.where(F.col(count) > limit))
    cold = found.where(F.col(count) <= limit)
    rest = rows.join(hot.select(*keys), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(rest.join(cold, list(keys)))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _sequences(conversations: DataFrame, period: int, shares: Column | None) -> tuple[DataFrame, int]:
    """``conv_id, depth, size, a, b`` of every turn of the rebuilt conversations, and of their root."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second"), text, F.lit(0), role).alias("b"), F.length(text).cast("bigint").alias("size"),
    )
    placed = numbered(slim, [F.col("turn").asc_nulls_first(), F.col("a").asc(), F.col("b").asc()], by=("conv_id",), start=1).drop("turn")
    placed = pinned(placed)
    total = placed.count()
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("rows"))
    if shares is None:
        convs = convs.select("conv_id", "rows", F.lit(0).cast("bigint").alias("h"), F.col("conv_id").alias("base"))
    else:
        convs = convs.select("conv_id", "rows", shares.cast("bigint").alias("h"), (F.col("conv_id") - F.col("conv_id") % period).alias("base"))
    # At most the longest shared start of turns of each base conversation.
    most = convs.agg(F.max("h")).first()[0] or 0
    heads = placed.where((F.col("conv_id") % period == 0) & (F.col("position") <= most)).withColumnRenamed("conv_id", "base")
    there = heads.groupBy("base").agg(F.count("*").alias("there"))
    convs = pinned(convs.join(there, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"))
    shared = convs.join(heads, "base").where("position <= taken").select("conv_id", F.col("position").alias("depth"), "size", "a", "b")
    own = lookup(placed, convs.select("conv_id", "rows", "h", "taken"), ["conv_id"], "rows", total).where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "size", "a", "b")
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("size"), zero.alias("a"), zero.alias("b"))
    turn = shared.unionByName(own)
    turn = turn.select("conv_id", "depth", "size", F.xxhash64("a", "depth").alias("a"), F.xxhash64("b", F.lit(1), "depth").alias("b"))
    return root.unionByName(turn), total


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, ka, kb, size, cum``: hashes and code points of all turns up to each one.

    Turns are dealt out in ranges, each range adds up its own, after what the ranges before have of the
    conversation; so a conversation of any length spreads.
    """
    slices = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pinned(turns.repartitionByRange(slices, "conv_id", "depth").withColumn("_slice", F.spark_partition_id()))
    so_far = Window.partitionBy("conv_id", "_slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "conv_id", "depth", "size", "_slice", F.bit_xor("a").over(so_far).alias("xa"), F.bit_xor("b").over(so_far).alias("xb"),
        F.sum("size").over(so_far).alias("s"),
    )
    whole = placed.groupBy("conv_id", "_slice").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("size").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    before = whole.select(
        "conv_id", "_slice", F.coalesce(F.bit_xor("a").over(earlier), zero).alias("pa"),
        F.coalesce(F.bit_xor("b").over(earlier), zero).alias("pb"), F.coalesce(F.sum("t").over(earlier), zero).alias("ps"),
    )
    return local.join(before, ["conv_id", "_slice"]).select(
        "conv_id", "depth", _xor(F.col("xa"), F.col("pa")).alias("ka"), _xor(F.col("xb"), F.col("pb")).alias("kb"), "size",
        (F.col("s") + F.col("ps")).alias("cum"),
    )


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids with one key to comma-joined pieces of bounded size."""
    names = [*NODE, "first", "joined"]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in NODE]
        ids = batch.column("conv_id").to_numpy()
        change = np.zeros(len(ids), bool)
        change[0] = True
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(change)
        most = JOINED // 21  # decimal digits, sign and comma of an id
        cuts = [k for s, e in zip(starts, [*starts[1:], len(ids)], strict=True) for k in range(s, e, most)]
        joined = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts]) for k in keys), pa.array(ids[cuts]), pa.array(joined)], names=names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, as they stream by in order."""
    now, digest, out = None, None, []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*NODE, "ends"])

    for batch in batches:
        for ka, kb, depth, joined in zip(*(batch.column(c).to_pylist() for c in (*NODE, "joined")), strict=True):
            if (ka, kb, depth) == now:
                digest.update(b"," + joined.encode())
                continue
            if now is not None:
                out.append((*now, digest.hexdigest()))
            now, digest = (ka, kb, depth), hashlib.sha256(joined.encode())
        if len(out) >= 10_000:
            yield rows()
            out = []
    if now is not None:
        out.append((*now, digest.hexdigest()))
        yield rows()


def prefix_trie(conversations: DataFrame, period: int = 100, shares: Column | None = None) -> DataFrame:
    """Nodes of the prefix trie of ``conversations[conv_id, turn, role, text]``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's conv_id, null at
    the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (code points that members of the subtree's nodes share: of each node's last text,
    once for every member but the first) and ``ends_sha256`` (of the comma-joined ids, ascending, of
    the conversations that end there).

    ``shares``, a column of ``conv_id``, is the number of turns that each conversation takes from the
    start of conversation ``conv_id - conv_id % period`` in place of its own first ones; all of them if
    that one has fewer, none if it is absent. None: conversations as they are.

    Turns are in the order of ``turn``, null first, equal ones by a hash of role and text (so repeated
    rows are turns of their own). Null roles and texts are empty ones. Rows without a conv_id take no
    part. Extra columns are not read. An empty table has no nodes.

    Conversations, starts and copies of any number spread: turns are numbered and added up in ranges,
    nodes are aggregated before the shuffle, and what a third of all rows look up goes to where they
    are. The classes of one conversation are at most the root of twice the number of all turns, since
    each comes with a conversation of its own that ends or leaves there. Only the ids that end in one
    node pass one task, joined in pieces and one piece at a time, as a digest has to be computed.
    """
    turns, _ = _sequences(conversations, period, shares)
    prefixes = pinned(_prefixes(turns))
    total = prefixes.count()
    nodes = pinned(
        prefixes.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), F.max("size").alias("size"), F.max("cum").alias("cum"))
    )
    members = lookup(prefixes.select("conv_id", *NODE, "size", "cum"), nodes.select(*NODE, "n", "m"), NODE, "n", total)
    classes = members.groupBy("conv_id", "n").agg(
        F.min("depth").alias("a"), F.max("depth").alias("b"), F.min_by("ka", "depth").alias("ka"), F.min_by("kb", "depth").alias("kb"),
        F.min("m").alias("m"), F.min(F.col("cum") - F.col("size")).alias("cum_a"), F.max("cum").alias("cum_b"),
    )
    ends = prefixes.groupBy("conv_id").agg(F.max_by("ka", "depth").alias("ka"), F.max_by("kb", "depth").alias("kb"), F.max("depth").alias("depth"))
    ends = pinned(ends)
    copies = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("w")).select("conv_id", "w")
    path = F.sort_array(F.collect_list(F.struct(*ELEMENT)))
    paths = classes.join(copies, "conv_id").groupBy(F.col("conv_id").alias("rep"), "w").agg(path.alias("path"))
    slices = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.transform("path", lambda x: F.struct(x.ka, x.kb))
    dealt = pinned(paths).repartitionByRange(slices, order).sortWithinPartitions(order)
    dealt = dealt.select("rep", "w", *[F.col(f"path.{c}").alias(c) for c in ELEMENT])
    found = pinned(dealt.mapInArrow(_shards, SHARD))
    key = ["m", "n", "a", "b", "cum_b", "parent"]
    merged = found.where("spine").groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("leaves", "below", "kids")])
    solved = found.where("NOT spine").select(*key, "leaves", "below", "kids").unionByName(merged)
    solved = solved.withColumn("span", F.col("b") - F.col("a") + 1)

    joined = ends.repartitionByRange(slices, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = joined.select(*NODE, "conv_id").mapInArrow(_join_ids, "ka long, kb long, depth long, first long, joined string")
    digests = joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digest, "ka long, kb long, depth long, ends string")

    out = lookup(nodes, solved, ["m", "n"], "span", total).join(digests, NODE, "left")
    return out.select(
        F.col("m").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("a"), F.col("parent")).otherwise(F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("depth") < F.col("b"), F.lit(1)).otherwise(F.col("kids")).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("cum_b") - F.col("cum") + F.col("size"))).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
