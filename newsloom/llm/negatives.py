"""Hard negatives by a multiway hyperplane tree with distance ranges.

Scores are integer inner products. With one more coordinate, sqrt(M - |x|^2) where M is the largest
squared norm (and 0 for a query), all rows have one norm, and a row's squared distance from a query is
|q|^2 + M - 2 score: a window of scores is an annulus around the query. Rows fall to the nearest of
several split points, again and again; each split point keeps the least and largest distance to the rows
of each sibling. From the distance of a query to the split points these ranges bound its distance to all
rows of a sibling, which is passed over if that misses the annulus. Leaves are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import groups, salted_join
from newsloom.session import pinned

#: Rows of a shard and queries of a block: a task holds one of each.
SHARD, QUERIES = 4096, 4096
#: Split points of the root, whose subtrees are dealt out, and of an inner node; rows of a leaf.
CELLS, FANOUT, LEAF = 64, 8, 128
#: Rows that split points of the root are chosen from: those with the smallest hashes.
SAMPLE = 4096
#: Vector lengths that get a tree, at most: the most frequent of the sample. Rows of others are scored without.
LENGTHS = 8
#: Components, scaled and floored, are below this in size; then scores of up to 2,048 of them, in percent, are
#: 64-bit integers.
COMPONENT = 1 << 22

LOWEST, HIGHEST = -(1 << 62), 1 << 62
ROW = "cell int, sub int, block int, kind int, vec_id long, label long, name long, mark long, v array<int>, low long, high long, least long"
FOUND = "name long, mark long, score long, vec_id long, own boolean"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers. The fast product of doubles is exact below 2^53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Points:
    """Rows: integer vectors and the coordinate that gives all of them the squared norm ``norm``."""

    v: np.ndarray
    norm: int

    def __post_init__(self) -> None:
        self.rest = np.sqrt(np.maximum(self.norm - np.einsum("ij,ij->i", self.v, self.v), 0).astype(np.float64))

    def distances(self, split: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Of each row from each split point."""
        both = products(self.v, split) + self.rest[:, None] * rest[None, :]
        return np.sqrt(np.maximum(2.0 * self.norm - 2.0 * both, 0))


def reach(v: np.ndarray, norm: int, score: np.ndarray) -> np.ndarray:
    """The distance from each query at which rows have a score."""
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v) + float(norm) - 2.0 * score, 0))


def _slack(norm: int) -> float:
    """More than rounding moves a distance by: square roots of differences near zero lose half the digits."""
    return 1e-6 * (1.0 + float(norm) ** 0.5) + 1e-3


@dataclass
class Split:
    """Split points of a node and, from each of them to each sibling subtree, the range of distances."""

    v: np.ndarray
    rest: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray, norm: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and subtree, the least and largest distance that its rows can have."""
        d = reach_matrix(queries, self.v, norm)
        least = np.zeros((len(queries), len(self.v)))
        most = np.full((len(queries), len(self.v)), np.inf)
        for i in range(len(self.v)):
            at = d[:, i : i + 1]
            np.maximum(least, np.maximum(at - self.high[i], self.low[i] - at), out=least)
            np.minimum(most, at + self.high[i], out=most)
        return least, most


def reach_matrix(queries: np.ndarray, split: np.ndarray, norm: int) -> np.ndarray:
    """Distance of each query from each split point."""
    own = np.einsum("ij,ij->i", queries, queries)[:, None] + float(norm)
    return np.sqrt(np.maximum(own - 2.0 * products(queries, split), 0))


def spread(points: Points, many: int) -> np.ndarray:
    """Rows far from each other: each is the farthest from those before. Fewer if the rows are not different."""
    chosen = [0]
    least = points.distances(points.v[:1], points.rest[:1])[:, 0]
    while len(chosen) < many:
        far = int(np.argmax(least))
        if least[far] <= _slack(points.norm):
            break
        chosen.append(far)
        np.minimum(least, points.distances(points.v[far : far + 1], points.rest[far : far + 1])[:, 0], out=least)
    return np.array(chosen)


class Tree:
    """Rows of one shard in a tree whose leaves are searched for many queries at a time."""

    def __init__(self, v: np.ndarray, norm: int, ids: np.ndarray, labels: np.ndarray, names: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")  # in a leaf, the first of equal scores has the smallest id
        self.points, self.norm = Points(v[order], norm), norm
        self.ids, self.labels, self.names = ids[order], labels[order], names[order]
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        some = rows[:: max(1, len(rows) // 256)]
        part = Points(self.points.v[some], self.norm)
        chosen = some[spread(part, FANOUT)]
        if len(chosen) < 2:
            return rows
        v, rest = self.points.v[chosen], self.points.rest[chosen]
        d = Points(self.points.v[rows], self.norm).distances(v, rest)
        home = d.argmin(axis=1)
        parts = [np.flatnonzero(home == j) for j in range(len(chosen))]
        if max(map(len, parts)) == len(rows):
            return rows
        kept = [j for j, p in enumerate(parts) if len(p)]
        low = np.stack([d[parts[j]].min(axis=0) for j in kept], axis=1)[kept]
        high = np.stack([d[parts[j]].max(axis=0) for j in kept], axis=1)[kept]
        return Split(v[kept], rest[kept], low, high), [self._grow(rows[parts[j]]) for j in kept]

    def search(self, queries: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, same: bool, many: int):
        """The first ``many`` rows of each query by score and id, among rows of its own label (``same``)
        or of the others, with scores from ``low`` to ``high``; only those of at least ``least`` are
        wanted. Returns scores (LOWEST where there is none) and rows."""
        self.q, self.q_labels, self.low, self.high, self.same = queries, labels, np.maximum(low, least), high, same
        self.scores = np.full((len(queries), many), LOWEST, np.int64)
        self.rows = np.full((len(queries), many), len(self.ids), np.int64)
        # Rows that are nearer than the annulus score too much.
        self.inner = np.where(high < HIGHEST, reach(queries, self.norm, np.minimum(high, 1 << 53)), 0.0) - _slack(self.norm)
        self._visit(self.root, np.arange(len(queries)))
        return self.scores, self.rows

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._score(node, active)
            return
        split, kids = node
        least, most = split.bounds(self.q[active], self.norm)
        for j in np.argsort(least.mean(axis=0), kind="stable"):
            floor = np.maximum(self.low[active], self.scores[active, -1])
            outer = reach(self.q[active], self.norm, np.maximum(floor, -(1 << 53))) + _slack(self.norm)
            self._visit(kids[j], active[(least[:, j] <= outer) & (most[:, j] >= self.inner[active])])

    def _score(self, rows: np.ndarray, active: np.ndarray) -> None:
        many = self.scores.shape[1]
        score = products(self.q[active], self.points.v[rows])
        fits = (self.labels[rows][None, :] == self.q_labels[active][:, None]) == self.same
        fits &= (score >= self.low[active][:, None]) & (score <= self.high[active][:, None])
        score[~fits] = LOWEST
        hit = score.max(axis=1)
        some = np.flatnonzero((hit > LOWEST) & (hit >= self.scores[active, -1]))
        if not len(some):
            return
        score, at = score[some], active[some]
        first = np.argsort(-score, axis=1, kind="stable")[:, :many]
        new = np.take_along_axis(score, first, axis=1)
        named = np.where(new > LOWEST, rows[first], len(self.ids))
        both, whose = np.concatenate([self.scores[at], new], axis=1), np.concatenate([self.rows[at], named], axis=1)
        order = np.lexsort((whose, -both), axis=1)[:, :many]  # rows are in the order of their ids
        self.scores[at] = np.take_along_axis(both, order, axis=1)
        self.rows[at] = np.take_along_axis(whose, order, axis=1)


@dataclass
class Root:
    """The root's split points for each vector length, with cells numbered over all lengths; cell -1 has
    the rows of other lengths. ``sample`` bounds from below what a query will find."""

    norm: int
    splits: dict[int, Split]
    first: dict[int, int]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]

    def homes(self, size: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distances from the split points."""
        split = self.splits[size]
        d = Points(v, self.norm).distances(split.v, split.rest)
        return d.argmin(axis=1), d

    def least(self, size: int, v: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, many: int) -> np.ndarray:
        """The last of the first ``many`` scores of each query in the sample, LOWEST where it has fewer."""
        out = np.full(len(v), LOWEST, np.int64)
        if size in self.sample:
            held, owners = self.sample[size]
            if len(held) >= many:
                score = products(v, held)
                fits = ((owners[None, :] == labels[:, None]) == same) & (score >= low[:, None]) & (score <= high[:, None])
                score[~fits] = LOWEST
                out = -np.partition(-score, many - 1, axis=1)[:, many - 1]
        return out

    def cells(self, size: int, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and cell that can hold rows of the query's annulus."""
        least, most = self.splits[size].bounds(v, self.norm)
        outer = reach(v, self.norm, np.maximum(low, -(1 << 53))) + _slack(self.norm)
        inner = np.where(high < HIGHEST, reach(v, self.norm, np.minimum(high, 1 << 53)), 0.0) - _slack(self.norm)
        return np.nonzero((least <= outer[:, None]) & (most >= inner[:, None]))


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors by length: the length, their places, and the matrix."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield int(size), at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), size).astype(np.int64)


def root_of(rows: DataFrame) -> Root:
    """Split points for the root, from a sample of ``SAMPLE`` rows that reaches the driver; the ranges
    are filled in by ``ranged``."""
    n, norm = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x))).first()
    root = Root(int(norm or 0), {}, {}, {})
    held = rows.select("v", "label", F.xxhash64("name", "vec_id").alias("order")).orderBy("order", "label").limit(SAMPLE).toArrow().combine_chunks()
    if not held.num_rows:
        return root
    labels = held.column("label").to_numpy()
    lists = held.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = sorted(_matrices(lists), key=lambda x: (-len(x[1]), x[0]))[:LENGTHS]
    wanted = min(CELLS, max(1, -(-n // SHARD)))
    for size, at, v in sizes:
        points = Points(v, root.norm)
        chosen = spread(points, wanted)
        far = np.full((len(chosen), len(chosen)), np.inf)
        root.first[size] = sum(len(s.v) for s in root.splits.values())
        root.splits[size] = Split(v[chosen], points.rest[chosen], far, -far)
        root.sample[size] = v, labels[at]
    return root


def _homes(root: Root):
    """Rows with their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            for size, at, v in _matrices(batch.column("v")):
                if size in root.splits:
                    cell[at] = root.first[size] + root.homes(size, v)[0]
            yield batch.append_column("cell", pa.array(cell))

    return run


def _ranges(root: Root):
    """Least and largest distance from each split point to the rows of each cell, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for size, _, v in _matrices(batch.column("v")):
                if size not in root.splits:
                    continue
                home, d = root.homes(size, v)
                for cell in np.unique(home).tolist():
                    low, high = d[home == cell].min(axis=0), d[home == cell].max(axis=0)
                    if (size, cell) in held:
                        low, high = np.minimum(low, held[size, cell][0]), np.maximum(high, held[size, cell][1])
                    held[size, cell] = low, high
        rows = [(size, cell, i, float(low[i]), float(high[i])) for (size, cell), (low, high) in held.items() for i in range(len(low))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["size", "cell", "split", "low", "high"])

    return run


def ranged(rows: DataFrame, root: Root) -> Root:
    """The root with the ranges of all rows: at most LENGTHS x CELLS x CELLS of them."""
    found = rows.select("v").mapInArrow(_ranges(root), "size int, cell int, split int, low double, high double")
    for r in found.groupBy("size", "cell", "split").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        root.splits[r.size].low[r.split, r.cell], root.splits[r.size].high[r.split, r.cell] = r.low, r.high
    return root


def _routes(root: Root, shards: dict[int, int], blocks: int, same: bool, many: int):
    """Queries, each once for every shard of a cell that its annulus reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for batch in batches:
            label, low, high, name = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "low", "high", "name"))
            for size, at, v in _matrices(batch.column("v")):
                least = root.least(size, v, label[at], low[at], high[at], same, many)
                if size in root.splits:
                    query, cell = root.cells(size, v, np.maximum(low[at], least), high[at])
                    cell = cell + root.first[size]
                else:
                    query, cell = np.arange(len(at)), np.full(len(at), -1)
                times = np.array([shards.get(c, 0) for c in cell.tolist()], np.int64)
                where = np.repeat(np.arange(len(query)), times)
                sub = np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times)
                for k in range(0, len(where), 4096):
                    w = where[k : k + 4096]
                    rows = pa.array(at[query[w]])
                    n = len(w)
                    block = (name[at[query[w]]].astype(np.uint64) % np.uint64(blocks)).astype(np.int32)
                    columns = [
                        pa.array(cell[w].astype(np.int32)), pa.array(sub[k : k + 4096].astype(np.int32)), pa.array(block),
                        pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), batch.column("label").take(rows),
                        batch.column("name").take(rows), batch.column("mark").take(rows), batch.column("v").take(rows), batch.column("low").take(rows),
                        batch.column("high").take(rows), pa.array(least[query[w]]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _answer(root: Root, same: bool, many: int):
    """Per shard of rows and block of queries: the first rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, ("cell", "sub", "block")):
            kind = held.column("kind").to_numpy()
            mine, asked = held.filter(pa.array(kind == 0)).combine_chunks(), held.filter(pa.array(kind == 1)).combine_chunks()
            if not mine.num_rows or not asked.num_rows:
                continue
            flat = lambda t: (x.chunk(0) if isinstance(x := t.column("v").combine_chunks(), pa.ChunkedArray) else x)
            wanted = {size: (at, v) for size, at, v in _matrices(flat(asked))}
            for size, at, v in _matrices(flat(mine)):
                if size not in wanted:
                    continue
                places, q = wanted[size]
                ids, labels, names = (mine.column(c).to_numpy()[at] for c in ("vec_id", "label", "name"))
                tree = Tree(v, root.norm, ids, labels, names)
                label, low, high, least, name, mark = (asked.column(c).to_numpy()[places] for c in ("label", "low", "high", "least", "name", "mark"))
                score, rows = tree.search(q, label, low, high, least, same, many)
                query, k = np.nonzero(score > LOWEST)
                if len(query):
                    row = rows[query, k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[query]), pa.array(mark[query]), pa.array(score[query, k]), pa.array(tree.ids[row]), pa.array(tree.names[row] == name[query])],
                        names=[x.split()[0] for x in FOUND.split(", ")],
                    )

    return run


def nearest(rows: DataFrame, root: Root, shards: dict[int, int], queries: DataFrame, same: bool, many: int) -> DataFrame:
    """The first ``many`` rows of each query ``(name, mark, label, v, low, high)`` by score and id.

    A shard of a cell meets a block of queries in one task, so neither a cell nor the queries of a task
    grow with the tables.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    null = F.lit(0).cast("bigint")
    dealt = rows.select(
        "cell", "sub", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "name",
        null.alias("mark"), "v", null.alias("low"), null.alias("high"), null.alias("least"),
    )
    asked = queries.select("name", "mark", "label", "v", "low", "high").mapInArrow(_routes(root, shards, blocks, same, many), ROW)
    keys = ["cell", "sub", "block"]
    met = dealt.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys)
    found = met.mapInArrow(_answer(root, same, many), FOUND)
    place = F.row_number().over(Window.partitionBy("name", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= many)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The score of two rows is the inner product of their vectors, each component multiplied by ``scale``
    and floored. For every row where ``anchors`` (a column of the input) holds, the first ``positives``
    other rows of its label are its positives; for each of these, the first ``negatives`` rows of other
    labels with scores from ``low`` to ``high`` percent of the positive's are returned. Higher scores
    come first, then smaller ids.

    Rows with a null id, label or vector, an empty vector, a component that is null, not finite or of
    2^22 or more once scaled, take no part. Vectors of different lengths are not compared. Equal rows
    (id, label, vector) count once; other rows that share an id are rows of their own, also to each
    other. Empty tables give no rows; other columns are not read.

    Rows of one label with equal scaled vectors score alike and the smaller ids come first, so only the
    first ``positives`` + 1 of them can be returned and take part: a group of copies is cut down before
    the shuffle, and nothing is lost. Anchors with equal vectors and labels are searched for once.
    """
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    usable = F.forall(scaled, lambda x: F.coalesce(x > -COMPONENT, F.lit(False)) & F.coalesce(x < COMPONENT, F.lit(False)))
    whole = F.transform(F.when(usable, scaled), lambda x: F.floor(x).cast("int"))
    held = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    held = held.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).where("v IS NOT NULL")
    held = pinned(held.groupBy("vec_id", "label", "v").agg(F.max("anchor").alias("anchor")).withColumn("name", F.xxhash64("label", "v")))
    copies = Window.partitionBy("name", "label", "v").orderBy("vec_id")
    rows = pinned(
        held.drop("anchor").withColumn("n", F.row_number().over(copies)).where(F.col("n") <= max(positives, negatives) + 1).drop("n")
    )
    root = ranged(rows, root_of(rows))
    schema = "vec_id long, label long, v array<int>, name long, cell int"
    homes = rows.select("vec_id", "label", "v", "name").mapInArrow(_homes(root), schema)
    counts = dict(homes.groupBy("cell").count().collect())
    shards = {cell: -(-n // SHARD) for cell, n in counts.items()}
    # A row for each cell: LENGTHS x CELLS + 1 at most.
    sub = F.broadcast(rows.sparkSession.createDataFrame(list(shards.items()), "cell int, shards int"))
    homes = homes.join(sub, "cell").withColumn("sub", F.pmod(F.xxhash64("vec_id", "name"), F.col("shards")).cast("int")).drop("shards")

    zero = F.lit(0).cast("bigint")
    asking = held.where("anchor").select("name", "label", "v").distinct()
    asking = pinned(asking.withColumn("mark", zero).withColumn("low", F.lit(LOWEST)).withColumn("high", F.lit(HIGHEST)))
    entry = F.sort_array(F.collect_list(F.struct("place", "score", "vec_id", "own")))
    first = pinned(nearest(homes, root, shards, asking, True, positives + 1).groupBy("name").agg(entry.alias("near")))
    # The only own row of a class is the anchor itself, whose score is no positive's. Below zero no window holds a score.
    alone = F.size(F.filter("near", lambda x: x.own)) == 1
    wanted = F.transform(F.filter("near", lambda x: ~(x.own & alone) & (x.score >= 0)), lambda x: x.score)
    ask = first.select("name", F.explode(F.array_distinct(wanted)).alias("mark")).join(asking.select("name", "label", "v"), "name")
    ask = ask.withColumn("low", F.expr(f"(mark * {low} + 99) div 100")).withColumn("high", F.expr(f"mark * {high} div 100"))
    second = nearest(homes, root, shards, pinned(ask.where("low <= high")), False, negatives)
    second = second.groupBy("name", "mark").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("found"))
    second = second.groupBy("name").agg(F.collect_list(F.struct("mark", "found")).alias("windows"))
    # One row for each class of anchors, of bounded size; a class can have any number of anchors.
    answers = first.join(second, "name")
    out = salted_join(held.where("anchor").select(F.col("vec_id").alias("anchor_id"), "name"), answers, "name", F.col("anchor_id"))
    others = F.slice(F.filter("near", lambda x: ~(x.own & (x.vec_id == F.col("anchor_id")))), 1, positives)
    out = out.select("anchor_id", F.explode(others).alias("p"), "windows")
    of_score = F.get(F.filter("windows", lambda x: x.mark == F.col("p.score")), F.lit(0)).getField("found")
    return out.select("anchor_id", "p", F.explode(of_score).alias("n")).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("n.place").cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
