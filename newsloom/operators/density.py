"""Density clustering of embeddings: core distances, spanning tree, leaf clusters.

Contract (min_samples = k, min_cluster_size, leaf selection, merge distance eps): core distance
is the distance to the k-th nearest other point; an edge weighs max(core, core, distance); edges are
ordered by (weight, lower id, higher id), which makes the spanning tree unique.

How it spreads: points fall into hashed strips and every pair of strips is one bounded task, which
compares them block by block. The number of strips does not follow that of the points until a strip
reaches ``STRIP_BYTES``, so every point is shuffled ``STRIPS`` times, not once per block. A task
returns only its k smallest distances per point, or only the spanning forest of its own edges; the
tree of the union of these forests is the tree of the whole graph (Karloff, Suri and Vassilvitskii
2010). No point pairs are emitted and nothing depends on a group fitting in one task: forests are
thinned share by share, and run keys whose edges still pass ``LOCAL_EDGES`` are contracted by Boruvka
rounds as joins.

Strips are cut by a hash of the id, so neither a dense story nor any number of copies of one vector
makes a strip larger; of the copies in a block only so many are compared as can matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.clusters import assign_singletons
from newsloom.session import as_dimension, pinned

BLOCK_ROWS = 1024
LOCAL_EDGES = 500_000
FOREST_EDGES = 300_000
CANDIDATES = 32
STRIPS = 12
STRIP_BYTES = 32 << 20
PAIR_PARTITIONS = 256
EDGE = "run_key string, w double, i bigint, j bigint"

# -- numpy kernels for one pair of blocks ----------------------------------------------------------


def _vectors(table: pa.Table) -> np.ndarray:
    values = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1)


def _squared(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances through one matrix product, and a bound on their rounding error."""
    a, b = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    slack = 1e-11 * float(a.max() + b.max() + 1e-30)
    return np.maximum(a[:, None] + b[None, :] - 2.0 * (left @ right.T), 0.0), slack


def _halves(left: np.ndarray, right: np.ndarray, exact: bool = False) -> tuple[np.ndarray, float]:
    """Minus half the squared distances and a bound on their rounding error: in single precision by one
    product with the squared lengths as two more columns, or ``exact`` through ``_squared``; -inf for a
    row and itself."""
    a, b = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    top = float(a.max() + b.max())
    if exact or not top < 1e37:
        d2, slack = _squared(left, right)
        half = -0.5 * d2
    else:
        one, two = np.empty((len(a), left.shape[1] + 2), np.float32), np.empty((len(b), left.shape[1] + 2), np.float32)
        one[:, :-2], one[:, -2], one[:, -1] = left, -0.5, -0.5 * a
        two[:, :-2], two[:, -2], two[:, -1] = right, b, 1.0
        half, slack = one @ two.T, (left.shape[1] + 10) * 1.2e-7 * top + 1e-37
    if left is right:
        np.fill_diagonal(half, -np.inf)
    return half, slack


def _at_most(half: np.ndarray, square: np.ndarray | float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs whose squared distance may be at most ``square``."""
    near = half >= np.asarray(-0.5 * square - slack).astype(half.dtype)
    r, c = np.divmod(np.flatnonzero(near), near.shape[1])
    finite = np.isfinite(half[r, c])
    return r[finite], c[finite]


def _candidates(half: np.ndarray, limit: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the ``k`` nearest of a row, whose k-th squared distance so far is ``limit``."""
    unset = ~np.isfinite(limit)
    if unset.any():
        last = half.shape[1] - min(k, half.shape[1])
        limit = limit.copy()
        limit[unset] = 2 * (slack - np.partition(half[unset], last, axis=1)[:, last].astype(float))
    return _at_most(half, limit[:, None], slack)


def exact_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances, summed in a fixed order: equal in whatever task they are made."""
    return np.sqrt(np.square(left - right).sum(axis=1))


def _distances_at(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, step: int = 65_536) -> np.ndarray:
    parts = [exact_distances(x[rows[s : s + step]], x[cols[s : s + step]]) for s in range(0, len(rows), step)]
    return np.concatenate([np.array([]), *parts])


def _copies(x: np.ndarray) -> np.ndarray:
    """Number of equal rows before each row."""
    whole = np.ascontiguousarray(x + 0.0)  # -0.0 and 0.0 are one value
    _, group = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(x), int)
    place[order] = np.arange(len(x)) - np.searchsorted(group[order], group[order])
    return place


def _keep_nearest(best, names, x, ids, rows, cols, r, c) -> None:
    """Take over into ``best`` and ``names`` of ``rows`` what is near among ``cols``, ties by name; ``r`` and
    ``c`` are the candidates, whose distances are exact."""
    k = best.shape[1]
    touched, at = np.unique(r, return_inverse=True)
    held = rows[touched]
    owner = np.concatenate([np.repeat(np.arange(len(held)), k), at])
    distance = np.concatenate([best[held].ravel(), _distances_at(x, rows[r], cols[c])])
    name = np.concatenate([names[held].ravel(), ids[cols[c]]])
    order = np.lexsort((name, distance, owner))
    first = np.searchsorted(owner[order], np.arange(len(held)))
    kept = order[first[:, None] + np.arange(k)]
    best[held], names[held] = distance[kept], name[kept]


def _spanning_tree(w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim on a dense matrix (inf = no edge); for a forest it restarts at unreached vertices."""
    n = w2.shape[0]
    best, via = np.full(n, np.inf), np.full(n, -1)
    open_ = np.ones(n, dtype=bool)
    heads, tails, weights = [], [], []
    for _ in range(n):
        at = int(np.argmin(np.where(open_, best, np.inf)))
        if not open_[at]:
            at = int(np.argmax(open_))
        elif via[at] >= 0:
            heads.append(via[at]), tails.append(at), weights.append(best[at])
        open_[at] = False
        closer = open_ & (w2[at] < best)
        best[closer], via[closer] = w2[at][closer], at
    return np.array(heads, int), np.array(tails, int), np.array(weights)


def _tree_between(w2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim on the dense matrix between two blocks: vertices are its rows, then its columns."""
    m, n = w2.shape
    turned = np.ascontiguousarray(w2.T)
    key, best, via = np.full(m + n, np.inf), np.full(m + n, np.inf), np.full(m + n, -1)  # best: -inf once reached
    heads, tails, weights = [], [], []
    for _ in range(m + n):
        at = int(key.argmin())
        if key[at] < np.inf:
            heads.append(int(via[at])), tails.append(at), weights.append(key[at])
        else:
            at = int(best.argmax())
        key[at], best[at] = np.inf, -np.inf
        row, first = (w2[at], m) if at < m else (turned[at - m], 0)
        closer = np.nonzero(row < best[first : first + len(row)])[0]
        best[first + closer] = key[first + closer] = row[closer]
        via[first + closer] = at
    return np.array(heads, int), np.array(tails, int), np.array(weights)


def _leaf_order(n: int, heads: np.ndarray, tails: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vertices in a row, and the weights between neighbours there, such that the heaviest edge
    on the tree path between two vertices is the greatest weight between their places."""
    up, first, last, after, gap = list(range(n)), list(range(n)), list(range(n)), [-1] * n, [np.inf] * n

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a, b, w = heads.tolist(), tails.tolist(), weights.tolist()
    for e in np.argsort(weights, kind="stable").tolist():
        x, y = find(a[e]), find(b[e])
        after[last[x]], gap[last[x]] = first[y], w[e]
        last[x], up[y] = last[y], x
    row = []
    for root in range(n):
        at = first[root] if up[root] == root else -1
        while at >= 0:
            row.append(at)
            at = after[at]
    place = np.empty(n, np.int32)
    place[row] = np.arange(n, dtype=np.int32)
    return place, np.array(gap)[row]


def _heaviest_between(one: np.ndarray, two: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Greatest of ``gaps`` between each place of ``one`` and each of ``two``, from maxima over powers of two."""
    n = len(gaps)
    levels = [gaps]
    while 2 ** len(levels) <= n:
        half = 2 ** (len(levels) - 1)
        levels.append(np.concatenate([np.maximum(levels[-1][:-half], levels[-1][half:]), np.full(half, np.inf)]))
    power = np.maximum(np.log2(np.maximum(np.arange(n + 1), 1)).astype(np.int32), 0)
    low, high = np.minimum(one[:, None], two[None, :]), np.maximum(one[:, None], two[None, :])
    level = power[high - low]
    table, base = np.concatenate(levels), level * np.int32(n)
    high -= np.int32(1) << level
    high += base
    low += base
    return np.maximum(table[low], table[high])


def _possible_edges(w2: np.ndarray, slack: float, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that can belong to the exact spanning forest, given weights known up to ``slack``: not heavier
    than the heaviest edge on the tree path between their ends. ``within`` one block, or between two."""
    m, n = w2.shape
    place, gaps = _leaf_order(m if within else m + n, *(_spanning_tree(w2) if within else _tree_between(w2)))
    worst = _heaviest_between(place[:m], place if within else place[m:], gaps)
    i, j = np.nonzero(w2 <= worst + 2 * slack)
    some = np.isfinite(w2[i, j]) & ((i < j) if within else True)
    return i[some], j[some]


def kruskal(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of the forest edges, edges taken in (w, i, j) order."""
    names, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    order = np.lexsort((j, i, w))
    a, b, place = flat[: len(i)][order], flat[len(i) :][order], np.arange(len(order))
    every, kept = np.arange(len(names)), [place[:0]]
    # Every component takes its first edge, which the order makes unique; what hangs together becomes one.
    while len(open_ := np.nonzero(a != b)[0]):
        a, b, place = a[open_], b[open_], place[open_]
        first = np.full(len(names), len(a))
        np.minimum.at(first, a, np.arange(len(a)))
        np.minimum.at(first, b, np.arange(len(a)))
        ends = np.nonzero(first < len(a))[0]
        kept.append(place[np.unique(first[ends])])
        to = every.copy()
        to[ends] = a[first[ends]] + b[first[ends]] - ends
        mutual = (to[to] == every) & (every < to)
        to[mutual] = every[mutual]
        while not np.array_equal(to, above := to[to]):
            to = above
        a, b = to[a], to[b]
    return order[np.sort(np.concatenate(kept))]


def _edges(run_key: str, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.Table:
    return pa.table({"run_key": pa.array([run_key] * len(w), pa.string()), "w": w, "i": i, "j": j})


# -- blocks ----------------------------------------------------------------------------------------


def _keyed(points: DataFrame) -> DataFrame:
    key = F.col("run_key").cast("string") if "run_key" in points.columns else F.lit("0")
    return points.select(key.alias("run_key"), F.col("id").cast("bigint").alias("id"), "embedding")


def _strip_pairs(points: DataFrame, block_rows: int) -> DataFrame:
    """Every point once per strip pair its strip takes part in: rows of strips ``a`` and ``b`` with their
    ``strip``, pairs dealt out over tasks.

    A key has as many of ``STRIPS`` strips as it has of the points, so that one key spreads over all
    tasks and many keys stay whole; it has more only where a strip would pass ``STRIP_BYTES``.
    """
    sizes = pinned(points.groupBy("run_key").agg(F.count("*").alias("_n"), F.max(F.size("embedding")).alias("_width")))
    total = sizes.agg(F.sum("_n")).first()[0] or 1
    shared = F.least(F.ceil(F.col("_n") / block_rows), F.ceil(F.col("_n") * STRIPS / total))
    strips = F.greatest(shared, F.ceil(F.col("_n") * F.col("_width") * 8 / STRIP_BYTES)).cast("int")
    sizes = sizes.select("run_key", strips.alias("_strips"))
    pairs = sizes.agg(F.sum(F.expr("_strips * (_strips + 1) div 2"))).first()[0] or 1
    # A few keys reach the points where they are; by a shuffle all points of one key would meet in one task.
    placed = points.join(as_dimension(sizes), "run_key").withColumn("strip", F.pmod(F.xxhash64("id"), "_strips").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_strips") - 1)).alias("_other")
    return (
        placed.select("*", other)
        .withColumn("a", F.least("strip", "_other"))
        .withColumn("b", F.greatest("strip", "_other"))
        .drop("_strips", "_other")
        .repartition(min(4 * pairs, PAIR_PARTITIONS), "run_key", "a", "b")
    )


def _block_pairs(strip: np.ndarray, a: int, b: int, block_rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of blocks of row numbers that cover a strip pair; on the diagonal both are the same object."""

    def blocks(side: int) -> list[np.ndarray]:
        rows = np.nonzero(strip == side)[0]
        return [rows[s : s + block_rows] for s in range(0, len(rows), block_rows)]

    first = blocks(a)
    if a == b:
        return [(one, two) for i, one in enumerate(first) for two in first[i:]]
    # Those of a first block lead: they link all points.
    pairs = sorted(product(enumerate(first), enumerate(blocks(b))), key=lambda p: min(p[0][0], p[1][0]))
    return [(one, two) for (_, one), (_, two) in pairs]


def nearest(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run_key, id, nearest): the ``k`` nearest other points of the key as (distance, id), closest
    first, ties by id."""

    def closest(key: tuple, table: pa.Table) -> pa.Table:
        run_key, a, b = (x.as_py() for x in key)
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        ids, strip, x = table["id"].to_numpy()[order], table["strip"].to_numpy()[order], _vectors(table)[order]
        best, names = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        # Of equal vectors in a block, k others with the smallest ids are all that a point can have.
        few: dict[int, np.ndarray] = {}
        for one, two in _block_pairs(strip, a, b, block_rows):
            left = x[one]
            right = left if one is two else x[two]
            half, slack = _halves(left, right)
            for rows, cols, turned in ((one, two, False),) if one is two else ((one, two, False), (two, one, True)):
                if int(cols[0]) not in few:
                    few[int(cols[0])] = np.nonzero(_copies(x[cols]) <= k)[0]
                held, limit = few[int(cols[0])], np.square(best[rows, k - 1])
                for exact in (False, True):
                    if exact:
                        half, slack = _halves(left, right, exact)
                    own = half.T if turned else half
                    some = own if len(held) == len(cols) else own[:, held]
                    r, c = _candidates(some, limit, slack, k)
                    if len(r) <= CANDIDATES * len(rows):
                        break
                _keep_nearest(best, names, x, ids, rows, cols if len(held) == len(cols) else cols[held], r, c)
        row, place = np.nonzero(np.isfinite(best))
        d, other = best[row, place], names[row, place]
        return pa.table({"run_key": pa.array([run_key] * len(d), pa.string()), "id": ids[row], "d": d, "other": other})

    found = (
        _strip_pairs(_keyed(points), block_rows)
        .groupBy("run_key", "a", "b")
        .applyInArrow(closest, "run_key string, id bigint, d double, other bigint")
    )
    # At most k rows per point and strip partner reach this list.
    listed = F.array_sort(F.collect_list(F.struct(F.col("d").alias("distance"), F.col("other").alias("id"))))
    return found.groupBy("run_key", "id").agg(F.slice(listed, 1, k).alias("nearest"))


def core_distance(points: DataFrame, k: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run_key, id, core): distance to the k-th nearest other point; keys with k or fewer points
    have none."""
    core = F.get("nearest", F.lit(k - 1))["distance"].alias("core")
    return nearest(points, k, block_rows).select("run_key", "id", core).where("core IS NOT NULL")


def _projected(tables: int, bits: int, seed: int):
    """Each point with its code in every table: the sides of random hyperplanes that it lies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            x = _vectors(whole)
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))
            # Summed in a fixed order: a point's code must not depend on its batch.
            sides = np.einsum("ij,jk->ik", x, planes, optimize=False) > 0
            codes = sides.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            listed = pa.ListArray.from_arrays(offsets, pa.array(codes.astype(np.int64).ravel()))
            yield from whole.append_column("codes", listed).to_batches()

    return run


def approximate_nearest(
    points: DataFrame, k: int, tables: int = 8, bits: int = 4, seed: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """As ``nearest``, but only points that share a bucket are compared: a stated approximation.

    ``tables`` times, ``bits`` random hyperplanes through the origin cut the space into buckets; two
    vectors at an angle a share one with probability 1 - (1 - (1 - a / pi)^bits)^tables. Distances are
    exact, and every true neighbour that is met is returned; one that is met in no table is missing, and
    points without company have no row. Work falls to about tables / 2^bits of the exact join's. Buckets
    of any size are cut into strips like run keys, so copies of one vector don't fill a task.
    """
    keyed = _keyed(points)
    kind = keyed.schema["embedding"].dataType.simpleString()
    coded = pinned(keyed.mapInArrow(_projected(tables, bits, seed), f"run_key string, id bigint, embedding {kind}, codes array<bigint>"))
    buckets = coded.select("run_key", "id", "embedding", F.posexplode("codes").alias("table", "code"))
    bucket = F.to_json(F.struct("run_key", "table", "code"))
    found = nearest(buckets.select(bucket.alias("run_key"), "id", "embedding"), k, block_rows)
    pairs = found.select(F.get_json_object("run_key", "$.run_key").alias("run_key"), "id", F.explode("nearest").alias("n")).distinct()
    # At most k rows a table for each point.
    return pairs.groupBy("run_key", "id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("nearest"))


# -- spanning tree ---------------------------------------------------------------------------------


def _forests(points: DataFrame, block_rows: int) -> DataFrame:
    """Spanning forest of each strip pair over points[run_key, id, embedding, core]."""

    def between(one, two, ids, x, core, bound) -> tuple[np.ndarray, ...]:
        """Edges between two blocks, or within one, as weights and row numbers: the forest, or, where these are
        few, all that weigh no more than ``bound``."""
        left = x[one]
        right = left if one is two else x[two]
        if bound < np.inf:
            half, slack = _halves(left, right)
            i, j = _at_most(half, bound * bound, slack)
            some = (core[one[i]] <= bound) & (core[two[j]] <= bound) & ((i < j) if one is two else True)
            i, j = np.minimum(one[i[some]], two[j[some]]), np.maximum(one[i[some]], two[j[some]])
            if len(i) <= CANDIDATES * (len(one) + len(two)):
                w = np.maximum(np.maximum(core[i], core[j]), _distances_at(x, i, j))
                kept = w <= bound
                return w[kept], i[kept], j[kept]
        w2, slack = _squared(left, right)
        np.maximum(w2, np.maximum(np.square(core[one])[:, None], np.square(core[two])[None, :]), out=w2)
        if one is two:
            np.fill_diagonal(w2, np.inf)
        i, j = _possible_edges(w2, slack, one is two)
        i, j = np.minimum(one[i], two[j]), np.maximum(one[i], two[j])
        w = np.maximum(np.maximum(core[i], core[j]), _distances_at(x, i, j))
        kept = kruskal(w, ids[i], ids[j])
        return w[kept], i[kept], j[kept]

    def nearest_in(one, two, x, core) -> tuple[np.ndarray, ...]:
        """Edges from each row of two blocks to about the nearest one of the other."""
        left = x[one]
        half, _ = _halves(left, left if one is two else x[two])
        i = np.concatenate([np.arange(len(one)), half.argmax(axis=0)])
        j = np.concatenate([half.argmax(axis=1), np.arange(len(two))])
        i, j = np.minimum(one[i], two[j]), np.maximum(one[i], two[j])
        some = i < j
        i, j = i[some], j[some]
        return np.maximum(np.maximum(core[i], core[j]), _distances_at(x, i, j)), i, j

    def forest(key: tuple, table: pa.Table) -> pa.Table:
        run_key, a, b = (x.as_py() for x in key)
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        ids, strip, x = table["id"].to_numpy()[order], table["strip"].to_numpy()[order], _vectors(table)[order]
        core = table["core"].to_numpy()[order]
        edges = [(np.array([]), np.array([], int), np.array([], int))]

        bound, held = np.inf, 0

        def thin() -> float:
            """Keep the forest; its heaviest edge bounds what can still come in, once it is a tree of all points."""
            w, i, j = (np.concatenate(column) for column in zip(*edges))
            kept = kruskal(w, ids[i], ids[j])
            edges[:] = [(w[kept], i[kept], j[kept])]
            met = np.unique(np.concatenate([i[kept], j[kept]]))
            whole = len(met) == len(kept) + 1 and np.isin(compared, met).all()
            return float(w[kept].max()) if whole else np.inf

        seen: dict[int, tuple[np.ndarray, dict[bytes, int], list[tuple[int, bytes]]]] = {}

        def parted(rows: np.ndarray) -> tuple[np.ndarray, dict[bytes, int], list[tuple[int, bytes]]]:
            if int(rows[0]) not in seen:
                seen[int(rows[0])] = _parted(rows, x, core)
            return seen[int(rows[0])]

        pairs = _block_pairs(strip, a, b, block_rows)
        compared = np.unique(np.concatenate([np.array([], int), *(parted(rows)[0] for pair in pairs for rows in pair)]))
        if len(pairs) > 1:
            # A tree of few light edges that links all points bounds what can be in the forest.
            edges += [nearest_in(parted(one)[0], parted(two)[0], x, core) for one, two in pairs if one is pairs[0][0] or two is pairs[0][1]]
            bound, kept = thin(), edges[0]
            edges[:] = [kept] if bound < np.inf else [tuple(column[:0] for column in kept)]
            held = len(edges[0][0])
        for one, two in pairs:
            (own, heads, copies), (others, far_heads, far_copies) = parted(one), parted(two)
            edges.append(between(own, own if one is two else others, ids, x, core, bound))
            hung = [(far_heads[key], row) for row, key in copies if far_heads.get(key, row) < row]
            if one is not two:
                hung += [(heads[key], row) for row, key in far_copies if heads.get(key, row) < row]
            if hung:
                i, j = (np.array(side, int) for side in zip(*hung))
                edges.append((np.zeros(len(hung)), i, j))
            held += len(edges[-1][0])
            if held > FOREST_EDGES + len(compared) or (bound == np.inf and held > 1.5 * len(compared)):
                bound = min(bound, thin())
                held = len(edges[0][0])
        thin()
        w, i, j = edges[0]
        return _edges(run_key, w, ids[i], ids[j])

    return _strip_pairs(points, block_rows).groupBy("run_key", "a", "b").applyInArrow(forest, EDGE)


def _parted(rows: np.ndarray, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, dict[bytes, int], list[tuple[int, bytes]]]:
    """Rows of a block that are compared, the first of each kind at core distance 0, and its copies.

    An edge from such a copy to another kind weighs no less than the first one's and comes later, so a
    copy needs edges of weight 0 only: to the first of its kind in every block.
    """
    heads: dict[bytes, int] = {}
    copies: list[tuple[int, bytes]] = []
    for row in rows[core[rows] == 0].tolist():
        key = (x[row] + 0.0).tobytes()
        if heads.setdefault(key, row) != row:
            copies.append((row, key))
    return np.setdiff1d(rows, np.array([row for row, _ in copies], int)), heads, copies


def _largest(edges: DataFrame) -> int:
    """Edges of the run key that has most."""
    return edges.groupBy("run_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _by_run(edges: DataFrame, local: Callable, spread: Callable, schema: str, limit: int) -> DataFrame:
    """Finish run keys of at most ``limit`` edges in one task each, the others with joins."""
    if _largest(edges) <= limit:
        return edges.groupBy("run_key").applyInArrow(local, schema)
    sizes = edges.groupBy("run_key").agg(F.count("*").alias("_n"))
    small = edges.join(sizes.where(F.col("_n") <= limit), "run_key", "left_semi")
    large = edges.join(sizes.where(F.col("_n") > limit), "run_key", "left_semi")
    return small.groupBy("run_key").applyInArrow(local, schema).unionByName(spread(large))


def _edge() -> Column:
    return F.struct("w", "i", "j")


def _lightest(edges: DataFrame) -> DataFrame:
    """Lightest edge of every component over edges[run_key, w, i, j, ci, cj]; combines map-side."""
    both = edges.select("run_key", F.col("ci").alias("c"), F.col("cj").alias("to"), _edge().alias("e")).unionByName(
        edges.select("run_key", F.col("cj").alias("c"), F.col("ci").alias("to"), _edge().alias("e"))
    )
    return both.groupBy("run_key", "c").agg(F.min(F.struct("e", "to")).alias("m")).select(
        "run_key", "c", F.col("m.e").alias("e"), F.col("m.to").alias("to")
    )


def _roots(chosen: DataFrame) -> DataFrame:
    """(run_key, c, root) of the pointer forest c → to, whose only cycles are mutual pairs.

    Pointer jumping: each round doubles the reach, so a chain of n needs log2 n rounds.
    """
    back = chosen.select("run_key", F.col("c").alias("to"), F.col("to").alias("_back"))
    mutual = (F.col("_back") == F.col("c")) & (F.col("c") < F.col("to"))
    up = pinned(
        chosen.select("run_key", "c", "to")
        .join(back, ["run_key", "to"], "left")
        .groupBy("run_key", "c")
        .agg(F.max(F.when(mutual, F.col("c"))).alias("_self"), F.first("to").alias("_to"))
        .select("run_key", "c", F.coalesce("_self", "_to").alias("root"))
    )
    while True:
        above = up.select("run_key", F.col("c").alias("root"), F.col("root").alias("_above"))
        moved = (F.col("_above") != F.col("root")).alias("_moved")
        up = pinned(up.join(above, ["run_key", "root"]).select("run_key", "c", F.col("_above").alias("root"), moved))
        if up.where("_moved").isEmpty():
            return up.drop("_moved")


def _relabel(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges with their components replaced by the roots; edges inside one component drop out."""
    for end in ("ci", "cj"):
        named = roots.select("run_key", F.col("c").alias(end), F.col("root").alias("_root"))
        edges = edges.join(named, ["run_key", end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges.where("ci <> cj")


def _spread_tree(edges: DataFrame) -> DataFrame:
    """Spanning tree by Boruvka rounds; components at least halve, so rounds grow with log n."""
    rest = pinned(edges.select("*", F.col("i").alias("ci"), F.col("j").alias("cj")))
    tree = None
    while not rest.isEmpty():
        chosen = pinned(_lightest(rest))
        picked = chosen.select("run_key", "e.w", "e.i", "e.j").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        rest = pinned(_relabel(rest, _roots(chosen)))
    return edges.limit(0) if tree is None else tree


def mutual_reachability_mst(
    points: DataFrame, k: int = 2, block_rows: int = BLOCK_ROWS, local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """Edges (run_key, w, i, j), i < j, of the spanning tree of every run key."""
    return _by_run(_all_forests(pinned(_keyed(points)), k, block_rows, local_edges), _finish_tree, _spread_tree, EDGE, local_edges)


def _all_forests(points: DataFrame, k: int, block_rows: int, local_edges: int) -> DataFrame:
    """Forests of all strip pairs of points[run_key, id, embedding], thinned."""
    scored = pinned(points.join(core_distance(points, k, block_rows), ["run_key", "id"]))
    return _thinned(pinned(_forests(scored, block_rows)), local_edges)


def _thinned(edges: DataFrame, local_edges: int) -> DataFrame:
    """Edges without those that are in no forest of their share. Shares hold about 2 x ``local_edges``; it
    ends when every run key has at most ``local_edges``, or when little more goes."""
    before, largest = edges.count(), _largest(edges)
    while largest > local_edges:
        sizes = edges.groupBy("run_key").agg(F.ceil(F.count("*") / (2 * local_edges)).alias("_shares"))
        share = F.pmod(F.xxhash64("i", "j"), F.col("_shares")).alias("_share")
        dealt = edges.join(sizes, "run_key").select("run_key", "w", "i", "j", share)
        edges = pinned(dealt.groupBy("run_key", "_share").applyInArrow(_finish_tree, EDGE))
        after, largest = edges.count(), _largest(edges)
        if after > 0.8 * before:
            break
        before = after
    return edges


def _finish_tree(table: pa.Table) -> pa.Table:
    kept = kruskal(table["w"].to_numpy(), table["i"].to_numpy(), table["j"].to_numpy())
    return table.select(["run_key", "w", "i", "j"]).take(pa.array(kept))


# -- leaf clusters ---------------------------------------------------------------------------------

# With clusters of at least two points, the leaves of the condensed tree can be read off the
# spanning tree without building it. Every point first joins others over its own lightest edge, so
# the trees of lightest edges ("seeds") are exactly the growing clusters: a leaf is one such tree,
# less the points that would join only after the tree's lightest outgoing edge has merged it with
# another one. Merging at eps unites seeds over outgoing edges up to eps, except the heaviest of
# all: that one is the split below the root, and the root is never a cluster.

LEAF = "run_key string, id bigint, cluster bigint"


def leaf_clusters(
    tree: DataFrame, epsilon: float = 0.2, local_edges: int = LOCAL_EDGES, min_cluster_size: int = 2
) -> DataFrame:
    """(run_key, id, cluster) of the clustered points; ``cluster`` is its smallest member."""

    def local(table: pa.Table) -> pa.Table:
        return _read_clusters(table, epsilon, min_cluster_size)

    def spread(edges: DataFrame) -> DataFrame:
        return _spread_leaves(edges, epsilon, min_cluster_size)

    return _by_run(tree, local, spread, LEAF, local_edges)


def _read_leaves(table: pa.Table, epsilon: float) -> pa.Table:
    """Leaves of one run key whose spanning tree fits a task."""
    w, i, j = (table[c].to_numpy() for c in ("w", "i", "j"))
    order = np.lexsort((j, i, w))
    i, j, w = i[order], j[order], w[order]
    names, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(w)], flat[len(w) :]
    place = np.arange(len(w))
    first = np.full(len(names), len(w))
    np.minimum.at(first, a, place)
    np.minimum.at(first, b, place)
    seed = np.zeros(len(w), dtype=bool)
    seed[first] = True
    outer = np.nonzero(~seed)[0]
    found, cluster = np.array([], int), np.array([], int)
    if len(outer):
        inner = seed.copy()
        inner[outer[:-1][w[outer[:-1]] <= epsilon]] = True
        group = _components(len(names), a[inner], b[inner])
        closing = np.full(len(names), len(w))
        crossing = outer[group[a[outer]] != group[b[outer]]]
        np.minimum.at(closing, group[a[crossing]], crossing)
        np.minimum.at(closing, group[b[crossing]], crossing)
        found = np.nonzero(first < closing[group])[0]
        smallest = np.full(len(names), names[-1])
        np.minimum.at(smallest, group[found], names[found])
        cluster = smallest[group[found]]
    return pa.table(
        {
            "run_key": pa.array([table["run_key"][0].as_py()] * len(found), pa.string()),
            "id": pa.array(names[found], pa.int64()),
            "cluster": pa.array(cluster, pa.int64()),
        }
    )


def _read_clusters(table: pa.Table, epsilon: float, least: int) -> pa.Table:
    return _read_leaves(table, epsilon) if least == 2 else _read_condensed(table, epsilon, least)


def _read_condensed(table: pa.Table, epsilon: float, least: int) -> pa.Table:
    """Leaves of the condensed tree for clusters of ``least`` points, of one run key that fits a task.

    Edges join components in order. One that reaches ``least`` points begins a cluster; it takes in what
    is smaller, and ends where it meets another cluster, unless they meet within ``epsilon`` and below
    the root: then both go on as one. Points that come later belong to none.
    """
    w, i, j = (table[c].to_numpy() for c in ("w", "i", "j"))
    order = np.lexsort((j, i, w))
    names, flat = np.unique(np.concatenate([i[order], j[order]]), return_inverse=True)
    a, b, w = flat[: len(w)].tolist(), flat[len(w) :].tolist(), w[order].tolist()
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    merges: list[tuple[int, int, bool]] = []  # roots that an edge joins, and whether both are clusters
    size, top = [1] * len(names), -1
    for e in range(len(w)):
        x, y = find(a[e]), find(b[e])
        x, y = (x, y) if size[x] >= size[y] else (y, x)
        both = size[y] >= least
        top = e if both else top
        merges.append((x, y, both))
        up[y] = x
        size[x] += size[y]

    found, cluster = [], []
    if top >= 0:
        size = [1] * len(names)
        loose = {x: [x] for x in range(len(names))}  # points of components that are no cluster yet
        open_: dict[int, list[int]] = {}  # points of the cluster that a component is
        done: list[list[int]] = []
        for e, (x, y, both) in enumerate(merges):
            if both:
                if w[e] <= epsilon and e != top and x in open_ and y in open_:
                    open_[x] += open_.pop(y)
                else:
                    done += [open_.pop(side) for side in (x, y) if side in open_]
            else:
                points = loose.pop(y)
                if x in loose:
                    loose[x] += points
                    if size[x] + size[y] >= least:
                        open_[x] = loose.pop(x)
                elif x in open_:
                    open_[x] += points
            size[x] += size[y]
        for points in done:
            found += points
            cluster += [min(points)] * len(points)
    return pa.table(
        {
            "run_key": pa.array([table["run_key"][0].as_py()] * len(found), pa.string()),
            "id": pa.array(names[found] if found else [], pa.int64()),
            "cluster": pa.array(names[cluster] if cluster else [], pa.int64()),
        }
    )


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], int)


def _spread_seeds(tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaves of the condensed tree before any merging, with joins: (run_key, id, group), the tree's edges
    between the groups as ``ci``, ``cj``, and (run_key, id, _first) of the points that came to their
    group's component only after it had met another one, with the edge that brought them.

    In a round every component of fewer than ``least`` points follows its lightest edge. What hangs
    together this way grows from one place in the order of the edges, up to the lightest edge that leaves
    it; so much is contracted, and components stay what the edges in order make them. A component of
    ``least`` points waits; it is closed once its lightest edge leads to another such component, and what
    follows its edge to a closed one comes late. Edges between closed components are settled. The least
    edge of every round is contracted, or closes both its ends, or is settled, so the rounds end; as a rule
    components at least halve.
    """
    edge = "struct<w: double, i: bigint, j: bigint>"
    ids = pinned(tree.select("run_key", F.explode(F.array("i", "j")).alias("id")).distinct())
    points = ids.select("run_key", "id", F.col("id").alias("c"), F.lit(None).cast(edge).alias("_first"))
    comps = ids.select("run_key", F.col("id").alias("c"), F.lit(1).cast("bigint").alias("size"), F.lit(False).alias("closed"))
    edges = pinned(tree.select("run_key", "w", "i", "j", F.col("i").alias("ci"), F.col("j").alias("cj")))
    settled = [edges.limit(0)]
    big = F.col("size") >= least
    while not edges.isEmpty():
        other = comps.select("run_key", F.col("c").alias("to"), big.alias("_big"))
        state = comps.join(_lightest(edges), ["run_key", "c"], "left").join(other, ["run_key", "to"], "left")
        state = pinned(state.withColumn("closed", F.col("closed") | (big & F.coalesce("_big", F.lit(False)))).drop("_big"))
        follow = state.where(big | F.col("to").isNotNull()).select("run_key", "c", F.when(big, F.col("c")).otherwise(F.col("to")).alias("to"))
        roots = pinned(_roots(follow))
        leaving = _lightest(_relabel(edges, roots)).select("run_key", F.col("c").alias("root"), F.col("e").alias("_leaving"))
        ends = state.select("run_key", F.col("c").alias("root"), F.col("closed").alias("_late"))
        moves = (F.col("c") != F.col("root")) & (F.col("_late") | F.col("_leaving").isNull() | (F.col("e") < F.col("_leaving")))
        moved = pinned(
            roots.join(ends, ["run_key", "root"])
            .join(leaving, ["run_key", "root"], "left")
            .join(state.select("run_key", "c", "e"), ["run_key", "c"])
            .where(moves)
            .select("run_key", "c", "root", F.when(F.col("_late"), F.col("e")).alias("_when"))
        )
        points = pinned(
            points.join(moved, ["run_key", "c"], "left").select(
                "run_key", "id", F.coalesce("root", "c").alias("c"), F.coalesce("_first", "_when").alias("_first")
            )
        )
        comps = pinned(
            state.join(moved, ["run_key", "c"], "left")
            .groupBy("run_key", F.coalesce("root", "c").alias("c"))
            .agg(F.sum("size").alias("size"), F.max("closed").alias("closed"))
        )
        shut = comps.where("closed").select("run_key", F.col("c").alias("ci"), F.lit(True).alias("_i"))
        rest = _relabel(edges, moved.select("run_key", "c", "root")).join(shut, ["run_key", "ci"], "left")
        rest = pinned(rest.join(shut.select("run_key", F.col("ci").alias("cj"), F.col("_i").alias("_j")), ["run_key", "cj"], "left"))
        settled.append(rest.where("_i AND _j").drop("_i", "_j"))
        edges = pinned(rest.where("_i IS NULL OR _j IS NULL").drop("_i", "_j"))
    outer = settled[0]
    for part in settled[1:]:
        outer = outer.unionByName(part)
    return points.select("run_key", "id", F.col("c").alias("group")), pinned(outer), points.select("run_key", "id", "_first")


def _spread_leaves(tree: DataFrame, epsilon: float, least: int = 2) -> DataFrame:
    """The same reading of the tree with joins, for run keys of any size."""
    if least == 2:
        edges = pinned(tree.select("run_key", "w", "i", "j", F.col("i").alias("ci"), F.col("j").alias("cj")))
        chosen = pinned(_lightest(edges))
        group = _roots(chosen).select("run_key", F.col("c").alias("id"), F.col("root").alias("group"))
        outer = pinned(_relabel(edges, group.select("run_key", F.col("id").alias("c"), F.col("group").alias("root"))))
        first = chosen.select("run_key", F.col("c").alias("id"), F.col("e").alias("_first"))
    else:
        group, outer, first = _spread_seeds(tree, least)
    top = outer.groupBy("run_key").agg(F.max(_edge()).alias("_top"))
    merge = pinned(
        outer.join(top, "run_key").where((_edge() < F.col("_top")) & (F.col("w") <= epsilon)).drop("_top")
    )
    while not merge.isEmpty():
        roots = _roots(pinned(_lightest(merge)))
        moved = roots.select("run_key", F.col("c").alias("group"), F.col("root").alias("_root"))
        group = pinned(
            group.join(moved, ["run_key", "group"], "left").select("run_key", "id", F.coalesce("_root", "group").alias("group"))
        )
        outer, merge = pinned(_relabel(outer, roots)), pinned(_relabel(merge, roots))
    closing = _lightest(outer).select("run_key", F.col("c").alias("group"), F.col("e").alias("_closing"))
    members = (
        group.join(first, ["run_key", "id"])
        .join(closing, ["run_key", "group"])
        .where(F.col("_first").isNull() | (F.col("_first") < F.col("_closing")))
    )
    names = members.groupBy("run_key", "group").agg(F.min("id").alias("cluster"))
    return members.join(names, ["run_key", "group"]).select("run_key", "id", "cluster")


def hdbscan(
    points: DataFrame,
    min_samples: int = 2,
    min_cluster_size: int = 2,
    method: str = "leaf",
    epsilon: float = 0.2,
    block_rows: int = BLOCK_ROWS,
    local_edges: int = LOCAL_EDGES,
) -> DataFrame:
    """points[(run_key,) id, embedding] → (run_key, id, label), one label per point.

    A label is the smallest member id of its cluster; noise is -1. A key with fewer than three
    points is all noise.
    """
    if method != "leaf" or min_cluster_size < 2:
        raise ValueError("only leaf selection of clusters of two points or more is supported")
    points = pinned(_keyed(points))
    forests = _all_forests(points, min_samples, block_rows, local_edges)

    def finish(table: pa.Table) -> pa.Table:
        return _read_clusters(_finish_tree(table), epsilon, min_cluster_size)

    if _largest(forests) <= local_edges:
        leaves = forests.groupBy("run_key").applyInArrow(finish, LEAF)
    else:
        tree = pinned(_by_run(forests, _finish_tree, _spread_tree, EDGE, local_edges))
        leaves = leaf_clusters(tree, epsilon, local_edges, min_cluster_size)
    leaves = leaves.withColumnRenamed("cluster", "label")
    noise = F.lit(-1).cast("bigint")
    return (
        points.select("run_key", "id")
        .join(leaves, ["run_key", "id"], "left")
        .withColumn("label", F.coalesce("label", noise))
    )


def cluster_articles(articles: DataFrame, epsilon: float = 0.2, **options) -> DataFrame:
    """One window of articles[id, published_at, embedding] → (id, published_at, label), where every
    article ends in exactly one cluster: noise becomes clusters of one, newest first."""
    labels = hdbscan(articles.select("id", "embedding"), epsilon=epsilon, **options).drop("run_key")
    return assign_singletons(pinned(articles.select("id", "published_at").join(labels, "id")))
