"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Forest, groups, salted_join
from newsloom.llm.graph import components
from newsloom.session import pinned

#: Blocks of a rotated vector, and the seed of the rotation.
BLOCKS, SEED = 8, 7
#: Vectors of one shard of a cell; a larger cell is cut into hashed shards and every pair of them is met.
SHARD = 2048
#: Grid cells are this many radii wide.
WIDTH = 4.0
#: Added to squared budgets, so rounding loses no pair.
SLACK = 1e-9


def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def unit_rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated frame. Without BLAS, so a row's result never depends on the others."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors, optimize=False))[:, None]
    return np.einsum("ij,kj->ik", unit, rotation(vectors.shape[1]), optimize=False)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    top = np.einsum("ij,ij->i", a, b, optimize=False)
    return top / np.sqrt(np.einsum("ij,ij->i", a, a, optimize=False) * np.einsum("ij,ij->i", b, b, optimize=False))


def budgets(size: int, least: float) -> tuple[list[slice], np.ndarray]:
    """Blocks of coordinates and each one's share of the squared distance, by its dimensions.
    If the whole distance is within 2 - 2 cos, some block is within its share."""
    count = min(BLOCKS, size)
    edges = [size * i // count for i in range(count + 1)]
    total = 2 - 2 * least
    return [slice(a, b) for a, b in itertools.pairwise(edges)], np.array([total * (b - a) / size + SLACK for a, b in itertools.pairwise(edges)])


def probes(point: np.ndarray, budget: float) -> tuple[tuple[int, ...], list[tuple[int, ...]]]:
    """The cell of a point, and every other cell within the budget of it."""
    width = WIDTH * budget**0.5
    home = np.floor(point / width + 0.5).astype(int)
    low = (point - (home - 0.5) * width) ** 2
    high = ((home + 0.5) * width - point) ** 2
    found: list[tuple[tuple[int, ...], float]] = [((), 0.0)]
    for h, a, b in zip(home.tolist(), low.tolist(), high.tolist(), strict=True):
        grown = []
        for cell, used in found:
            grown.append(((*cell, h), used))
            if used + a <= budget:
                grown.append(((*cell, h - 1), used + a))
            if used + b <= budget:
                grown.append(((*cell, h + 1), used + b))
        found = grown
    return tuple(home.tolist()), [c for c, _ in found if c != tuple(home.tolist())]


def _cells(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            lists = batch.column("embedding").to_pylist()
            reps, labels = batch.column("rep").to_pylist(), batch.column("label").to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(lists):
                by_size.setdefault(len(v), []).append(k)
            for size, at in by_size.items():
                slices, shares = budgets(size, least)
                for k, full in zip(at, unit_rotated(np.array([lists[k] for k in at], np.float64)), strict=True):
                    for block, (part_of, share) in enumerate(zip(slices, shares.tolist(), strict=True)):
                        home, others = probes(full[part_of], share)
                        for cell in (home, *others):
                            # The hash stands for (size, cell); cells that share one only add work.
                            rows.append((reps[k], labels[k], block, hash((size, *cell)), cell == home))
            if rows:
                columns = zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.bool_()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["rep", "label", "block", "cell", "own"])

    return run


def _first_block(a: np.ndarray, b: np.ndarray, slices: list[slice], shares: np.ndarray) -> np.ndarray:
    """The first block of each pair of rotated rows that is within its budget."""
    first = np.full(len(a), len(slices))
    for k in range(len(slices) - 1, -1, -1):
        step = a[:, slices[k]] - b[:, slices[k]]
        first[np.einsum("ij,ij->i", step, step, optimize=False) <= shares[k]] = k
    return first


def _meet(least: float):
    """Per pair of shards of a cell: range-join its block, verify, and count each link in one place.

    A pair belongs to the first block whose budget it keeps, and there to the home cell of the larger
    id. Returned are each class's linked rows found here, and a forest of the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ("label", "block", "cell", "i", "j")):
            if rows.num_rows < 2:
                continue
            block = rows.column("block")[0].as_py()
            same = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
            lists = rows.column("embedding").to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(lists):
                by_size.setdefault(len(v), []).append(k)
            added: dict[int, int] = {}
            forest = Forest()
            for size, at in by_size.items():
                slices, shares = budgets(size, least)
                if len(at) < 2 or block >= len(slices):
                    continue
                part = rows.take(pa.array(at))
                rep, weight, home, first = (part.column(c).to_numpy() for c in ("rep", "weight", "own", "first"))
                raw = np.array([lists[k] for k in at], np.float64)
                turned = unit_rotated(raw)
                own = turned[:, slices[block]]
                square = np.einsum("ij,ij->i", own, own)
                left = np.arange(len(at)) if same else np.flatnonzero(first)
                right = left if same else np.flatnonzero(~first)
                for i in range(0, len(left), 256):
                    x = left[i : i + 256]
                    near = square[x][:, None] + square[right][None, :] - 2 * own[x] @ own[right].T <= shares[block] + 1e-9
                    near &= (rep[x][:, None] < rep[right][None, :]) if same else (rep[x][:, None] != rep[right][None, :])
                    # The larger id must be at home here.
                    big_home = np.where(rep[x][:, None] < rep[right][None, :], home[right][None, :], home[x][:, None])
                    a, b = np.nonzero(near & big_home)
                    for k in range(0, len(a), 1 << 14):
                        p, q = x[a[k : k + (1 << 14)]], right[b[k : k + (1 << 14)]]
                        mine = _first_block(turned[p], turned[q], slices, shares) == block
                        p, q = p[mine], q[mine]
                        linked = cosines(raw[p], raw[q]) >= least
                        for u, v in zip(p[linked].tolist(), q[linked].tolist(), strict=True):
                            ru, rv = int(rep[u]), int(rep[v])
                            added[ru] = added.get(ru, 0) + int(weight[v])
                            added[rv] = added.get(rv, 0) + int(weight[u])
                            forest.union(ru, rv)
            if added:
                ids = list(added)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([added[x] for x in ids], pa.int64()), pa.array([forest.find(x) for x in ids], pa.int64())],
                    names=["rep", "n", "root"],
                )

    return run


def vector_groups(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``least``. Vectors that are null, empty, all zero, or hold a null or a
    component that isn't finite link with nothing, like rows without an id. ``component_id`` is the
    smallest vec_id reachable; ``kept`` marks it. Rows that repeat an id are rows of their own.

    Equal vectors of a label are one class with a weight, so copies are never paired. Unit vectors
    are rotated and cut into blocks; a pair within the whole squared distance keeps some block's
    share of it (the pigeonhole), so each block is range-joined on a grid: a vector goes to its cell
    and to every cell within the share. Cells larger than a shard are cut into shards, and each pair
    of shards is a task of bounded memory. Each candidate is verified on all coordinates.
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).alias("embedding"),
    )
    kind = rows.schema["embedding"].dataType.elementType
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & finite & F.exists("embedding", lambda x: x != 0.0)
    )
    # The sign of a zero makes no difference to a cosine, but it would part equal vectors.
    plain = F.transform("embedding", lambda x: F.when(x == 0.0, F.lit(0.0).cast(kind)).otherwise(x))
    named = rows.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), F.struct("label", plain.alias("embedding"))).alias("v"))
    named = pinned(named.select("vec_id", "v.label", "v.embedding", F.xxhash64("v.label", "v.embedding").alias("name")))
    classes = pinned(
        named.where("embedding IS NOT NULL").groupBy("name", "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    )
    cells = pinned(
        classes.select("rep", "label", "embedding").mapInArrow(_cells(least), "rep long, label long, block long, cell long, own boolean")
    )
    keys = ["label", "block", "cell"]
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select(*keys, F.ceil(F.col("n") / SHARD).cast("int").alias("shards"))
    met = cells.join(sizes, keys).join(classes.select("rep", "weight", "embedding"), "rep").withColumn("home", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        *keys, F.least("home", "other").cast("bigint").alias("i"), F.greatest("home", "other").cast("bigint").alias("j"),
        (F.col("home") <= F.col("other")).alias("first"), "own", "rep", "weight", "embedding",
    )
    keys = [*keys, "i", "j"]
    found = pinned(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_meet(least), "rep long, n long, root long"))
    degrees = found.groupBy("rep").agg(F.sum("n").alias("n"))
    tree = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(degrees, "rep", "left").join(tree, "rep", "left").select(
        "name", "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    slim = known.select("name", F.struct("label", "embedding").alias("v"), "n_links", "component_id")
    out = salted_join(named.select("vec_id", "name", F.struct("label", "embedding").alias("w")), slim, "name", F.col("vec_id"), "left")
    mine = F.col("v") == F.col("w")
    return out.where(F.col("v").isNull() | mine).select(
        "vec_id",
        F.coalesce(F.when(mine, F.col("n_links")), F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce(F.when(mine, F.col("component_id")), F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
