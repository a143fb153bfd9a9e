import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from newsloom.operators import density as D
from tests.brute import leaf_labels, tree_edges


def frame(spark, x, ids=None, run_key=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in p]) for i, p in zip(ids, x)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    return df if run_key is None else df.selectExpr(f"'{run_key}' AS run_key", "*")


def collected_labels(df):
    return {r.id: r.label for r in df.collect()}


def clouds(seed=1, n=120, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim)) * 3
    x = centers[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.4
    x[:10] = x[10:20]  # pairs of copies
    x[30:35] = x[35]  # six copies of one point
    return x


@pytest.fixture(scope="module")
def sample(spark):
    x = clouds()
    ids = np.random.default_rng(2).permutation(len(x)) * 3
    edges, core = tree_edges(x, ids)
    return x, ids, edges, core


def test_core_distance(spark, sample):
    x, ids, _, core = sample
    got = {r.id: r.core for r in D.core_distance(frame(spark, x, ids), block_rows=25).collect()}
    assert got == core


@pytest.mark.parametrize("block_rows, local_edges", [(1024, 10**6), (25, 10**6), (40, 3)])
def test_spanning_tree_is_exact(spark, sample, block_rows, local_edges):
    """Any block size, and the joins that replace the local finish, give the same edges."""
    x, ids, edges, _ = sample
    tree = D.mutual_reachability_mst(frame(spark, x, ids), block_rows=block_rows, local_edges=local_edges)
    assert sorted((r.w, r.i, r.j) for r in tree.collect()) == sorted(edges)


@pytest.mark.parametrize("epsilon", [0.0, 0.6, 1.5, 50.0])
def test_leaf_labels(spark, sample, epsilon):
    x, ids, edges, _ = sample
    want = leaf_labels(edges, ids, epsilon)
    tree = spark.createDataFrame([("0", *e) for e in edges], D.EDGE)
    for limit in (10**6, 3):
        got = dict.fromkeys(map(int, ids), -1)
        got.update({r.id: r.cluster for r in D.leaf_clusters(tree, epsilon, local_edges=limit).collect()})
        assert got == want
    assert len({c for c in want.values() if c >= 0}) >= 2


@pytest.mark.parametrize("least", [2, 3, 4, 5, 9])
@pytest.mark.parametrize("epsilon", [0.0, 0.6, 1.5, 50.0])
def test_condensed_tree_of_any_size(sample, least, epsilon):
    """The reading of one run key in a task, for clusters of several sizes."""
    _, ids, edges, _ = sample
    table = pa.table({"run_key": ["0"] * len(edges), **{c: [e[k] for e in edges] for k, c in enumerate("wij")}})
    got = dict.fromkeys(map(int, ids), -1)
    got.update(zip(*(D._read_condensed(table, epsilon, least)[c].to_pylist() for c in ("id", "cluster"))))
    assert got == leaf_labels(edges, ids, epsilon, least)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 40), st.integers(2, 6), st.sampled_from([0.0, 0.8, 2.0]))
def test_condensed_tree_of_random_clouds(seed, n, least, epsilon):
    x = np.random.default_rng(seed).normal(size=(n, 2)) * 2
    ids = np.arange(n)
    edges, _ = tree_edges(x, ids)
    table = pa.table({"run_key": ["0"] * len(edges), **{c: [e[k] for e in edges] for k, c in enumerate("wij")}})
    got = dict.fromkeys(range(n), -1)
    got.update(zip(*(D._read_condensed(table, epsilon, least)[c].to_pylist() for c in ("id", "cluster"))))
    assert got == leaf_labels(edges, ids, epsilon, least)


def test_condensed_tree_with_joins(spark):
    """The join form, which has no task per run key."""
    ids = np.arange(36)
    edges = tree_edges(clouds(9, 36, 2), ids)[0]
    slices = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        tree = spark.createDataFrame([("0", *e) for e in edges], D.EDGE).coalesce(1)
        got = dict.fromkeys(range(36), -1)
        got.update({r.id: r.cluster for r in D.leaf_clusters(tree, 0.5, local_edges=3, min_cluster_size=3).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", slices)
    want = leaf_labels(edges, ids, 0.5, 3)
    assert got == want and len(set(want.values())) > 2


def test_approximate_neighbours_are_mostly_the_nearest(spark):
    """Sixteen tables of four planes on clustered vectors: 0.9 of the three nearest, each at its distance."""
    x = clouds(7, 400, 16)
    points = frame(spark, x)
    exact = {r.id: [(n.distance, n.id) for n in r.nearest] for r in D.nearest(points, 3).collect()}
    found = {r.id: [(n.distance, n.id) for n in r.nearest] for r in D.approximate_nearest(points, 3, tables=16, bits=4, block_rows=64).collect()}
    met = sum(len(set(exact[i]) & set(found.get(i, []))) for i in exact)
    assert met >= 0.9 * sum(map(len, exact.values()))
    for i, row in found.items():
        assert row == sorted(row) and len({j for _, j in row}) == len(row)
        assert all(abs(d - float(np.sqrt(np.square(x[i] - x[j]).sum()))) < 1e-12 for d, j in row)


def test_input_order_does_not_matter(spark, sample):
    x, ids, _, _ = sample
    flipped = frame(spark, x[::-1], ids[::-1])
    assert collected_labels(D.hdbscan(flipped, epsilon=0.6)) == collected_labels(D.hdbscan(frame(spark, x, ids), epsilon=0.6))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_inputs(spark, n):
    x = np.arange(n)[:, None] * 1.0
    assert collected_labels(D.hdbscan(frame(spark, x))) == {i: -1 for i in range(n)}


def test_two_groups_and_noise(spark):
    x = np.array([[0, 0], [0, 0.1], [0.1, 0], [5, 5], [5, 5.1], [5.1, 5], [2.5, -9]])
    assert collected_labels(D.hdbscan(frame(spark, x))) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: -1}


def test_run_keys_are_independent(spark):
    one, two = clouds(3, 40), clouds(4, 60)
    both = frame(spark, one, run_key="a").unionByName(frame(spark, two, run_key="b"))
    got = D.hdbscan(both, epsilon=0.6, block_rows=16)
    for key, x in (("a", one), ("b", two)):
        ids = np.arange(len(x))
        assert collected_labels(got.where(f"run_key = '{key}'")) == leaf_labels(tree_edges(x, ids)[0], ids, 0.6)


def test_hot_copies(spark):
    """A third of all points are one vector; results stay whole and exact."""
    x = clouds(5, 90)
    x[40:70] = x[40]
    ids = np.arange(90)
    got = collected_labels(D.hdbscan(frame(spark, x), block_rows=20, epsilon=0.6))
    assert got == leaf_labels(tree_edges(x, ids)[0], ids, 0.6)


def test_unsupported_options(spark):
    with pytest.raises(ValueError):
        D.hdbscan(frame(spark, clouds()), method="eom")


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=2, max_size=24))
def test_block_candidates_keep_every_tie(points):
    """On a small grid nearly everything ties; the pruned edges must still hold the exact tree."""
    x = np.array(points, float)
    ids = np.arange(len(x))
    edges, core = (tree_edges(x, ids) if len(x) > 2 else ([], {}))
    if not edges:
        return
    c = np.array([core[i] for i in ids])
    w2, slack = D._squared(x, x)
    w2 = np.maximum(w2, np.square(np.maximum(c[:, None], c[None, :])))
    np.fill_diagonal(w2, np.inf)
    i, j = D._possible_edges(w2, slack)
    w = np.maximum(np.maximum(c[i], c[j]), D.exact_distances(x[i], x[j]))
    kept = D.kruskal(w, ids[i], ids[j])
    assert sorted(zip(w[kept], i[kept], j[kept])) == sorted(edges)


def test_points_are_not_sent_once_per_block(spark):
    """Many blocks share a strip, and many run keys stay whole: rows follow the points."""
    points = D._keyed(frame(spark, np.zeros((400, 2))))
    assert D._strip_pairs(points, 4).count() <= 400 * D.STRIPS
    keys = points.withColumn("run_key", (points.id % 50).cast("string"))
    assert D._strip_pairs(keys, 4).count() == 400


def test_points_of_one_key_stay_spread(spark):
    """The sizes of the keys come to the points, not the points of a key to one task."""
    points = spark.range(3000, numPartitions=6).selectExpr("string(id div 100000) AS run_key", "id", "array(double(id)) AS embedding")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = D._strip_pairs(points, 100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("scale", [1.0, 1e-22, 1e22])
def test_single_precision_decides_nothing(scale):
    """All pairs up to a squared distance pass, near copies and vectors beyond single precision too."""
    x = np.concatenate([clouds(seed=8), clouds(seed=8) + 1e-9]) * scale
    d2 = np.square(x[:, None] - x[None]).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    half, slack = D._halves(x, x)
    for square in (0.0, 1e-18 * scale**2, float(np.median(d2))):
        r, c = D._at_most(half, square, slack)
        assert set(zip(*np.nonzero(d2 <= square))) <= set(zip(r, c)) and not (r == c).any()


def test_kruskal_equals_union_find():
    rng = np.random.default_rng(9)
    for _ in range(50):
        n, m = rng.integers(2, 30), rng.integers(0, 90)
        i, j, w = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 5, m).astype(float)
        up, want = list(range(n)), []
        for e in np.lexsort((j, i, w)).tolist():
            if up[i[e]] != up[j[e]]:
                old, new = up[i[e]], up[j[e]]
                up = [new if u == old else u for u in up]
                want.append(e)
        assert D.kruskal(w, i, j).tolist() == want


def test_forests_are_thinned_before_joins(spark):
    """Edges of all strip pairs come down to less than two trees, so a tree that fits a task is finished there."""
    points = D._keyed(frame(spark, clouds(seed=5, n=300)))
    assert D._all_forests(points, 2, 10, 400).count() <= 400


def test_nearest_over_strips_and_copies(spark):
    x = np.concatenate([clouds(seed=6, n=150), np.ones((90, 6)), np.ones((3, 6)) * 4])
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    got = {r.id: [(n.distance, n.id) for n in r.nearest] for r in D.nearest(frame(spark, x), 3, block_rows=16).collect()}
    for i in range(len(x)):
        assert got[i] == sorted((d[i, j], j) for j in range(len(x)) if j != i)[:3]


def test_tree_of_many_copies(spark):
    x = np.concatenate([clouds(seed=7, n=60), np.ones((80, 6)), np.ones((2, 6)) * 4])
    ids = np.random.default_rng(3).permutation(len(x))
    edges, _ = tree_edges(x, ids)
    tree = D.mutual_reachability_mst(frame(spark, x, ids), block_rows=16)
    assert sorted((r.w, r.i, r.j) for r in tree.collect()) == sorted(edges)


def test_strips_of_many_blocks_keep_the_tree(spark):
    """Once the points of a strip pair are linked, only edges up to the heaviest link are looked at."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(size=(3, 3)) * 30])
    edges, _ = tree_edges(x, np.arange(len(x)))
    whole = D._keyed(frame(spark, x)).withColumn("run_key", (D.F.col("id") * 0).cast("string"))
    others = D._keyed(frame(spark, rng.normal(size=(6000, 3)), np.arange(10_000, 16_000))).withColumn("run_key", D.F.lit("1"))
    tree = D.mutual_reachability_mst(whole.unionByName(others), block_rows=20).where("run_key = '0'")
    assert sorted((r.w, r.i, r.j) for r in tree.collect()) == sorted(edges)
