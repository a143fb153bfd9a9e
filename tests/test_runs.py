from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import clusters as C
from newsloom.operators import store
from newsloom.plans import runs

NOW = datetime(2025, 7, 4, 12, 0, 0)


def articles(spark, rows):
    """rows: id, hours before NOW, position on a line."""
    data = [(i, f"Title {i}", [float(p), 0.0], NOW - timedelta(hours=h)) for i, h, p in rows]
    return spark.createDataFrame(data, "id bigint, title string, embedding array<double>, published_at timestamp")


# Three stories of three articles (the last one stale) and a loner far from all of them.
FIRST = [
    (1, 30, 0), (2, 29, 0.1), (3, 28, 0.2),
    (4, 27, 50), (5, 26, 50.1), (13, 27.5, 50.2),
    (6, 25, 300),
    (7, 90, 100), (8, 91, 100.1), (14, 92, 100.2),
]
A, B, LONER, STALE = frozenset({1, 2, 3}), frozenset({4, 5, 13}), frozenset({6}), frozenset({7, 8, 14})


def stored_members(tables):
    rows = tables.memberships.join(tables.clusters.select(F.col("id").alias("cluster_id"), "title", "slug"), "cluster_id").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.cluster_id, r.title, r.slug), set()).add(r.article_id)
    return {frozenset(v): k for k, v in groups.items()}


def latest(spark, path):
    stored = runs.read_runs(spark, path)
    run_id = C.latest_run(stored.run).first().id
    pick = lambda df: df.where(F.col("run_id") == run_id)
    return runs.RunTables(stored.run.where(F.col("id") == run_id), pick(stored.clusters), pick(stored.memberships))


@pytest.fixture()
def first(spark, tmp_path):
    path = str(tmp_path)
    base = articles(spark, FIRST)
    runs.write_cluster_run(runs.bootstrap_run(base, 1, 1, NOW - timedelta(hours=24)), path)
    return path, base


def test_bootstrap(spark, first):
    path, _ = first
    got = stored_members(latest(spark, path))
    assert set(got) == {A, B, LONER, STALE}
    assert got[A][1] == "Title 3"
    slugs = [k[2] for k in got.values()]
    assert len(set(slugs)) == 4 and all("-2025-07-03-12-00-" in s for s in slugs)


def test_no_earlier_run_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError):
        runs.evolve_run(str(tmp_path), articles(spark, FIRST), NOW)


def test_same_articles_keep_every_title(spark, first):
    path, base = first
    before = stored_members(latest(spark, path))
    tables = runs.evolve_run(path, base, NOW)
    after = stored_members(latest(spark, path))
    assert set(after) == set(before) - {STALE}
    assert all(after[m][1] == before[m][1] for m in after)
    assert tables.clusters.count() == 3
    assert not {k[0] for k in after.values()} & {k[0] for k in before.values()}


def test_grown_late_and_new_clusters(spark, first):
    path, _ = first
    # 9 joins B; 10, 11, 15 are a new story; 12 is late: older than the newest kept member.
    more = FIRST + [(9, 5, 50.3), (10, 4, -60), (11, 3, -60.1), (15, 4.5, -60.2), (12, 40, 600)]
    asked = []

    def titles(prompts):
        asked.extend(r.prompt for r in prompts.collect())
        return prompts.select("label", F.concat(F.lit("Made "), F.col("label").cast("string")).alias("title")).where(
            ~F.col("prompt").contains("Title 11")
        )

    runs.evolve_run(path, articles(spark, more), NOW, titles)
    got = stored_members(latest(spark, path))
    assert set(got) == {A, B | {9}, LONER, frozenset({10, 11, 15})}
    assert got[A][1] == "Title 3"
    assert got[B | {9}][1].startswith("Made ")
    assert got[frozenset({10, 11, 15})][1] == "Title 11"
    assert len(asked) == 2 and any("Title 9\nTitle 5\nTitle 4\nTitle 13" in p for p in asked)


def test_late_articles_can_be_included(spark, first):
    path, _ = first
    runs.evolve_run(path, articles(spark, FIRST + [(12, 40, 600)]), NOW, late="include")
    assert frozenset({12}) in stored_members(latest(spark, path))


def test_empty_window_stores_nothing(spark, first):
    path, base = first
    assert runs.evolve_run(path, base, NOW + timedelta(days=30)) is None
    assert runs.read_runs(spark, path).run.count() == 1


def test_unfinished_runs_are_invisible(spark, first):
    path, base = first
    half = runs.backfill_run(
        spark.createDataFrame([(1, "a", "a")], "id bigint, title string, slug string"),
        base.withColumn("cluster_id", F.lit(1).cast("bigint")), 2, NOW,
    )
    half.clusters.write.mode("append").partitionBy("run_id").parquet(f"{path}/clusters")
    stored = runs.read_runs(spark, path)
    assert stored.clusters.where("run_id = 2").isEmpty() and stored.run.count() == 1


def test_quality_reports(spark):
    links = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (1, 1, 2)], "article_id int, cluster_id int, run_id int")
    assert [tuple(r) for r in store.multiple_assignments(links).collect()] == [(1, 1, 2)]
    slugs = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "slug string")
    assert [tuple(r) for r in store.duplicates(slugs, ["slug"]).collect()] == [("a", 2)]


def test_votes_take_the_latest(spark):
    rows = [("u", "p", "center left", NOW), ("u", "p", "right", NOW - timedelta(1)), ("v", "p", "center-left", NOW)]
    votes = spark.createDataFrame(rows, "user_id string, provider_id string, value string, created_at timestamp")
    assert [tuple(r) for r in store.vote_tally(votes).collect()] == [("p", "center-left", 2)]


def test_cascades(spark):
    child = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, parent int")
    gone = spark.createDataFrame([(10,)], "key int")
    assert {r.id for r in store.cascade_delete(child, "parent", gone, "key").collect()} == {2, 3}
    got = {r.id: r.parent for r in store.set_null_on_delete(child, "parent", gone, "key").collect()}
    assert got == {1: None, 2: 20, 3: None}
    assert {r.id for r in store.orphans(child, "parent", gone, "key").collect()} == {2}
