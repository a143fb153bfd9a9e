"""Cluster runs: evolve the latest run, bootstrap a first one, backfill legacy clusters, store."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import clusters as C
from newsloom.operators import store
from newsloom.operators.density import cluster_articles
from newsloom.session import local_table, pinned

# Fixed value: version tag of a run.
ALGO_VERSION = "hdbscan-1.0.0"


@dataclass
class RunDraft:
    """A clustered window: members per label, titles carried over, and what still needs a title."""

    members: DataFrame  # label, article_id, article_title, published_at
    reused: DataFrame  # label, title
    pending: DataFrame  # members of the clusters without a title
    prompts: DataFrame  # label, prompt


@dataclass
class RunTables:
    run: DataFrame
    clusters: DataFrame
    memberships: DataFrame


def window_articles(
    previous: DataFrame,
    articles: DataFrame,
    now: C.Clock,
    keep: timedelta = C.STALE_AFTER,
    new_cap: int | None = None,
    cap: int | None = None,
    late: str = "drop",
) -> DataFrame:
    """Articles of the sliding window: kept members of previous[article_id, published_at] plus what
    is newer.

    ``late='drop'`` takes articles after the newest kept member; ``late='include'`` takes every
    article of the last ``keep`` that is in no kept cluster, whatever its time. ``new_cap`` and
    ``cap`` keep the newest articles only; by default nothing is cut.
    """
    columns = ["id", "title", "embedding", "published_at"]
    articles = _cut_to_window(previous, articles, now, keep)
    members = previous.select(F.col("article_id").alias("id")).distinct()
    kept = articles.select(*columns).join(members, "id", "left_semi")
    if late == "include":
        unseen = articles.select(*columns).join(members, "id", "left_anti")
        new = store.articles_since(unseen, C._moment(now) - F.lit(keep), new_cap)
    else:
        new = store.articles_since(articles, C.high_water_mark(previous, now, keep).scalar(), new_cap)
    return store.window_cap(kept, new, cap)


def _cut_to_window(previous: DataFrame, articles: DataFrame, now: C.Clock, keep: timedelta) -> DataFrame:
    """Articles from the oldest kept member (or ``now - keep``) on. The bound is a literal, so it
    reaches the scan, and the day partitions where the table has them."""
    oldest = previous.agg(F.min("published_at").alias("t"))
    since = oldest.select(F.least(F.col("t"), C._moment(now) - F.lit(keep))).first()[0]
    near = articles.where(F.col("published_at") >= F.lit(since))
    return near.where(F.col("day") >= F.to_date(F.lit(since))) if "day" in articles.columns else near


def draft_run(
    previous: DataFrame,
    titles: DataFrame,
    articles: DataFrame,
    now: C.Clock,
    keep: timedelta = C.STALE_AFTER,
    epsilon: float = 0.2,
    **window,
) -> RunDraft | None:
    """Cluster the next window. previous[cluster_id, article_id, published_at],
    titles[id, title], articles[id, title, embedding, published_at]. None when there is nothing to cluster."""
    kept = pinned(C.drop_stale_clusters(previous, now, keep))
    window_rows = pinned(window_articles(kept, articles, now, keep, **window))
    if window_rows.isEmpty():
        return None
    labelled = cluster_articles(window_rows, epsilon=epsilon)
    named = window_rows.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    members = pinned(labelled.withColumnRenamed("id", "article_id").join(named, "article_id"))
    reused = pinned(C.carry_titles(kept, titles, members))
    pending = members.join(reused.select("label"), "label", "left_anti")
    return RunDraft(members, reused, pending, C.render_title_prompt(pending, key="label"))


def finish_run(draft: RunDraft, generated: DataFrame | None, run_id: int, first_cluster_id: int, now: C.Clock) -> RunTables:
    """Run header, clusters and memberships; generated[label, title] may miss any label."""
    spark = draft.members.sparkSession
    if generated is None:
        generated = local_table(spark, [], "label bigint, title string")
    new = C.resolve_titles(draft.pending, generated, key="label")
    titled = C.cluster_index(C.reused_then_new(draft.reused.select("label", "title"), new))
    return _tables(spark, titled, draft.members, run_id, first_cluster_id, now)


def _tables(spark: SparkSession, titled: DataFrame, members: DataFrame, run_id: int, first_cluster_id: int, now: C.Clock) -> RunTables:
    at = C._moment(now)
    numbers = pinned(titled.withColumn("id", F.col("cluster_no") + first_cluster_id))
    clusters = numbers.select(
        "id",
        "title",
        C.cluster_slug(F.col("title"), at, F.col("cluster_no")).alias("slug"),
        F.lit(run_id).cast("bigint").alias("run_id"),
        at.alias("created_at"),
    )
    memberships = members.join(numbers.select("label", F.col("id").alias("cluster_id")), "label").select(
        "article_id", "cluster_id", "published_at", F.lit(run_id).cast("bigint").alias("run_id")
    )
    return RunTables(run_header(spark, run_id, at), clusters, memberships)


def run_header(spark: SparkSession, run_id: int, at: Column, params: str | None = None) -> DataFrame:
    return spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("id"),
        F.lit(ALGO_VERSION).alias("algo_version"),
        F.lit(params).cast("string").alias("params"),
        F.lit(True).alias("is_production"),
        at.alias("created_at"),
    )


def bootstrap_run(
    articles: DataFrame, run_id: int, first_cluster_id: int, now: C.Clock, n: int | None = None, epsilon: float = 0.2
) -> RunTables:
    """First run: all articles, or the latest ``n``, each cluster titled by its newest article."""
    slim = articles.select("id", "title", "embedding", "published_at")
    rows = pinned(slim if n is None else store.latest(slim, n))
    named = rows.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    labelled = cluster_articles(rows, epsilon=epsilon).withColumnRenamed("id", "article_id")
    members = pinned(labelled.join(named, "article_id"))
    titled = C.cluster_index(C.first_title(members, "label").withColumn("is_new", F.lit(True)))
    return _tables(articles.sparkSession, titled, members, run_id, first_cluster_id, now)


def backfill_run(old_clusters: DataFrame, articles: DataFrame, run_id: int, now: C.Clock) -> RunTables:
    """Copy the non-empty legacy clusters (title, slug, members) into a run of their own."""
    full = C.nonempty_clusters(old_clusters, articles)
    run = F.lit(run_id).cast("bigint").alias("run_id")
    clusters = full.select("id", "title", "slug", run, C._moment(now).alias("created_at"))
    linked = articles.where("cluster_id IS NOT NULL")
    memberships = linked.select(F.col("id").alias("article_id"), "cluster_id", "published_at", run)
    return RunTables(run_header(articles.sparkSession, run_id, C._moment(now)), clusters, memberships)


# -- storage -------------------------------------------------------------------------------------


def write_cluster_run(tables: RunTables, path: str) -> None:
    """Store a run under ``path``; the header goes last and marks it complete. Every write replaces
    its own run_id partition, so a run that failed half-way can simply be written again."""
    header = tables.run.withColumn("run_id", F.col("id"))
    for name, df in (("memberships", tables.memberships), ("clusters", tables.clusters), ("runs", header)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def read_runs(spark: SparkSession, path: str) -> RunTables | None:
    """Stored runs; clusters and memberships of unfinished runs are left out."""
    if not store.path_exists(spark, f"{path}/runs"):
        return None

    def read(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{name}")

    runs = read("runs", schemas.CLUSTER_RUN)
    done = runs.select(F.col("id").alias("run_id"))
    return RunTables(
        runs,
        read("clusters", schemas.CLUSTER).join(done, "run_id", "left_semi"),
        read("memberships", schemas.MEMBERSHIP).join(done, "run_id", "left_semi"),
    )


def evolve_run(
    path: str, articles: DataFrame, now: C.Clock, generated=None, production_only: bool = False, **options
) -> RunTables | None:
    """Cluster the next window on top of the latest stored run and store the result.

    ``generated`` maps the prompts frame (label, prompt) to titles (label, title); without it every
    new cluster takes its newest article's title. With no earlier run this is an error; an empty
    window stores nothing.
    """
    spark = articles.sparkSession
    stored = read_runs(spark, path)
    latest = None if stored is None else C.latest_run(stored.run, production_only).first()
    if latest is None:
        raise RuntimeError("no earlier cluster run; bootstrap one first")
    previous = stored.memberships.where(F.col("run_id") == latest["id"]).select(
        "cluster_id", "article_id", "published_at"
    )
    titles = stored.clusters.where(F.col("run_id") == latest["id"]).select("id", "title")
    draft = draft_run(previous, titles, articles, now, **options)
    if draft is None:
        return None
    made = None if generated is None else generated(draft.prompts)
    run_id = (stored.run.agg(F.max("id")).first()[0] or 0) + 1
    first_cluster = (stored.clusters.agg(F.max("id")).first()[0] or 0) + 1
    tables = finish_run(draft, made, run_id, first_cluster, now)
    write_cluster_run(tables, path)
    return tables
