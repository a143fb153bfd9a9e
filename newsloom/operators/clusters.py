"""Cluster runs as relations: membership, identity across runs, titles, slugs, numbering.

A member list is never gathered into one row unless it is cut into pages: one story may hold a
large share of all articles.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import slugify
from newsloom.operators.articles import TITLE_PROMPT_HEAD
from newsloom.session import numbered

Clock = datetime | Column
STALE_AFTER = timedelta(days=3)
PAGE_SIZE = 1000


def _moment(now: Clock) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


# -- reading a run -------------------------------------------------------------------------------


def latest_run(runs: DataFrame, production_only: bool = False) -> DataFrame:
    """Newest run header; ``is_production`` plays no part unless asked for."""
    pool = runs.where("is_production") if production_only else runs
    return pool.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def run_members(run_id: Column | int, clusters: DataFrame, memberships: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per (cluster, article) of a run; a cluster without articles keeps one null row."""
    wanted = run_id if isinstance(run_id, Column) else F.lit(run_id)
    slim = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"), "published_at")
    linked = memberships.where(F.col("run_id") == wanted).select("cluster_id", "article_id")
    return (
        clusters.where(F.col("run_id") == wanted)
        .select(F.col("id").alias("cluster_id"), F.col("title").alias("cluster_title"), "slug")
        .join(linked.join(slim, "article_id"), "cluster_id", "left")
    )


def member_pages(members: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Nested form of (cluster_id, article_id, article_title, published_at): newest-first arrays of
    at most ``page_size`` articles, so a cluster of any size stays whole and no row is unbounded."""
    placed = numbered(
        members.select("cluster_id", "article_id", "article_title", "published_at"),
        [F.desc("published_at"), F.asc("article_id")],
        by=["cluster_id"],
        start=0,
    )
    article = F.struct("position", "article_id", "article_title", "published_at")
    return placed.groupBy("cluster_id", F.floor(F.col("position") / page_size).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(article)).alias("articles")
    )


def load_run(
    run_id: Column | int, clusters: DataFrame, memberships: DataFrame, articles: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """Nested run: one row per (cluster, page); clusters without articles have an empty page 0."""
    rows = run_members(run_id, clusters, memberships, articles)
    pages = member_pages(rows.where("article_id IS NOT NULL"), page_size)
    heads = clusters.where(F.col("run_id") == (run_id if isinstance(run_id, Column) else F.lit(run_id)))
    heads = heads.select(F.col("id").alias("cluster_id"), F.col("title").alias("cluster_title"), "slug")
    return heads.join(pages, "cluster_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def cluster_by_id(
    run_id: Column | int, cluster_id: Column | int, clusters: DataFrame, memberships: DataFrame, articles: DataFrame,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """One cluster of a run in the form of ``load_run``; no row if the run does not have it.

    Both keys reach the scans of clusters and memberships as filters, so only the cluster's own members
    are joined with their articles.
    """
    heads = clusters.where(F.col("id") == cluster_id)
    return load_run(run_id, heads, memberships.where(F.col("cluster_id") == cluster_id), articles, page_size)


def nonempty_clusters(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    return clusters.join(articles.select(F.col("cluster_id").alias("id")), "id", "left_semi")


# -- staleness -----------------------------------------------------------------------------------


def cluster_newest(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.max("published_at").alias("newest"))


def drop_stale_clusters(members: DataFrame, now: Clock, keep: timedelta = STALE_AFTER) -> DataFrame:
    """Members of the clusters whose newest article is strictly newer than ``now - keep``."""
    fresh = cluster_newest(members).where(F.col("newest") > _moment(now) - F.lit(keep))
    return members.join(fresh.select("cluster_id"), "cluster_id", "left_semi")


def high_water_mark(previous: DataFrame, now: Clock, default: timedelta = STALE_AFTER) -> DataFrame:
    """One row: newest previous article, or ``now - default`` when there is none."""
    return previous.agg(F.coalesce(F.max("published_at"), _moment(now) - F.lit(default)).alias("mark"))


# -- identity ------------------------------------------------------------------------------------


def cluster_signature(members: DataFrame) -> DataFrame:
    """Order-independent fingerprint of each member set: count and sum of 60-bit id digests.

    Sums combine map-side, where a sorted id list would gather the whole cluster in one row.
    """
    digest = F.conv(F.substring(F.md5(F.col("article_id").cast("string")), 1, 15), 16, 10)
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("members"), F.sum(digest.cast("decimal(20,0)")).cast("string").alias("signature")
    )


def matching_clusters(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs (cluster_id, label) with exactly the same members.

    previous[cluster_id, article_id], current[label, article_id]. Both sides meet on the article,
    so a pair is equal when the overlap is as large as either side; no id lists are compared.
    """
    old = previous.select("cluster_id", "article_id").distinct()
    new = current.select("label", "article_id").distinct()
    overlap = old.join(new, "article_id").groupBy("cluster_id", "label").agg(F.count("*").alias("_both"))
    return (
        overlap.join(old.groupBy("cluster_id").agg(F.count("*").alias("_old")), "cluster_id")
        .join(new.groupBy("label").agg(F.count("*").alias("_new")), "label")
        .where("_both = _old AND _both = _new")
        .select("cluster_id", "label")
    )


def carry_titles(previous: DataFrame, titles: DataFrame, current: DataFrame) -> DataFrame:
    """(label, title) of the current clusters that inherit a title; the rest are pending."""
    matched = matching_clusters(previous, current)
    named = titles.select(F.col("id").alias("cluster_id"), "title")
    return matched.join(named, "cluster_id").groupBy("label").agg(F.max_by("title", "cluster_id").alias("title"))


# -- labels --------------------------------------------------------------------------------------


def next_label(labelled: DataFrame) -> DataFrame:
    return labelled.agg((F.coalesce(F.max("label"), F.lit(-1)) + 1).cast("bigint").alias("next_label"))


def assign_singletons(labelled: DataFrame) -> DataFrame:
    """Noise rows (label -1) of labelled[id, published_at, label] become clusters of one, numbered
    on from the highest label, newest first."""
    first = next_label(labelled).scalar()
    noise = numbered(
        labelled.where("label = -1"), [F.desc("published_at"), F.asc("id")], out="_n", start=0
    ).withColumn("label", F.col("_n") + first)
    return labelled.where("label <> -1").unionByName(noise.drop("_n").select(*labelled.columns))


def group_members(labelled: DataFrame) -> DataFrame:
    """Members of each label with their newest-first position (from 1)."""
    rows = labelled.select("label", "id", "published_at")
    return numbered(rows, [F.desc("published_at"), F.asc("id")], by=["label"], start=1)


# -- titles and slugs ----------------------------------------------------------------------------


def first_title(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Title of the newest article per cluster."""
    newest = F.struct(F.col("published_at"), -F.col("article_id"))
    return members.groupBy(key).agg(F.max_by("article_title", newest).alias("title"))


def top_titles(members: DataFrame, k: int = 5, key: str = "cluster_id") -> DataFrame:
    """The ``k`` newest titles per cluster, one per line. The rank filter is applied map-side too,
    so each task passes on at most ``k`` rows per cluster."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("published_at"), F.asc("article_id")))
    best = members.select(key, "article_id", "article_title", "published_at").withColumn("_place", place)
    lines = F.array_sort(F.collect_list(F.struct("_place", "article_title")))
    return (
        best.where(F.col("_place") <= k)
        .groupBy(key)
        .agg(F.array_join(F.transform(lines, lambda x: x["article_title"]), "\n").alias("titles"))
    )


def render_title_prompt(members: DataFrame, head: str = TITLE_PROMPT_HEAD, key: str = "cluster_id") -> DataFrame:
    return top_titles(members, key=key).select(key, F.concat(F.lit(head + "\n\n"), "titles").alias("prompt"))


def resolve_titles(members: DataFrame, generated: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Generated title per cluster, or the newest article's title where none came back."""
    made = generated.select(key, F.col("title").alias("_made"))
    return first_title(members, key).join(made, key, "left").select(
        key, F.coalesce("_made", "title").alias("title")
    )


def reused_then_new(reused: DataFrame, titled: DataFrame) -> DataFrame:
    """Titles carried over, followed by newly made ones; ``is_new`` keeps the order of the two."""
    return reused.withColumn("is_new", F.lit(False)).unionByName(titled.withColumn("is_new", F.lit(True)))


def cluster_index(titled: DataFrame) -> DataFrame:
    """Position of each cluster in the run: carried-over ones first, then new ones, by label."""
    return numbered(titled, [F.asc("is_new"), F.asc("label")], out="cluster_no", start=0)


def cluster_slug(title: Column, at: Clock, index: Column) -> Column:
    return F.concat_ws(
        "-", slugify(title), F.date_format(_moment(at), "yyyy-MM-dd-HH-mm"), index.cast("string")
    )


def run_metrics(titled: DataFrame) -> DataFrame:
    """Clusters created and kept by a run."""
    return titled.agg(
        F.count_if(F.col("is_new")).alias("created"), F.count_if(~F.col("is_new")).alias("kept")
    )


def fetched_per_provider(entries: DataFrame) -> DataFrame:
    return entries.groupBy("provider_key").agg(F.count("*").alias("fetched"))
