"""Stored tables: pruned reads, top-n reads, appends, upserts, set operations, quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators.url_index import maybe_among
from newsloom.session import numbered, pinned, tidy_shuffles
from newsloom.sources import snapshots


def _newest_first() -> list[Column]:
    return [F.desc("published_at"), F.asc("id")]


# -- reads ---------------------------------------------------------------------------------------


def by_key(providers: DataFrame, key: str) -> DataFrame:
    return providers.where(F.col("key") == key)


def by_keys(providers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return providers.where(F.col("key").isin(list(keys)))


def existing_keys(providers: DataFrame) -> DataFrame:
    return providers.select("key").distinct()


def all_providers(providers: DataFrame) -> DataFrame:
    return providers.select("key", "name", "url", "rank")


def latest(articles: DataFrame, n: int) -> DataFrame:
    return articles.orderBy(*_newest_first()).limit(n)


def articles_since(articles: DataFrame, since: Column, cap: int | None = None) -> DataFrame:
    """Articles strictly after ``since``, only the columns clustering reads; with ``cap`` only the
    newest of them."""
    recent = articles.where(F.col("published_at") > since)
    if cap is not None:
        recent = recent.orderBy(*_newest_first()).limit(cap)
    return recent.select("id", "title", "embedding", "published_at")


def window_cap(previous: DataFrame, new: DataFrame, cap: int | None = None) -> DataFrame:
    """previous ++ new; with ``cap`` only the newest, on equal times previous articles first."""
    if cap is None:
        return chain(previous, new)
    chained = chain(previous.withColumn("_src", F.lit(0)), new.withColumn("_src", F.lit(1)))
    return chained.orderBy(F.desc("published_at"), "_src", "id").limit(cap).drop("_src")


def chain(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Previous window and new articles, not de-duplicated (disjoint by construction)."""
    return previous.unionByName(new)


def clustered_count(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count_if(F.col("cluster_id").isNotNull()).alias("clustered"))


def pad_clustered(articles: DataFrame, target: int = 2000) -> DataFrame:
    """All clustered articles, filled up to ``target`` with the newest unclustered ones.

    The pad never exceeds ``target`` rows, so it is cut to a top-``target`` first and only those
    rows are numbered against the remaining room.
    """
    clustered = articles.where("cluster_id IS NOT NULL")
    room = F.greatest(F.lit(0), F.lit(target) - clustered.agg(F.count("*")).scalar())
    newest = articles.where("cluster_id IS NULL").orderBy(*_newest_first()).limit(target)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_newest_first()))
    pad = newest.withColumn("_place", place).where(F.col("_place") <= room).drop("_place")
    return clustered.unionByName(pad)


def category_feed(articles: DataFrame, category: str, n: int = 50) -> DataFrame:
    return articles.where(F.array_contains("categories", category)).orderBy(*_newest_first()).limit(n)


def articles_of_post(posts: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per (post, article) of the bridge table."""
    return (
        posts.select(F.col("id").alias("social_post_id"), F.col("url").alias("post_url"))
        .join(links.select("article_id", "social_post_id").distinct(), "social_post_id")
        .join(
            articles.select(
                F.col("id").alias("article_id"), F.col("url").alias("article_url"), "title"
            ),
            "article_id",
        )
    )


def publishing_frequency(articles: DataFrame, width: str = "1 day") -> DataFrame:
    """Articles per provider and time bucket."""
    return (
        articles.groupBy("news_provider_key", F.window("published_at", width).alias("w"))
        .agg(F.count("*").alias("articles"))
        .select("news_provider_key", F.col("w.start").alias("bucket"), "articles")
    )


# -- writes --------------------------------------------------------------------------------------


def one_per_url(articles: DataFrame) -> DataFrame:
    """Keep one row per URL: earliest time, then provider key."""
    row = F.struct("published_at", "news_provider_key", *[
        c for c in articles.columns if c not in ("url", "published_at", "news_provider_key")
    ])
    # A total order on what rows of one URL differ in; of rows alike in all of it any will do.
    rest = [c for c in ("title", "summary", "content", "id") if c in articles.columns]
    best = F.min_by(row, F.struct("published_at", "news_provider_key", *rest)).alias("_a")
    return articles.groupBy("url").agg(best).select("url", "_a.*").select(*articles.columns)


def append_articles(articles: DataFrame, path: str, all_new: bool = False) -> DataFrame:
    """Append articles that are not stored yet, partitioned by day; returns the appended rows.

    Rows without ids get the next free ones. The rows are pinned before the write, being derived by
    an anti join against the very table that is about to change; running the same batch again
    appends nothing. ``all_new`` says that the caller has compared the URLs with the store already.
    """
    spark = articles.sparkSession
    fresh = one_per_url(articles)
    if not all_new and path_exists(spark, path):
        known = known_urls(fresh.select("url"), spark.read.parquet(path))
        fresh = fresh.join(known, "url", "left_anti")
    fresh = pinned(fresh.withColumn("day", F.to_date("published_at")))
    added = fresh.count()
    if not added:
        return fresh.drop("day")
    if "id" not in fresh.columns:
        order = [F.asc("published_at"), F.asc("url")]
        first = _reserve_ids(spark, path, added)
        ids = numbered(fresh.select("published_at", "url"), order, out="id", start=first)
        fresh = fresh.join(ids.select("url", "id"), "url")
    fresh.write.mode("append").partitionBy("day").parquet(path)
    return fresh.drop("day")


def known_urls(urls: DataFrame, articles: DataFrame) -> DataFrame:
    """Those of ``urls`` that are stored. Only the url column of the store is read; the planner picks
    the join from real sizes, and nothing passes through the driver."""
    return articles.select("url").join(urls.distinct(), "url", "left_semi").distinct()


def _reserve_ids(spark: SparkSession, path: str, count: int) -> int:
    """First of ``count`` ids that no earlier batch was given. The range is booked next to the table
    before the rows are written, so a failed write leaves a gap and never a repeat."""
    book = f"{path.rstrip('/')}_ids"
    last = 0
    if path_exists(spark, book):
        last = spark.read.parquet(book).agg(F.max("last")).first()[0]
    elif path_exists(spark, path):
        last = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    spark.range(1).select(F.lit(last + count).cast("bigint").alias("last")).write.mode("append").parquet(book)
    return last + 1


def booked_id(spark: SparkSession, path: str) -> int:
    """Largest id that was booked for the article table (0: none)."""
    book = f"{path.rstrip('/')}_ids"
    return (spark.read.parquet(book).agg(F.max("last")).first()[0] or 0) if path_exists(spark, book) else 0


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018  the reader looks the path up
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def split_new_existing(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = existing.select("key")
    return incoming.join(keys, "key", "left_anti"), incoming.join(keys, "key", "left_semi")


def upsert_providers(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new keys and overwrite the columns that ``incoming`` has for existing ones. Rows and
    columns missing from the input stay as they are (null for a new key). A key that comes in twice
    is an error. ``upsert_catalogue`` stores the result."""
    given = [c for c in incoming.columns if c != "key"]
    kept = [c for c in existing.columns if c != "key"]
    row = F.min(F.struct(*given))
    one = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key: "), "key"))).otherwise(row)
    new = incoming.groupBy("key").agg(one.alias("_new"))
    met = existing.join(new, "key", "full_outer")

    def merged(c: str) -> Column:
        if c not in given:
            return F.col(c)
        old = F.col(c) if c in kept else F.lit(None)
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(old).alias(c)

    return met.select("key", *[merged(c) for c in dict.fromkeys([*kept, *given])])


def upsert_catalogue(incoming: DataFrame, path: str) -> int:
    """Upsert into the versioned catalogue below ``path`` (made if absent); returns the new version.

    The new version is published once it is written whole. If the input is wrong or the write dies, the
    version before stays the latest; if another writer was faster, this is an error and nothing changes.
    """
    spark = incoming.sparkSession
    version = snapshots.latest(spark, path) or 0
    existing = snapshots.read_snapshot(spark, path, version) if version else incoming.limit(0)
    return snapshots.write_snapshot(upsert_providers(existing, incoming), path, after=version)


# -- history -------------------------------------------------------------------------------------


def _with_previous(df: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    """``value`` of the row before, by ``order`` within ``by``, without a group in one task: ranges of
    rows look at their own, and the first row of a range at the last one of the range before it."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pinned(df.repartitionByRange(slices, by, order).withColumn("_slice", F.spark_partition_id()))
    own = Window.partitionBy(by, "_slice").orderBy(order)
    ends = placed.groupBy(by, "_slice").agg(F.max_by(value, order).alias("_last"))
    ends = ends.select(by, "_slice", F.lag("_last").over(Window.partitionBy(by).orderBy("_slice")).alias("_before"))
    local = placed.withColumn("_own", F.lag(value).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    return local.join(ends, [by, "_slice"]).withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_own"))).drop(
        "_slice", "_own", "_first", "_before"
    )


def article_versions(seen: DataFrame, columns: Sequence[str] = ("title", "content")) -> DataFrame:
    """Versions of articles from seen[url, seen_at, …]: ``url, version, valid_from, valid_to, altered`` and
    the ``columns``, whose values tell versions apart.

    A version begins when an article is first seen with other values than at its sight before; a text
    that comes back begins a new version. ``valid_to`` is the start of the next one (null: still
    valid), ``altered`` names the columns that changed. Sights of one URL at one time count once, the
    least values first; rows without url or time are left out.
    """
    # What a step shuffled goes when it ends, so the texts' way to their digests and the way back are not on disk together.
    tidy_shuffles(seen.sparkSession)
    # Sights are told apart by digests of their values; the values themselves are shuffled once, at the end.
    digest = F.struct(*[F.unhex(F.sha2(F.to_json(F.struct(c)), 256)).alias(c) for c in columns])
    sights = seen.where("url IS NOT NULL AND seen_at IS NOT NULL").select("url", "seen_at", *columns, digest.alias("now"))
    times = sights.groupBy("url", "seen_at").agg(F.min("now").alias("now"), F.max("now").alias("_other"))
    times = pinned(times.select("url", "seen_at", "now", (F.col("now") != F.col("_other")).alias("_unlike")))
    at, unlike = times.where("NOT _unlike").drop("_unlike"), times.where("_unlike").select("url", "seen_at")
    if not unlike.isEmpty():
        # Texts are shuffled for these sights only.
        several = sights.where(maybe_among(unlike.select("url"))(F.col("url"))).join(unlike, ["url", "seen_at"], "left_semi")
        at = at.unionByName(pinned(several.groupBy("url", "seen_at").agg(F.min_by("now", F.struct(*columns)).alias("now"))))
    with_last = _with_previous(at, "url", "seen_at", "now", "last")
    begun = with_last.where(F.col("last").isNull() | ~F.col("now").eqNullSafe(F.col("last")))
    changed = [F.when(F.col("last").isNotNull() & ~F.col(f"now.{c}").eqNullSafe(F.col(f"last.{c}")), F.lit(c)) for c in columns]
    begun = begun.select("url", F.col("seen_at").alias("valid_from"), "now", F.array_compact(F.array(*changed)).alias("altered"))
    # Looking ahead is looking back in reverse.
    back = begun.withColumn("_back", -F.unix_micros("valid_from"))
    back = _with_previous(back, "url", "_back", "valid_from", "valid_to").drop("_back")
    placed = numbered(back, [F.asc("valid_from")], by=("url",), out="version", start=1)
    # Equal values of a URL meet where they are read, before they are shuffled.
    values = sights.drop("seen_at").dropDuplicates(["url", "now"])
    return placed.join(values, ["url", "now"]).select("url", "version", "valid_from", "valid_to", "altered", *columns)


# -- votes ---------------------------------------------------------------------------------------


def latest_votes(votes: DataFrame) -> DataFrame:
    """The newest vote per (user, provider), bias spelled with hyphens. ``max_by`` combines
    map-side, so one very busy pair never gathers in a task."""
    newest = F.max_by("value", F.struct("created_at", "value"))
    return votes.groupBy("user_id", "provider_id").agg(
        F.replace(newest, F.lit(" "), F.lit("-")).alias("value"), F.max("created_at").alias("created_at")
    )


def vote_tally(votes: DataFrame) -> DataFrame:
    return latest_votes(votes).groupBy("provider_id", "value").agg(F.count("*").alias("votes"))


# -- quality reports -----------------------------------------------------------------------------


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once. Null keys do not collide, as in SQL."""
    present = df.dropna(subset=list(keys))
    return present.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose (non-null) foreign key has no parent."""
    parents = parent.select(F.col(key).alias(foreign_key))
    return child.where(F.col(foreign_key).isNotNull()).join(parents, foreign_key, "left_anti")


def cascade_delete(child: DataFrame, foreign_key: str, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that survive when the ``deleted`` parents go."""
    return child.join(deleted.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def set_null_on_delete(child: DataFrame, foreign_key: str, deleted: DataFrame, key: str) -> DataFrame:
    gone = deleted.select(F.col(key).alias(foreign_key)).distinct().withColumn("_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col(foreign_key)).alias(foreign_key)
    columns = [kept if c == foreign_key else F.col(c) for c in child.columns]
    return child.join(gone, foreign_key, "left").select(*columns)


def multiple_assignments(memberships: DataFrame) -> DataFrame:
    """Articles that sit in more than one cluster of the same run."""
    return (
        memberships.groupBy("article_id", "run_id")
        .agg(F.count("*").alias("clusters"))
        .where("clusters > 1")
    )


def domain_violations(
    df: DataFrame, required: Sequence[str] = (), allowed: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Violations per check in one pass: nulls in required columns, values outside a domain."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in required]
    checks += [
        F.count_if(~F.col(c).isin(list(values))).alias(f"domain:{c}") for c, values in (allowed or {}).items()
    ]
    wide = df.agg(*checks)
    names = wide.columns
    pairs = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("violations")) for n in names]
    )
    return wide.select(F.inline(pairs))

