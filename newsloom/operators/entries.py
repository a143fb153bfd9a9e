"""Feed entries: dates, links, recency, exclusion, de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import date_reader, read_date
from newsloom.functions.links import normalize_link
from newsloom.session import local_table
from newsloom.sources.catalog import DEFAULT_WINDOW, RFC822_OFFSET

Clock = datetime | Column


def _moment(now: Clock) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def parse_published(text: Column, date_format: Column, now: Clock) -> Column:
    """Feed date to timestamp by the provider's strptime format (none: RFC 822 with an offset). No text
    means ``now``; text that does not parse gives null; an unknown directive in the format is an error."""
    reader = date_reader(F.coalesce(date_format, F.lit(RFC822_OFFSET)))
    return _published(text, reader, now)


def _published(text: Column, reader: Column, now: Clock) -> Column:
    return F.when(text.isNull(), _moment(now)).otherwise(read_date(text, reader))


def dated(items: DataFrame, providers: DataFrame, now: Clock, how: str = "inner") -> DataFrame:
    """Feed items with absolute link and parsed time (null time = to be quarantined).

    Items of unknown providers are left out; with ``how='left'`` they stay, without a time or a base.
    Date formats are translated once per provider.
    """
    reader = date_reader(F.coalesce("date_format", F.lit(RFC822_OFFSET)))
    formats = providers.select(F.col("key").alias("provider_key"), F.col("url").alias("_base"), reader.alias("_reader"))
    return (
        items.join(formats, "provider_key", how)
        .withColumn("link", F.coalesce(normalize_link(F.col("link"), F.col("_base")), F.col("link")))
        .withColumn("published_at", F.when(F.col("_reader").isNotNull(), _published(F.col("published"), F.col("_reader"), now)))
        .drop("_base", "_reader")
    )


def is_recent(
    entries: DataFrame, providers: DataFrame, now: Clock, default: timedelta = DEFAULT_WINDOW
) -> DataFrame:
    """Entries strictly newer than ``now`` minus the provider's window."""
    windows = providers.select(F.col("key").alias("provider_key"), F.col("time_window").alias("_w"))
    return (
        entries.join(windows, "provider_key")
        .where(F.col("published_at") > _moment(now) - F.coalesce("_w", F.lit(default)))
        .drop("_w")
    )


def exclude(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop entries whose title or link starts with a prefix listed for their provider.

    Rules fold into one row per provider, so this is an equi-join and never a nested loop.
    """
    folded = rules.groupBy("provider_key").agg(
        F.collect_set(F.when(F.col("field") == "title", F.col("prefix"))).alias("_titles"),
        F.collect_set(F.when(F.col("field") == "link", F.col("prefix"))).alias("_links"),
    )
    hit = F.exists("_titles", lambda p: F.startswith(F.col("title"), p)) | F.exists(
        "_links", lambda p: F.startswith(F.col("link"), p)
    )
    return (
        entries.join(folded, "provider_key", "left")
        .where(~F.coalesce(hit, F.lit(False)))
        .drop("_titles", "_links")
    )


def exclude_where(entries: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Predicate plug-ins: drop a provider's entries where its own condition holds."""
    drop = F.lit(False)
    for provider_key, condition in predicates.items():
        drop = drop | ((F.col("provider_key") == provider_key) & condition)
    return entries.where(~F.coalesce(drop, F.lit(False)))


def rewrite_where(entries: DataFrame, rewrites: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Column plug-ins: per provider, new values for some columns, as expressions over the old ones.
    Other providers and columns stay as they are; all of it is one projection."""
    out = {}
    for provider_key, columns in rewrites.items():
        for name, value in columns.items():
            out[name] = F.when(F.col("provider_key") == provider_key, value).otherwise(out.get(name, F.col(name)))
    unknown = set(out) - set(entries.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return entries.withColumns(out) if out else entries


def clamp_future(entries: DataFrame, now: Clock) -> DataFrame:
    return entries.withColumn("published_at", F.least(F.col("published_at"), _moment(now)))


def select_providers(providers: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """All providers, or the named ones; an unknown key is an error when the result is read."""
    if not keys:
        return providers
    wanted = local_table(providers.sparkSession, [(k,) for k in dict.fromkeys(keys)], "key string")
    known = providers.withColumn("_known", F.lit(True))
    return (
        wanted.join(known, "key", "left")
        .withColumn(
            "key",
            F.when(F.col("_known"), F.col("key")).otherwise(
                F.raise_error(F.concat(F.lit("unknown provider: "), F.col("key")))
            ),
        )
        .select(*providers.columns)
    )


def distinct_links(entries: DataFrame) -> DataFrame:
    """One entry per link: earliest time, then provider key. Aggregates map-side, so a link that
    is repeated very often costs one row per input partition."""
    rest = [c for c in entries.columns if c not in ("link", "published_at", "provider_key")]
    ranked = F.struct("published_at", "provider_key", *[F.col(c) for c in rest])
    key = F.struct("published_at", "provider_key", *[F.col(c) for c in rest if c in ("item_no", "title", "summary", "image_urls")])
    best = F.min_by(ranked, key).alias("_e")
    return entries.groupBy("link").agg(best).select("link", "_e.*").select(*entries.columns)


def new_only(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Entries whose link is not stored yet."""
    return entries.join(articles.select(F.col("url").alias("link")), "link", "left_anti")


def with_provider(entries: DataFrame, providers: DataFrame) -> DataFrame:
    """Attach catalogue columns (prefixed ``provider_``)."""
    renamed = providers.select(
        F.col("key").alias("provider_key"),
        *[F.col(c).alias(f"provider_{c}") for c in providers.columns if c != "key"],
    )
    return entries.join(renamed, "provider_key")


def url_difference(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Set of links minus the set of stored URLs."""
    return links.select("link").subtract(articles.select(F.col("url").alias("link")))


def process_entries(
    items: DataFrame, providers: DataFrame, rules: DataFrame, articles: DataFrame, now: Clock
) -> DataFrame:
    """The per-tick chain: date → recent → excluded → clamped → one per link → not stored."""
    fresh = is_recent(dated(items, providers, now).where("published_at IS NOT NULL"), providers, now)
    return new_only(distinct_links(clamp_future(exclude(fresh, rules), now)), articles)
