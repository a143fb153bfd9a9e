"""One ingest tick: feed bodies to stored articles, then the next cluster run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import articles as A
from newsloom.operators import entries as E
from newsloom.operators import store
from newsloom.operators.images import feed_images
from newsloom.operators.url_index import UrlIndex, maybe_among
from newsloom.plans import runs
from newsloom.session import pinned
from newsloom.sources import snapshots
from newsloom.sources.feeds import feed_rows, parse_feeds, quarantined_feeds, quarantined_items

Source = DataFrame | Callable[[SparkSession], DataFrame]

ENTRY = ["link", "provider_key", "title", "published_at", "summary", "image_urls"]
QUARANTINE = "kind string, provider_key string, feed_url string, link string, detail string, fetched_at timestamp"
#: Unreadable entries of a tick, by kind.
BAD_FEED, BAD_DATE, NO_PROVIDER, EXPIRED = "bad_feed", "bad_date", "unknown_provider", "expired"


@dataclass
class Inputs:
    """Lookup tables of a tick. What services produce in other systems arrives as tables here:
    pages[url, html(, provider_key)], responses[url, payload], embeddings[url, embedding],
    stock[url, stock_url].

    Each is a DataFrame, or a function of the session that reads it anew for every tick (see
    ``living``): an endless ingest then sees rows that arrive after its start. ``rewrites`` and
    ``predicates`` are plug-ins of providers: expressions over an entry's columns that replace some of them
    (by provider and column), and then conditions on which an entry is dropped (by provider).
    """

    providers: Source
    exclusions: Source
    image_rules: Source
    pages: Source
    responses: Source
    embeddings: Source
    stock: Source | None = None
    rewrites: Mapping[str, Mapping[str, Column]] = field(default_factory=dict)
    predicates: Mapping[str, Column] = field(default_factory=dict)

    def current(self, spark: SparkSession) -> Inputs:
        """The tables as they are now."""
        now = {f.name: getattr(self, f.name) for f in fields(self)}
        return Inputs(**{k: v(spark) if callable(v) else v for k, v in now.items()})


def living(path: str, schema: str | None = None, versioned: bool = False) -> Callable[[SparkSession], DataFrame]:
    """A table of parquet files whose folder is listed again whenever it is asked for; ``versioned``: the
    latest published snapshot, which stays the same during a tick."""

    def read(spark: SparkSession) -> DataFrame:
        if versioned:
            return snapshots.read_snapshot(spark, path)
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)

    return read


@dataclass
class Tick:
    """What a tick did: the articles it added and its counts."""

    added: DataFrame
    counts: dict[str, int]


def _wanted(items: DataFrame, inputs: Inputs, clock: E.Clock) -> DataFrame:
    """Recent and wanted entries of dated items, one per link."""
    recent = E.is_recent(items.where("published_at IS NOT NULL"), inputs.providers, clock)
    own = E.exclude_where(E.rewrite_where(recent, inputs.rewrites), dict(inputs.predicates))
    wanted = E.clamp_future(E.exclude(own, inputs.exclusions), clock)
    return E.distinct_links(wanted.select(*ENTRY))


def fresh_entries(raw: DataFrame, inputs: Inputs, now: E.Clock | None = None) -> DataFrame:
    """Entries of raw[provider_key, feed_url, fetched_at, body] that are recent and wanted, one per link.

    The clock is the fetch time of each feed unless ``now`` is given, so a replayed batch gives the
    same entries.
    """
    clock = F.col("fetched_at") if now is None else now
    return _wanted(feed_images(E.dated(parse_feeds(raw), inputs.providers, clock), inputs.image_rules), inputs, clock)


def quarantine(raw: DataFrame, inputs: Inputs, now: E.Clock | None = None) -> tuple[DataFrame, DataFrame]:
    """Feeds that did not parse, and items whose date did not."""
    clock = F.col("fetched_at") if now is None else now
    return quarantined_feeds(raw), quarantined_items(E.dated(parse_feeds(raw), inputs.providers, clock))


def build_articles(entries: DataFrame, inputs: Inputs) -> DataFrame:
    """Extraction and enrichment of new entries only.

    Entries without a vector become no article, so the others are cut off before any text is looked
    up. Every lookup table is cut to the batch's links first, so that only its own pages, answers and
    vectors take part in the joins: most other rows by a bounded filter where they are read, the rest
    by the key. No batch passes through the driver.
    """
    vectors = inputs.embeddings.select(F.col("url").alias("link"))
    entries = pinned(entries.join(vectors, "link", "left_semi"))
    batch = entries.select(F.col("link").alias("url"))
    among = maybe_among(batch)

    def own(table: DataFrame | None) -> DataFrame | None:
        return table if table is None else table.where(among(F.col("url"))).join(batch, "url", "left_semi")

    outlets = entries.select(F.col("link").alias("url"), "provider_key")
    # Extraction is heavy per page: spread the batch, on the key of the joins that follow.
    pages = own(inputs.pages.select("url", "html")).join(outlets, "url").repartition("url")
    extracted = A.extract_articles(pages, inputs.image_rules)
    enriched = A.enrich(entries, extracted, own(inputs.responses), own(inputs.embeddings), own(inputs.stock))
    return A.assemble_article(enriched)


# -- the tick ----------------------------------------------------------------------------------------


def _items(raw: DataFrame, inputs: Inputs, now: E.Clock | None, fetched: Observation) -> DataFrame:
    """All rows of the feeds, readable or not, with their time, link and images: one pass over the
    bodies, counted as it goes by."""
    clock = F.col("fetched_at") if now is None else now
    known = inputs.providers.select(F.col("key").alias("provider_key"), F.lit(True).alias("_known"))
    rows = E.dated(feed_rows(raw), inputs.providers, clock, how="left").join(known, "provider_key", "left")
    rows = feed_images(rows, inputs.image_rules).select(
        *ENTRY, "feed_url", "fetched_at", "published", "readable", F.coalesce("_known", F.lit(False)).alias("known")
    )
    item = F.col("readable")
    return pinned(
        rows.observe(
            fetched,
            F.count_if(item).alias("items"),
            F.max("fetched_at").alias("newest"),
            F.count_if(~item).alias(BAD_FEED),
            F.count_if(item & ~F.col("known")).alias(NO_PROVIDER),
            F.count_if(item & F.col("known") & F.col("published_at").isNull()).alias(BAD_DATE),
        )
    )


def _set_aside(items: DataFrame, expired: DataFrame | None) -> DataFrame:
    """Rows of the tick that no article can come from, each with its reason."""
    kind = (
        F.when(~F.col("readable"), BAD_FEED).when(~F.col("known"), NO_PROVIDER).when(F.col("published_at").isNull(), BAD_DATE)
    )
    rows = items.select(kind.alias("kind"), "provider_key", "feed_url", "link", F.col("published").alias("detail"), "fetched_at")
    rows = rows.where("kind IS NOT NULL")
    if expired is not None:
        none = F.lit(None).cast("string")
        gone = expired.select(F.lit(EXPIRED).alias("kind"), "provider_key", none.alias("feed_url"), "link", none.alias("detail"), F.col("since").alias("fetched_at"))
        rows = rows.unionByName(gone)
    return rows


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """What all ticks set aside, with the name of the batch."""
    return spark.read.schema(f"{QUARANTINE}, batch string").parquet(f"{path}/quarantine")


def pending(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries that wait for an answer: those of ENTRY, when they were first seen, and how often tried."""
    return snapshots.read_snapshot(spark, f"{path}/pending")


def run_tick(raw: DataFrame, inputs: Inputs, path: str, now: E.Clock | None = None, batch: str | None = None) -> Tick:
    """Ingest one batch of feeds into ``path``.

    New entries, and those that earlier ticks left in the ledger ``pending``, are looked up in the URL
    index, which reads the buckets of their links only. Those with an analysis and an embedding become
    articles; the others wait in the ledger, as long as they are recent by their provider's window, and
    are tried again by every tick, so an answer that comes late loses nothing. Bodies that are no feed,
    items with a date that does not parse, items of unknown providers and entries that expired in the
    ledger go to ``quarantine``, in the folder of the batch.

    ``batch`` names the batch. A batch that is run again under its name replaces its own quarantine,
    finds its articles in the index and writes the same ledger. After a crash the index catches up with
    what the dead tick stored. The counts come from the passes themselves, not from jobs of their own.
    """
    spark, target = raw.sparkSession, f"{path}/articles"
    live = inputs.current(spark)
    fetched, kept, built = Observation("fetched"), Observation("kept"), Observation("built")
    items = _items(raw, live, now, fetched)
    seen = fetched.get
    clock = F.col("fetched_at") if now is None else now
    fresh = _wanted(items.where("readable AND known"), live, clock)
    at = (F.lit(seen["newest"]) if seen["newest"] is not None else F.current_timestamp()) if now is None else now
    moment = at if isinstance(at, Column) else F.lit(at)
    fresh = fresh.select(*ENTRY, moment.cast("timestamp").alias("since"), F.lit(0).alias("tries"))

    ledger, version = pending(spark, path), snapshots.latest(spark, f"{path}/pending") or 0
    expired = None
    if ledger is not None:
        waiting = E.is_recent(ledger, live.providers, at)
        expired = ledger.join(waiting.select("link"), "link", "left_anti")
        # An entry that is fetched again keeps its first time and its tries.
        again = waiting.select("link", F.col("since").alias("_since"), F.col("tries").alias("_tries"))
        fresh = fresh.join(again, "link", "left").withColumn("since", F.coalesce("_since", "since")).withColumn("tries", F.coalesce("_tries", "tries"))
        fresh = fresh.drop("_since", "_tries").unionByName(waiting.join(fresh.select("link"), "link", "left_anti"))
    entries = pinned(fresh.observe(kept, F.count("*").alias("kept")))

    index = UrlIndex(spark, f"{path}/url_index")
    if store.path_exists(spark, target):
        index.catch_up(spark.read.parquet(target), store.booked_id(spark, target))
        links = entries.select(F.col("link").alias("url"))
        entries = pinned(E.new_only(entries, index.known(links)))
    articles = build_articles(entries.select(*ENTRY), live)
    added = store.append_articles(articles.observe(built, F.count("*").alias("created")), target, all_new=True)
    created = built.get["created"]
    if created:
        index.add(added, store.booked_id(spark, target))
        index.compact()

    left = entries.join(added.select(F.col("url").alias("link")), "link", "left_anti").withColumn("tries", F.col("tries") + 1)
    count = Observation("pending")
    snapshots.write_snapshot(left.observe(count, F.count("*").alias("pending")), f"{path}/pending", after=version)
    snapshots.drop_old(spark, f"{path}/pending")

    name = batch or uuid.uuid4().hex
    aside = Observation("expired")
    rows = _set_aside(items, expired).observe(aside, F.count_if(F.col("kind") == EXPIRED).alias(EXPIRED))
    rows.write.mode("overwrite").parquet(f"{path}/quarantine/batch={name}")
    counts = {k: v for k, v in seen.items() if k != "newest"}
    counts |= kept.get | {"created": created} | count.get | aside.get
    measured = spark.createDataFrame([(name, k, v) for k, v in sorted(counts.items())], "batch string, metric string, value long")
    measured.drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics/batch={name}")
    return Tick(added, counts)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all ticks: ``metric, value, batch``."""
    return spark.read.schema("metric string, value long, batch string").parquet(f"{path}/metrics")


def tick(raw: DataFrame, inputs: Inputs, path: str, now: E.Clock | None = None) -> DataFrame:
    """Ingest one batch of feeds into ``path``/articles; returns the articles it added."""
    return run_tick(raw, inputs, path, now).added


def cluster_tick(spark, path: str, now: E.Clock, generated=None, **options) -> runs.RunTables | None:
    """Next cluster run over the stored articles; the very first one is a bootstrap."""
    if not store.path_exists(spark, f"{path}/articles"):
        return None
    articles = spark.read.parquet(f"{path}/articles").select("id", "title", "embedding", "published_at", "day")
    if runs.read_runs(spark, path) is None:
        tables = runs.bootstrap_run(articles, 1, 1, now, epsilon=options.get("epsilon", 0.2))
        runs.write_cluster_run(tables, path)
        return tables
    return runs.evolve_run(path, articles, now, generated, **options)
