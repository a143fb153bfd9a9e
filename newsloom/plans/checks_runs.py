"""Checks: evolving runs, backfill, storage of runs, streaming forms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from newsloom.operators.store import append_articles
from newsloom.plans import ingest, runs
from newsloom.plans.checks_articles import PUBLISHED
from newsloom.plans.checks_clusters import PATTERN
from newsloom.plans.checks_entries import FEED_ITEMS_SQL, raw_feeds
from newsloom.plans.registry import as_text, check
from newsloom.session import numbered, scratch_path
from newsloom.sources.catalog import exclusion_rules, image_rules
from newsloom.streaming import alerts
from newsloom.streaming.ingest import entry_stream, feed_stream, run_ingest

KEEP = timedelta(days=9)


def previous_run(v):
    """Membership of an earlier run: the stories up to two days before the newest article."""
    early = v.members().where(F.col("published_at") <= v.story_now() - F.lit(timedelta(days=2)))
    numbers = numbered(early.select("cluster_id").distinct(), [F.asc("cluster_id")], out="no", start=1)
    titles = numbers.select(F.col("no").alias("id"), F.concat(F.lit("Title of "), "cluster_id").alias("title"))
    members = early.join(numbers, "cluster_id").select(F.col("no").alias("cluster_id"), "article_id", "published_at")
    return members, titles


EARLY_SQL = """
, early AS (SELECT cluster_id, id, published_at, now FROM stories, story_clock WHERE published_at <= now - INTERVAL 2 DAY),
kept AS (SELECT * FROM early WHERE cluster_id IN
         (SELECT cluster_id FROM early GROUP BY cluster_id, now HAVING max(published_at) > now - INTERVAL 9 DAY)),
fresh AS (SELECT id, published_at FROM stories WHERE published_at > (SELECT max(published_at) FROM kept))
"""


@check("window_articles", "articles stories story_clock", EARLY_SQL + """
SELECT id FROM kept UNION ALL SELECT id FROM fresh""")
def window_articles(v):
    from newsloom.operators.clusters import drop_stale_clusters

    previous, _ = previous_run(v)
    kept = drop_stale_clusters(previous, v.story_now(), KEEP)
    return runs.window_articles(kept, v.articles_with_vectors(), v.story_now(), KEEP).select("id")


@check("evolve_run", "articles stories story_clock", EARLY_SQL + """
SELECT id AS article_id FROM kept UNION ALL SELECT id FROM fresh""")
def evolve_run(v):
    """A whole next run; SQL states that every window article is in it exactly once."""
    previous, titles = previous_run(v)
    draft = runs.draft_run(previous, titles, v.articles_with_vectors(), v.story_now(), KEEP, epsilon=1.1)
    return runs.finish_run(draft, None, 2, 1, v.story_now()).memberships.select("article_id")


@check("bootstrap_run")
def bootstrap_run(v):
    """First run over the newest articles: clusters with their titles and slugs."""
    tables = runs.bootstrap_run(v.articles_with_vectors(), 1, 1, v.story_now(), epsilon=1.1)
    return tables.clusters.select("id", "title", "slug", "run_id")


@check("backfill_run", "articles legacy_clusters", """
SELECT c.title, c.slug, count(*) AS members FROM legacy_clusters c JOIN articles a ON a.cluster_id = c.id GROUP BY 1, 2""")
def backfill_run(v):
    tables = runs.backfill_run(v.legacy_clusters(), v.articles(clusters=True), 7, v.story_now())
    return (
        tables.memberships.join(tables.clusters.select(F.col("id").alias("cluster_id"), "title", "slug"), "cluster_id")
        .groupBy("title", "slug")
        .agg(F.count("*").alias("members"))
    )


@check("write_cluster_run", "articles legacy_clusters", """
SELECT 'runs' AS "table", 1 AS "rows" UNION ALL
SELECT 'clusters', count(DISTINCT cluster_id) FROM articles UNION ALL
SELECT 'memberships', count(cluster_id) FROM articles""")
def write_cluster_run(v):
    """A run written, written again, and read back."""
    path = scratch_path(v.spark, "runs")
    tables = runs.backfill_run(v.legacy_clusters(), v.articles(clusters=True), 7, v.story_now())
    runs.write_cluster_run(tables, path)
    runs.write_cluster_run(tables, path)
    stored = runs.read_runs(v.spark, path)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in (
        ("runs", stored.run), ("clusters", stored.clusters), ("memberships", stored.memberships))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@check("append_articles", "articles", f"""
SELECT url, {PUBLISHED} AS published_at FROM articles""")
def append_articles_check(v):
    """Two overlapping batches, the second with repeats: every URL is stored once."""
    path = scratch_path(v.spark, "articles")
    rows = v.articles().select("id", "url", "title", "published_at", "news_provider_key")
    append_articles(rows.where("id % 2 = 0"), path)
    append_articles(rows.unionByName(rows.where("id % 3 = 0")), path)
    return v.spark.read.parquet(path).select("url", as_text("published_at").alias("published_at"))


def tick_inputs(v) -> ingest.Inputs:
    return ingest.Inputs(
        providers=v.providers().withColumn("time_window", F.expr("INTERVAL '60' DAY").cast("interval day to second")),
        exclusions=exclusion_rules(v.spark, [("src7", "title", "T")]),
        image_rules=image_rules(v.spark),
        pages=v.articles().select("url", F.concat(F.lit("<title>"), "title", F.lit("</title><p>"), "content").alias("html")),
        responses=v.responses(),
        embeddings=v.articles_with_vectors().select("url", "embedding"),
    )


TICK_SQL = FEED_ITEMS_SQL + """
, stored AS (
  SELECT * FROM items JOIN embeddings ON vec_id = id
  WHERE (id % 7 = 0 OR id % 11 <> 0) AND id % 7 <> 0 AND NOT (news_provider_key = 'src7' AND starts_with(feed_title, 'T')))
SELECT url, CASE WHEN feed_title <> '' THEN feed_title ELSE title END AS title FROM stored"""


@check("stream_ingest", "articles", TICK_SQL)
def stream_ingest(v):
    """Feeds in two files through the ingest stream; the store must hold what SQL derives."""
    path = scratch_path(v.spark, "ingest")
    raw_feeds(v).drop("feed_no").repartition(2, "feed_url").write.parquet(f"{path}/feeds")
    stream = feed_stream(v.spark, f"{path}/feeds", files_per_batch=1)
    run_ingest(stream, tick_inputs(v), path, f"{path}/checkpoint", every=None).awaitTermination()
    return v.spark.read.parquet(f"{path}/articles").select("url", "title")


@check("stream_entries", "articles", FEED_ITEMS_SQL + """
SELECT news_provider_key AS provider_key,
       regexp_replace(CASE WHEN id % 5 = 0 THEN 'https://' || news_provider_key || '.example' || feed_link ELSE feed_link END, '/+$', '') AS link
FROM items WHERE (id % 7 = 0 OR id % 11 <> 0) AND NOT (news_provider_key = 'src7' AND starts_with(feed_title, 'T'))""")
def stream_entries(v):
    """The same feeds twice over: links are de-duplicated within the watermark."""
    path = scratch_path(v.spark, "entries")
    feeds = raw_feeds(v).drop("feed_no")
    feeds.unionByName(feeds).repartition(3).write.parquet(f"{path}/feeds")
    entries = entry_stream(feed_stream(v.spark, f"{path}/feeds"), tick_inputs(v))
    query = entries.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return v.spark.read.parquet(f"{path}/out").select("provider_key", "link")


SHARES = 5


def land(v, log, path: str, start) -> None:
    """The log lands in time order, in shares of whole minutes that may hold any number of files. The query that
    ``start`` makes of the stream runs after each of them and takes it as one batch: files of one share are in no
    order, so a batch for each would find the rows of the later ones behind the watermark."""
    minute = F.floor(F.unix_seconds("ts") / 60)
    low, high = log.agg(F.min(minute), F.max(minute)).first()
    share = F.floor((minute - low) * SHARES / (high - low + 1))
    for part in range(SHARES):
        log.where(share == part).write.mode("append").parquet(f"{path}/log")
        stream = v.spark.readStream.schema(log.schema).parquet(f"{path}/log")
        writer = start(stream).writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start().awaitTermination()


@check("stream_success_counts", "log", """
SELECT service, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n FROM
 (SELECT service, date_trunc('minute', ts) - INTERVAL 1 MINUTE * unnest(range(20)) AS since FROM log WHERE event_type = 'click')
WHERE since + INTERVAL 20 MINUTE <= (SELECT max(ts) FROM log WHERE event_type = 'click') - INTERVAL 5 MINUTE
GROUP BY 1, 2""")
def stream_success_counts(v):
    """Sliding windows the watermark has closed."""
    path = scratch_path(v.spark, "counts")
    land(v, v.log(), path, lambda stream: alerts.success_counts(stream, PATTERN))
    return v.spark.read.parquet(f"{path}/out").select("service", as_text("since").alias("since"), "n")


SILENCE_SQL = """
, hits AS (SELECT epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (ORDER BY ts) AS following FROM log WHERE event_type = 'click'),
due AS (SELECT us, following, CAST(ceil((us + 1200000000) / 60e6) * 60 AS BIGINT) + 300 AS fires_at FROM hits)
SELECT 'ingest' AS service, fires_at FROM due WHERE following > fires_at * 1000000"""


@check("stream_silence_alerts", "log", SILENCE_SQL)
def stream_silence_alerts(v):
    """Silences between two successes, through state timers."""
    path = scratch_path(v.spark, "silence")
    land(v, v.log(), path, lambda stream: alerts.silence_alerts(stream, PATTERN))
    last = v.log().where(F.col("message").rlike(PATTERN)).agg(F.max("ts")).scalar()
    return v.spark.read.parquet(f"{path}/out").where(F.col("last_success") < last).select("service", "fires_at")


RULES = (alerts.Rule("short"), alerts.Rule("long", window=60 * 60, hold=10 * 60))

# Four services of which the last never succeeds, and one that never logs a line.
ABSENCE_SQL = """
, lines AS (SELECT ts, 'svc-' || (user_id % 4) AS service, event_type = 'click' AND user_id % 4 <> 3 AS ok
            FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id, event_type FROM events)),
starts AS (SELECT service, (SELECT min(ts) FROM lines) AS began, false AS seen FROM (SELECT DISTINCT service FROM lines UNION ALL SELECT 'svc-9')),
marks AS (SELECT service, min(ts) AS began, true AS seen FROM lines WHERE ok GROUP BY service, date_trunc('minute', ts) UNION ALL SELECT * FROM starts),
spans AS (SELECT *, lead(began) OVER (PARTITION BY service ORDER BY began, seen) AS until FROM marks),
rules AS (SELECT * FROM (VALUES ('short', 1200, 300), ('long', 3600, 600)) AS r(rule, width, hold)),
due AS (SELECT *, CAST(ceil((epoch_us(began) + width * 1000000::BIGINT) / 60e6) * 60 AS BIGINT) + hold AS fires_at FROM spans, rules)
SELECT service, rule, CASE WHEN seen THEN strftime(began, '%Y-%m-%d %H:%M:%S') END AS last_success, fires_at FROM due
WHERE epoch_us(coalesce(until, (SELECT max(ts) - INTERVAL 5 MINUTE FROM lines))) > fires_at * 1000000"""


def service_log(v):
    """The events as lines of four services, one of which never succeeds; the services, and one that never logs."""
    kind = F.col("user_id") % 4
    ok = (F.col("event_type") == "click") & (kind != 3)
    log = v.table("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("svc-"), kind.cast("string")).alias("service"),
        F.when(ok, F.lit("tick done: 3 articles stored")).otherwise(F.lit("tick")).alias("message"),
    )
    silent = v.spark.createDataFrame([("svc-9",)], "service string")
    since = log.agg(F.min("ts").alias("since"))
    return log, log.select("service").distinct().unionByName(silent).join(since)


@check("absence_periods", "log", ABSENCE_SQL)
def absence_periods(v):
    """Silences of listed services by two rules, from the whole log."""
    log, services = service_log(v)
    return alerts.absence_periods(log, PATTERN, services, RULES).withColumn("last_success", as_text("last_success"))


@check("stream_absence_alerts", "log", ABSENCE_SQL)
def stream_absence_alerts(v):
    """The same through state timers, while the log lands in time order."""
    path = scratch_path(v.spark, "absence")
    log, services = service_log(v)
    with alerts.rocksdb(v.spark):
        land(v, log, path, lambda stream: alerts.absence_alerts(stream, PATTERN, services, RULES))
    return v.spark.read.parquet(f"{path}/out").withColumn("last_success", as_text("last_success"))
