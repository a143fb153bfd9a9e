"""Checks: feed formats, dates, character references, the ledger, the URL index, quarantine, counts, versions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom.functions.dates import date_reader, read_date
from newsloom.functions.text import decode_references
from newsloom.operators import store
from newsloom.operators.url_index import UrlIndex
from newsloom.plans import ingest
from newsloom.plans.checks_entries import FEED_ITEMS_SQL, ITEMS_PER_FEED, raw_feeds, xml_escape
from newsloom.plans.checks_runs import tick_inputs
from newsloom.plans.registry import as_text, check, text_sql
from newsloom.session import scratch_path
from newsloom.sources import feeds, snapshots
from newsloom.streaming.ingest import feed_stream, run_ingest

PUBLISHED = text_sql("published_at")
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Entries that the ticks of these checks keep, and whether they can be stored.
WANTED_SQL = FEED_ITEMS_SQL + """
, wanted AS (
  SELECT id, url, news_provider_key, feed_title, title, vec_id IS NOT NULL AND id % 7 <> 0 AS answered
  FROM items LEFT JOIN embeddings ON vec_id = id
  WHERE (id % 7 = 0 OR id % 11 <> 0) AND NOT (news_provider_key = 'src7' AND starts_with(feed_title, 'T')))
"""


# -- feeds -------------------------------------------------------------------------------------------


def mixed_feeds(v):
    """The articles as feeds of three formats; every thirteenth body is cut off."""
    feed_no = F.floor(F.col("id") / ITEMS_PER_FEED)
    img = F.concat(F.lit("https://cdn.example/medium/"), F.col("id").cast("string"), F.lit("/medium.jpg"))
    title, date = xml_escape(F.col("title")), F.date_format("published_at", ISO)
    rss = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>"), F.col("url"), F.lit("</link><dc:date>"), date,
        F.lit('</dc:date><media:group><media:content url="'), img, F.lit('" type="image/jpeg"/></media:group></item>'),
    )
    atom = F.concat(
        F.lit('<entry><title type="html">'), title, F.lit('</title><link rel="self" href="/self"/><link href="'), F.col("url"),
        F.lit('"/><updated>'), date, F.lit('</updated><link rel="enclosure" type="image/jpeg" href="'), img, F.lit('"/></entry>'),
    )
    rdf = F.concat(
        F.lit('<item rdf:about="u"><title>'), title, F.lit("</title><link>"), F.col("url"), F.lit("</link><dc:date>"), date, F.lit("</dc:date></item>"),
    )
    item = F.when(feed_no % 3 == 0, rss).when(feed_no % 3 == 1, atom).otherwise(rdf)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", item.alias("x")))), lambda s: s["x"]), "")
    spaces = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/"'
    bodies = {
        0: (f'<?xml version="1.0"?><rss {spaces}><channel><title>f</title>', "</channel></rss>"),
        1: ('<?xml version="1.0"?><!-- a feed --><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>', "</feed>"),
        2: (f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" {spaces}><channel><title>f</title></channel>', "</rdf:RDF>"),
    }
    head, tail = F.lit(None), F.lit(None)
    for k, (before, after) in bodies.items():
        head = F.when(F.col("feed_no") % 3 == k, F.lit(before)).otherwise(head)
        tail = F.when(F.col("feed_no") % 3 == k, F.lit(after)).otherwise(tail)
    tail = F.when(F.col("feed_no") % 13 == 12, F.lit("")).otherwise(tail)
    rows = v.articles().groupBy(F.col("news_provider_key").alias("provider_key"), feed_no.alias("feed_no")).agg(items.alias("items"))
    return rows.select(
        "provider_key", F.concat(F.lit("https://feeds.example/"), "provider_key", F.lit("/"), F.col("feed_no").cast("string")).alias("feed_url"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("fetched_at"), F.concat(head, "items", tail).alias("body"),
    )


@check("mixed_feeds", "articles", r"""
SELECT news_provider_key AS provider_key, ['rss', 'atom', 'rdf'][(id // 50) % 3 + 1] AS format, nullif(trim(title), '') AS title, url AS link,
       strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published,
       CASE WHEN (id // 50) % 3 < 2 THEN 'https://cdn.example/medium/' || id || '/medium.jpg' END AS image
FROM articles WHERE (id // 50) % 13 <> 12""")
def mixed_feeds_check(v):
    """RSS 2.0, Atom and RSS 1.0 bodies in one table."""
    rows = feeds.feed_rows(mixed_feeds(v)).where("readable")
    image = F.get(F.concat("enclosures", "media"), F.lit(0))["_url"]
    return rows.select("provider_key", "format", F.nullif(F.trim("title"), F.lit("")).alias("title"), "link", "published", image.alias("image"))


@check("mixed_feeds_unreadable", "articles", """
SELECT news_provider_key AS provider_key, 'https://feeds.example/' || news_provider_key || '/' || (id // 50) AS feed_url
FROM articles WHERE (id // 50) % 13 = 12 GROUP BY 1, 2""")
def mixed_feeds_unreadable(v):
    """Bodies of any format that are cut off."""
    return feeds.quarantined_feeds(mixed_feeds(v)).select("provider_key", "feed_url")


@check("date_formats", "articles", f"""
SELECT id, CASE WHEN id % 9 = 8 THEN NULL WHEN id % 9 = 7 THEN strftime(published_at, '%Y-%m-%d 00:00:00')
                WHEN id % 9 = 6 THEN strftime(published_at, '%Y-%m-%d %H:%M:00') ELSE {PUBLISHED} END AS published_at
FROM articles""")
def date_formats(v):
    """RFC 822, named zones, ISO and local formats, each read by its own strptime format."""
    cases = [
        ("%a, %d %b %Y %H:%M:%S %z", "'Thu, 'd MMM yyyy HH:mm:ss' +0000'"),
        ("%A, %d-%b-%y %H:%M:%S %Z", "'Thursday, 'dd-MMM-yy HH:mm:ss' GMT'"),
        ("%Y-%m-%dT%H:%M:%S%z", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ("%Y-%m-%dT%H:%M:%S%z", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        ("%Y-%m-%d %H:%M:%S.%f", "yyyy-MM-dd  HH:mm:ss'.000'"),
        ("%d. %m. %Y ob %H:%M:%S", "d. M. yyyy 'ob' H:mm:ss"),
        ("%B %d, %Y %I:%M %p", "MMMM d, yyyy h:mm a"),
        ("%d/%m/%Y", "dd/MM/yyyy"),
        ("%Y-%m-%d", "dd MMM yyyy"),
    ]
    kind = F.col("id") % len(cases)
    strptime, written = F.lit(None), F.lit(None)
    for k, (directives, pattern) in enumerate(cases):
        strptime = F.when(kind == k, F.lit(directives)).otherwise(strptime)
        written = F.when(kind == k, F.date_format("published_at", pattern)).otherwise(written)
    return v.articles().select("id", as_text(read_date(written, date_reader(strptime))).alias("published_at"))


@check("character_references", sql="SELECT doc_id, text FROM documents")
def character_references(v):
    """Whole texts written with references decode to themselves."""
    text = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    written = {"<": "&lt;", ">": "&gt;", "é": "&eacute;", "ä": "&#228;", "ñ": "&#xF1;", "ç": "&ccedil;", "ü": "&uuml;", "$": "&dollar;", "!": "&#33;", ",": "&comma;"}
    for char, reference in written.items():
        text = F.replace(text, F.lit(char), F.lit(reference))
    return v.table("documents").select("doc_id", decode_references(text).alias("text"))


# -- ticks -------------------------------------------------------------------------------------------


@check("late_answers", "articles", WANTED_SQL + """
SELECT CASE WHEN answered THEN 'stored' ELSE 'waiting' END AS state, url,
       CASE WHEN NOT answered THEN 2 END AS tries, CASE WHEN answered THEN CASE WHEN feed_title <> '' THEN feed_title ELSE title END END AS title
FROM wanted""")
def late_answers(v):
    """Pages, answers and vectors arrive between two ticks, the second of which fetches nothing: every
    entry that can be stored is, and the others wait after two tries."""
    path, all_of = scratch_path(v.spark, "late"), tick_inputs(v)
    lookups = ("pages", "responses", "embeddings")

    def arrive(part: int) -> None:
        for name in lookups:
            table = getattr(all_of, name)
            table.where(F.pmod(F.xxhash64("url", F.lit(name)), F.lit(2)) == part).write.mode("append").parquet(f"{path}/{name}")

    inputs = replace(all_of, **{name: ingest.living(f"{path}/{name}") for name in lookups})
    raw = raw_feeds(v).drop("feed_no")
    arrive(0)
    ingest.run_tick(raw, inputs, path, batch="1")
    arrive(1)
    ingest.run_tick(raw.limit(0), inputs, path, now=F.lit("2024-02-01 00:10:00").cast("timestamp"), batch="2")
    stored = v.spark.read.parquet(f"{path}/articles").select(F.lit("stored").alias("state"), "url", F.lit(None).cast("int").alias("tries"), "title")
    waiting = ingest.pending(v.spark, path).select(F.lit("waiting").alias("state"), F.col("link").alias("url"), "tries", F.lit(None).cast("string").alias("title"))
    return stored.unionByName(waiting)


@check("url_index", "articles", "SELECT url, id % 4 <> 3 AS known FROM articles")
def url_index(v):
    """Three ticks' URLs, the third added twice, and a compaction; then all URLs are looked up."""
    urls = v.articles().select("id", "url")
    index = UrlIndex(v.spark, scratch_path(v.spark, "urls"), buckets=16)
    for part in (0, 1, 2, 2):
        index.add(urls.where(F.col("id") % 4 == part))
    index.compact(files=2)
    known = index.known(urls.select("url")).withColumn("_known", F.lit(True))
    return urls.join(known, "url", "left").select("url", F.coalesce("_known", F.lit(False)).alias("known"))


@check("stream_quarantine", "articles", FEED_ITEMS_SQL + """
SELECT 'bad_feed' AS kind, news_provider_key AS provider_key, NULL AS link, NULL AS detail FROM articles
WHERE (id // 50) % 13 = 12 GROUP BY news_provider_key, id // 50
UNION ALL
SELECT CASE WHEN news_provider_key = 'src3' THEN 'unknown_provider' ELSE 'bad_date' END, news_provider_key,
       CASE WHEN news_provider_key = 'src3' THEN feed_link ELSE
            regexp_replace(CASE WHEN id % 5 = 0 THEN 'https://' || news_provider_key || '.example' || feed_link ELSE feed_link END, '/+$', '') END,
       CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN 'yesterday'
            ELSE 'Mon, ' || strftime(published_at, '%-d %b %Y %H:%M:%S') || ' +0000' END
FROM items WHERE news_provider_key = 'src3' OR (id % 7 <> 0 AND id % 11 = 0)""")
def stream_quarantine(v):
    """Unreadable bodies, bad dates and unknown providers of a stream whose last batch ran twice."""
    path, inputs = scratch_path(v.spark, "aside"), tick_inputs(v)
    inputs = replace(inputs, providers=inputs.providers.where("key <> 'src3'"))
    raw_feeds(v).drop("feed_no").repartition(2, "feed_url").write.parquet(f"{path}/feeds")

    def run() -> None:
        stream = feed_stream(v.spark, f"{path}/feeds", files_per_batch=1)
        run_ingest(stream, inputs, path, f"{path}/checkpoint", every=None).awaitTermination()

    run()
    # As after a crash: the batch is planned but not committed.
    commits = f"{path}/checkpoint/commits"
    last = max(int(n) for n in snapshots._names(v.spark, commits) if n.isdigit())
    snapshots._files(v.spark, commits).delete(snapshots._path(v.spark, f"{commits}/{last}"), False)
    run()
    return ingest.read_quarantine(v.spark, path).select("kind", "provider_key", "link", "detail")


@check("tick_counts", "articles", WANTED_SQL + """
, counts AS (
  SELECT 'items' AS metric, count(*) AS value FROM items UNION ALL
  SELECT 'bad_date', count(*) FROM items WHERE id % 7 <> 0 AND id % 11 = 0 UNION ALL
  SELECT 'bad_feed', count(DISTINCT (news_provider_key, id // 50)) FROM articles WHERE (id // 50) % 13 = 12 UNION ALL
  SELECT 'unknown_provider', 0 UNION ALL SELECT 'expired', 0 UNION ALL
  SELECT 'kept', count(*) FROM wanted UNION ALL
  SELECT 'created', count(*) FROM wanted WHERE answered UNION ALL
  SELECT 'pending', count(*) FROM wanted WHERE NOT answered)
SELECT batch, metric, CASE WHEN batch = 'again' AND metric = 'created' THEN 0 ELSE value END AS value
FROM counts, (SELECT unnest(['first', 'again']) AS batch)""")
def tick_counts(v):
    """What a tick counts while it runs, and the same feeds once more, of which all is stored or waits."""
    path, inputs = scratch_path(v.spark, "counts"), tick_inputs(v)
    for batch in ("first", "again"):
        ingest.run_tick(raw_feeds(v).drop("feed_no"), inputs, path, batch=batch)
    return ingest.read_metrics(v.spark, path).select("batch", "metric", "value")


# -- versions ----------------------------------------------------------------------------------------


@check("catalogue_versions", "providers", """
SELECT 'pinned' AS reader, key, name, rank FROM providers UNION ALL
SELECT 'after a failure', key, name, rank FROM providers UNION ALL
SELECT 'latest', key, CASE WHEN rank < 2 THEN 'New ' || name ELSE name END, rank FROM providers UNION ALL
SELECT 'latest', 'fresh', 'New outlet', NULL""")
def catalogue_versions(v):
    """An upsert that fails half-way leaves the old catalogue; one that succeeds is seen by new readers only."""
    path, columns = scratch_path(v.spark, "catalogue"), ("key", "name", "rank")
    providers = v.providers().select(*columns)
    store.upsert_catalogue(providers, path)
    pinned_reader = snapshots.read_snapshot(v.spark, path).select(F.lit("pinned").alias("reader"), *columns)
    named = providers.where("rank < 2").select("key", F.concat(F.lit("New "), "name").alias("name"))
    try:
        store.upsert_catalogue(named.unionByName(named), path)
    except PySparkException:
        failed = snapshots.read_snapshot(v.spark, path).select(F.lit("after a failure").alias("reader"), *columns)
    store.upsert_catalogue(named.unionByName(named.sparkSession.createDataFrame([("fresh", "New outlet")], "key string, name string")), path)
    latest = snapshots.read_snapshot(v.spark, path).select(F.lit("latest").alias("reader"), *columns)
    return pinned_reader.unionByName(failed).unionByName(latest)


@check("article_versions", "articles", f"""
, seen AS (
  SELECT id, url, published_at + k * INTERVAL 1 DAY AS seen_at, title,
         CASE WHEN id % 3 = 1 AND k >= 2 OR id % 3 = 2 AND k = 1 THEN content || ' (altered)' ELSE content END AS content
  FROM articles, (SELECT unnest(range(4)) AS k)),
begun AS (SELECT *, lag(content) OVER w AS old FROM seen WINDOW w AS (PARTITION BY url ORDER BY seen_at)
          QUALIFY old IS NULL OR old <> content)
SELECT url, row_number() OVER w AS version, {text_sql("seen_at")} AS valid_from, {text_sql("lead(seen_at) OVER w")} AS valid_to,
       CASE WHEN old IS NULL THEN '' ELSE 'content' END AS altered, content
FROM begun WINDOW w AS (PARTITION BY url ORDER BY seen_at)""")
def article_versions(v):
    """Four sights of every article: unchanged, changed once, or changed and changed back."""
    day, k = F.expr("INTERVAL '1' DAY"), F.col("k")
    other = ((F.col("id") % 3 == 1) & (k >= 2)) | ((F.col("id") % 3 == 2) & (k == 1))
    rows = v.articles().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    seen = rows.select(
        "url", (F.col("published_at") + day * k).alias("seen_at"), "title",
        F.when(other, F.concat("content", F.lit(" (altered)"))).otherwise(F.col("content")).alias("content"),
    )
    out = store.article_versions(seen)
    return out.select(
        "url", "version", as_text("valid_from").alias("valid_from"), as_text("valid_to").alias("valid_to"),
        F.array_join("altered", ",").alias("altered"), "content",
    )
