"""Feeds, dates, references, the URL index, snapshots, the ledger and article history on odd rows."""

import html
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions.dates import date_reader, read_date
from newsloom.functions.text import decode_references
from newsloom.operators import store
from newsloom.operators.url_index import UrlIndex, maybe_among
from newsloom.plans import ingest
from newsloom.sources import feeds, snapshots
from tests.test_streaming import T0, feed, make_inputs

RSS = """<?xml version="1.0"?><!-- c --><!DOCTYPE rss [<!ENTITY x "y">]>
<rss version="2.0"><channel><item><title>One</title><media:title>not this</media:title><link>http://a/1</link>
<dc:date>2025-07-04T12:00:00Z</dc:date><media:group><media:content url="http://i/1.jpg" type="image/jpeg"/></media:group>
<enclosure url="e.jpg" type="image/jpeg"/></item></channel></rss>"""
ATOM = """﻿<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title type="html">Two &lt;b&gt;</title>
<link rel="self" href="self"/><link href="http://a/2"/><link rel="enclosure" href="f.png" type="image/png"/><updated>2025-07-04T12:00:00+02:00</updated>
<content type="html">body</content><media:content url="http://i/2.jpg" type="image/jpeg"/></entry></feed>"""
RDF = """<rdf:RDF><channel><title>c</title></channel><item rdf:about="u"><title>Three</title><link>http://a/3</link>
<dc:date>2025-07-04</dc:date><description>d</description></item></rdf:RDF>"""


def test_feed_formats(spark):
    bodies = {"rss": RSS, "atom": ATOM, "rdf": RDF, "empty": "<feed/>", "html": "<html><body/></html>", "cut": ATOM[:-20], "cut rss": RSS[:-20], "text": "rss", "none": None}
    rows = [("p", name, T0, body) for name, body in bodies.items()]
    out = {(r.feed_url, r.readable): r for r in feeds.feed_rows(spark.createDataFrame(rows, schemas.RAW_FEED)).collect()}
    assert {u for u, readable in out if not readable} == {"html", "cut", "cut rss", "text", "none"}
    rss, atom, rdf = (out[name, True] for name in ("rss", "atom", "rdf"))
    assert len(out) == 8  # a feed without entries has no row, and is no bad one
    assert (rss.title, rss.link, rss.published) == ("One", "http://a/1", "2025-07-04T12:00:00Z")
    assert [m._url for m in rss.media] == ["http://i/1.jpg"] and [e._url for e in rss.enclosures] == ["e.jpg"]
    assert (atom.title, atom.link, atom.content) == ("Two <b>", "http://a/2", "body")
    assert [m._url for m in atom.media] == ["http://i/2.jpg"] and [e._url for e in atom.enclosures] == ["f.png"]
    assert (rdf.title, rdf.link, rdf.published, rdf.summary, rdf.media) == ("Three", "http://a/3", "2025-07-04", "d", [])


def test_unknown_directive_is_an_error(spark):
    row = spark.createDataFrame([("%Y %Q", "2025 x")], "f string, t string")
    with pytest.raises(PySparkException, match="unknown directive %Q"):
        row.select(read_date(F.col("t"), date_reader(F.col("f")))).collect()


@pytest.mark.parametrize(
    "directives, text, want",
    [
        ("%d %b %Y, %A", "4 Jul 2025, Friday", datetime(2025, 7, 4)),
        ("%a %d %b %Y", "Friday  4 Jul 2025 ", datetime(2025, 7, 4)),
        ("%b %d %Y", "Jul 4 2025", datetime(2025, 7, 4)),
        ("%Y-%m-%dT%H:%M:%S.%f%z", "2025-07-04T12:00:00.25+0200", datetime(2025, 7, 4, 10, 0, 0, 250000)),
        ("100%% %Y o'clock", "100% 2025 o'clock", datetime(2025, 1, 1)),
        ("%Y-%m-%d", "4. 7. 2025", None),
        ("%Y-%m-%d", None, None),
    ],
)
def test_dates(spark, directives, text, want):
    row = spark.createDataFrame([(directives, text)], "f string, t string")
    assert row.select(read_date(F.col("t"), date_reader(F.col("f"))).alias("d")).first().d == want


def test_references_as_the_standard_library_reads_them(spark):
    cases = [
        "a &amp; b", "&amp;lt;", "&notit; &notin; &not", "&#65;&#x41;&#X1F600;&#128;&#129;&#0;&#xD800;&#99999999;&#xFFFFFFFFFF;&#x;&#;&",
        "&nbsp;x&eacute;&copy 2&copyx", "AT&T &unknown; &", "&CounterClockwiseContourIntegral;&NotEqualTilde;", "plain", "", "&&amp;&", "&lt&gt&quot", "&amp" * 300,
    ]
    rows = spark.createDataFrame([(c,) for c in [*cases, None]], "t string").select("t", decode_references(F.col("t")).alias("d")).collect()
    for row in rows:
        assert row.d == (None if row.t is None else html.unescape(row.t))
    link = spark.createDataFrame([("/a?x=1&copy=2&amp;y=3&copy;&copy",)], "t string")
    assert link.select(decode_references(F.col("t"), attribute=True).alias("d")).first().d == "/a?x=1&copy=2&y=3©©"


def test_index_reads_the_buckets_of_its_links(spark, tmp_path):
    index = UrlIndex(spark, str(tmp_path / "urls"), buckets=8)
    urls = spark.range(200).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    index.add(urls.limit(150), 10)
    assert index.known(urls).count() == 150 and index.mark() == 10
    one = index.known(urls.where("url = 'u7'"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    # One bucket is read, and the index is not shuffled for the join.
    assert "PartitionFilters" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert index.known(urls.limit(0)).isEmpty()
    odd = spark.createDataFrame([(None,), ("u1",), ("u1",)], "url string")
    assert [r.url for r in index.known(odd).collect()] == ["u1"]
    # The number of buckets stays what it was, and compaction changes no answer.
    index.add(urls)
    assert index.compact(files=1) and not index.compact(files=1)
    again = UrlIndex(spark, str(tmp_path / "urls"), buckets=99)
    assert again.buckets == 8 and again.known(urls).count() == 200 and again.rows().count() == 200


def test_index_catches_up_after_a_crash(spark, tmp_path):
    index = UrlIndex(spark, str(tmp_path / "urls"), buckets=4)
    articles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, url string")
    index.add(articles.where("id = 1").select("url"), 1)
    assert index.catch_up(articles, booked=3) and not index.catch_up(articles, booked=3)
    assert index.known(articles.select("url")).count() == 3


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.latest(spark, path) is None and snapshots.read_snapshot(spark, path) is None
    assert [snapshots.write_snapshot(spark.range(n).toDF("id"), path) for n in (1, 2, 3)] == [1, 2, 3]
    old = snapshots.read_snapshot(spark, path, 2)
    with pytest.raises(snapshots.PublishConflict):
        snapshots.write_snapshot(spark.range(9).toDF("id"), path, after=2)
    # A pointer that was never finished names no version.
    (tmp_path / "t" / snapshots.POINTERS / f"{4:012d}").write_text("v-half")
    assert snapshots.latest(spark, path) == 3 and old.count() == 2
    assert snapshots.drop_old(spark, path, keep=2) == [1] and snapshots.versions(spark, path) == [2, 3]
    assert old.count() == 2 and snapshots.read_snapshot(spark, path).count() == 3


def test_late_answer_and_expiry(spark, tmp_path):
    """Entry 4 has no answer at first, entry 3 no page; entry 40 never gets one and expires."""
    path = str(tmp_path / "store")
    answers = tmp_path / "answers"
    payload = F.lit('{"summary":"s","rank":3,"categories":["sport"],"stock_image_search":"q","is_paywalled":false}')
    inputs = make_inputs(spark, 12)
    inputs.responses.write.parquet(str(answers))
    inputs = replace(inputs, responses=ingest.living(str(answers)))
    first = ingest.run_tick(spark.createDataFrame([feed(0, 1, 3, 4, 40)], schemas.RAW_FEED), inputs, path, batch="a")
    assert sorted(r.title for r in first.added.collect()) == ["T1", "T3"] and first.counts["pending"] == 2
    late = spark.createDataFrame([("https://www.delo.si/n/4",)], "url string").select("url", payload.alias("payload"))
    late.write.mode("append").parquet(str(answers))
    nothing = spark.createDataFrame([], schemas.RAW_FEED)
    second = ingest.run_tick(nothing, inputs, path, now=F.lit(T0 + timedelta(minutes=10)), batch="b")
    assert [r.title for r in second.added.collect()] == ["T4"] and second.counts["pending"] == 1
    third = ingest.run_tick(nothing, inputs, path, now=F.lit(T0 + timedelta(days=300)), batch="c")
    assert third.counts["expired"] == 1 and third.counts["pending"] == 0 and third.added.isEmpty()
    aside = ingest.read_quarantine(spark, path).collect()
    assert [(r.kind, r.link, r.batch) for r in aside] == [("expired", "https://www.delo.si/n/40", "c")]
    assert [r.id for r in spark.read.parquet(f"{path}/articles").orderBy("id").collect()] == [1, 2, 3]


def test_article_versions(spark):
    at = [T0 + timedelta(hours=h) for h in range(5)]
    rows = [("a", at[0], "t", "x"), ("a", at[1], "t", "x"), ("a", at[2], "t", "y"), ("a", at[3], "u", "x"), ("a", at[4], "u", "x")]
    rows += [("b", at[2], None, None), ("b", at[3], None, None), ("b", at[4], "n", None), (None, at[0], "q", "q"), ("c", None, "q", "q")]
    rows += [("a", at[2], "t", "y"), ("d", at[0], "t", "2"), ("d", at[0], "t", "1")]
    seen = spark.createDataFrame(rows, "url string, seen_at timestamp, title string, content string")
    out = store.article_versions(seen).collect()
    got = {(r.url, r.version): (r.valid_from, r.valid_to, r.altered, r.title, r.content) for r in out}
    assert got == {
        ("a", 1): (at[0], at[2], [], "t", "x"),
        ("a", 2): (at[2], at[3], ["content"], "t", "y"),
        ("a", 3): (at[3], None, ["title", "content"], "u", "x"),
        ("b", 1): (at[2], at[4], [], None, None),
        ("b", 2): (at[4], None, ["title"], "n", None),
        ("d", 1): (at[0], None, [], "t", "1"),
    }
    assert store.article_versions(seen.limit(0)).isEmpty()


def test_versions_of_one_url_over_many_ranges(spark):
    """Sights of one URL fill all ranges; looking back works across their borders."""
    seen = spark.range(400).select(
        F.lit("u").alias("url"), (F.lit(T0).cast("timestamp") + F.expr("INTERVAL '1' MINUTE") * F.col("id")).alias("seen_at"),
        F.lit("t").alias("title"), F.floor(F.col("id") / 3).cast("string").alias("content"),
    )
    out = sorted(store.article_versions(seen).collect(), key=lambda r: r.version)
    assert [r.version for r in out] == list(range(1, 135)) and [int(r.content) for r in out] == list(range(134))
    assert all(a.valid_to == b.valid_from for a, b in zip(out, out[1:])) and out[-1].valid_to is None


def test_versions_carry_digests_not_texts(spark):
    """Of sights at one time the least values count, equal ones once; texts take part in the last join only."""
    hour = timedelta(hours=1)
    rows = [("u", T0, "b", "x"), ("u", T0, "a", "z"), ("u", T0, "a", "z"), ("u", T0 + hour, "a", "z"), ("u", T0 + 2 * hour, None, "z"),
            ("u", T0 + 2 * hour, None, "z"), ("u", T0 + 3 * hour, "", "z")]
    seen = spark.createDataFrame(rows, "url string, seen_at timestamp, title string, content string")
    out = store.article_versions(seen)
    got = sorted((r.version, r.valid_from, r.valid_to, r.altered, r.title, r.content) for r in out.collect())
    later = [T0 + 2 * hour, T0 + 3 * hour, None]
    assert got == [(1, T0, later[0], [], "a", "z"), (2, later[0], later[1], ["title"], None, "z"), (3, later[1], None, ["title"], "", "z")]
    wide = spark.range(2000).select(F.lit("u").alias("url"), F.timestamp_seconds("id").alias("seen_at"), F.lit("t").alias("title"), F.repeat(F.lit("x"), F.lit(1000)).alias("content"))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    store.article_versions(wide).count()
    written = sum(p.stat().st_size for p in folder.rglob("part-*") if p not in before)
    assert written < 2000 * 1000


def test_rows_of_other_urls_stay_where_they_are_read(spark):
    urls = spark.range(1000).selectExpr("concat('https://x.example/', id) AS url").unionByName(spark.createDataFrame([(None,)], "url string"))
    table = spark.range(20000).selectExpr("concat('https://x.example/', id) AS url")
    kept = table.where(maybe_among(urls, 1 << 16)(F.col("url")))
    assert kept.count() < 2000 and kept.join(urls, "url", "left_semi").count() == 1000
    full = table.where(maybe_among(urls, 64)(F.col("url")))
    assert full.join(urls, "url", "left_semi").count() == 1000
    assert table.where(maybe_among(urls.limit(0))(F.col("url"))).isEmpty()


def test_lookup_tables_are_cut_below_their_joins(spark):
    """Texts of other URLs are left out before the join that makes a table shuffles them."""
    left = spark.range(5000).selectExpr("id", "concat('u', id) AS url", "repeat('x', 100) AS html")
    pages = left.join(spark.range(5000).hint("merge"), "id").select("url", "html")
    cut = pages.where(maybe_among(spark.createDataFrame([("u1",)], "url string"))(F.col("url")))
    plan = cut._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(n for n, line in enumerate(plan) if "Join Inner" in line)
    assert any("scalar-subquery" in line for line in plan[join:]) and not any("scalar-subquery" in line for line in plan[:join])
    assert [r.url for r in cut.collect()] == ["u1"]


def test_entries_without_a_vector_look_nothing_up(spark):
    """Only entries with a vector reach the pages; what becomes an article stays the same."""
    kind = "link string, provider_key string, title string, published_at timestamp, summary string, image_urls array<string>"
    entries = spark.createDataFrame([(f"u{i}", "p", "t", T0, "s", []) for i in range(3)], kind)
    answer = '{"summary": "s", "rank": 1, "categories": ["a"], "stock_image_search": "q", "is_paywalled": false}'
    responses = spark.createDataFrame([("u0", answer), ("u1", answer), ("u9", answer)], "url string, payload string")
    vectors = spark.createDataFrame([("u1", [1.0]), ("u2", [1.0])], "url string, embedding array<double>")
    fails = F.when(F.col("url") == "u0", F.raise_error(F.lit("looked up"))).otherwise("<title>x</title>")
    pages = spark.createDataFrame([("u0",), ("u1",)], "url string").select("url", fails.cast("string").alias("html"))
    inputs = ingest.Inputs(None, None, None, pages, responses, vectors)
    assert [r.url for r in ingest.build_articles(entries, inputs).collect()] == ["u1"]
