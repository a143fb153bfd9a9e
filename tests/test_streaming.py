from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import monitor
from newsloom.plans import ingest, runs
from newsloom.sources import catalog
from newsloom.streaming import alerts
from newsloom.streaming.ingest import feed_stream, run_ingest

T0 = datetime(2025, 7, 4, 12, 0, 0)


def feed(minute, *ids):
    at = T0 + timedelta(minutes=minute)
    items = "".join(
        f"<item><title>T{i}</title><link>/n/{i}</link><pubDate>Fri, 4 Jul 2025 {at:%H:%M:%S} +0000</pubDate></item>" for i in ids
    )
    return ("delo", "https://delo/rss", at, f"<rss><channel>{items}</channel></rss>")


def make_inputs(spark, n=12):
    url = F.concat(F.lit("https://www.delo.si/n/"), F.col("id").cast("string"))
    ids = spark.range(n)
    payload = F.lit('{"summary":"s","rank":3,"categories":["sport"],"stock_image_search":"q","is_paywalled":false}')
    line = F.array((F.floor(F.col("id") / 2) * 10 + (F.col("id") % 2) * 0.1).cast("double"), F.lit(0.0))
    return ingest.Inputs(
        providers=catalog.provider_catalog(spark),
        exclusions=catalog.exclusion_rules(spark),
        image_rules=catalog.image_rules(spark),
        pages=ids.where("id <> 3").select(url.alias("url"), F.lit("<p>page</p>").alias("html")),
        responses=ids.where("id <> 4").select(url.alias("url"), payload.alias("payload")),
        embeddings=ids.select(url.alias("url"), line.alias("embedding")),
        stock=ids.select(url.alias("url"), F.lit("stock.jpg").alias("stock_url")),
    )


def drop(spark, path, *feeds):
    spark.createDataFrame(list(feeds), schemas.RAW_FEED).coalesce(1).write.mode("append").parquet(path)


def test_ingest_restarts_without_repeats(spark, tmp_path):
    path, feeds = str(tmp_path / "store"), str(tmp_path / "feeds")
    inputs = make_inputs(spark)

    def run():
        stream = feed_stream(spark, feeds, files_per_batch=1)
        run_ingest(stream, inputs, path, str(tmp_path / "checkpoint"), every=None, cluster=True).awaitTermination()
        return spark.read.parquet(f"{path}/articles")

    drop(spark, feeds, feed(0, 0, 1, 2, 3, 4, 0))
    first = run()
    assert sorted(r.title for r in first.collect()) == ["T0", "T1", "T2", "T3"]
    assert first.where("title = 'T3'").first().content is None
    assert first.where("title = 'T0'").first().image_urls == ["stock.jpg"]
    drop(spark, feeds, feed(10, 1, 5, 6), ("rtv", "https://rtv/rss", T0, "<not a feed"))
    second = run()
    assert sorted(r.title for r in second.collect()) == ["T0", "T1", "T2", "T3", "T5", "T6"]
    assert sorted(r.id for r in second.collect()) == [1, 2, 3, 4, 5, 6]
    stored = runs.read_runs(spark, path)
    assert stored.run.count() == 2
    assert stored.memberships.where("run_id = 2").count() == 6
    # A replayed batch finds its links in the store.
    raw = spark.createDataFrame([feed(10, 1, 5, 6)], schemas.RAW_FEED)
    assert ingest.tick(raw, inputs, path).isEmpty()
    assert second.count() == 6


def log(spark, *minutes):
    rows = [(T0 + timedelta(minutes=m), "ingest", "tick done: 3 articles stored" if ok else "tick") for m, ok in minutes]
    return spark.createDataFrame(rows, schemas.LOG_EVENT)


def test_batch_alert_holds_before_firing(spark):
    lines = log(spark, (0, True), (10.5, True), (31, False), (36, False), (37, True), (60, False))
    fired = monitor.liveness_alert(lines, "tick done: .* articles stored").collect()
    at = sorted((r.tick - int((T0 - datetime(1970, 1, 1)).total_seconds())) // 60 for r in fired)
    # Silent after 10.5: breached from 31, firing at 36; healthy from 37; breached again from 57.
    assert at == [36]
    periods = monitor.breach_periods(monitor.breaches(lines, "tick done")).collect()
    assert len(periods) == 2 and sum(p.fires_at is not None for p in periods) == 1


def test_stream_alert_fires_without_a_later_success(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, (0, True), (10.5, True)).coalesce(1).write.mode("append").parquet(path)
    log(spark, (20, False), (70, False)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schemas.LOG_EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        alerts.silence_alerts(stream, "tick done")
        .writeStream.outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .format("parquet").option("path", str(tmp_path / "out"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.service, r.fires_at) for r in got] == [
        ("ingest", int((T0 - datetime(1970, 1, 1)).total_seconds()) + 36 * 60)
    ]


def test_shares_of_many_files_lose_no_lines(spark, tmp_path):
    """A log in more files than one per stretch of time: the counts and silences are those of all lines."""
    from pyspark.sql import Window

    from newsloom.plans import checks_runs

    class View:
        pass

    v = View()
    v.spark = spark
    n = 3000
    ts = (F.lit(T0).cast("timestamp").cast("double") + F.col("id") * 61.7 + F.floor(F.col("id") / 1000) * 4000).cast("timestamp")
    lines = spark.range(n).select(ts.alias("ts"), F.lit("ingest").alias("service"), F.lit("tick done").alias("message"))
    lines = lines.repartition(7)
    path = str(tmp_path / "counts")
    checks_runs.land(v, lines, path, lambda stream: alerts.success_counts(stream, "tick done"))
    got = {(r.since, r.n) for r in spark.read.parquet(f"{path}/out").collect()}
    closed = lines.groupBy(F.window("ts", "20 minutes", "1 minute").alias("w")).count().select("w.*", "count")
    newest = lines.agg(F.max("ts") - F.expr("INTERVAL 5 MINUTES")).first()[0]
    assert got == {(r.start, r["count"]) for r in closed.where(F.col("end") <= F.lit(newest)).collect()}

    path = str(tmp_path / "silence")
    checks_runs.land(v, lines, path, lambda stream: alerts.silence_alerts(stream, "tick done"))
    later = F.lead("ts").over(Window.orderBy("ts"))
    want = lines.withColumn("later", later).where("later > ts + INTERVAL 1 HOUR").select("ts").collect()
    newest = lines.agg(F.max("ts")).first()[0]
    out = spark.read.parquet(f"{path}/out").where(F.col("last_success") < F.lit(newest))
    assert sorted(r.last_success for r in out.collect()) == sorted(r.ts for r in want) and len(want) == 2


def test_first_and_last_line_of_a_minute_stay():
    import pyarrow as pa

    at = [pa.scalar(s * 1_000_000, pa.timestamp("us", "UTC")) for s in (65, 61, 119, 121)]
    lines = pa.record_batch({"ts": pa.array([a.as_py() for a in at], pa.timestamp("us", "UTC")), "service": ["a"] * 4,
                             "success": [True] * 4, "minute": [1, 1, 1, 2]})
    seconds = sorted(t.second + 60 * t.minute for b in alerts._ends_of_minutes(iter([lines])) for t in b["ts"].to_pylist())
    assert seconds == [61, 119, 121, 121]
