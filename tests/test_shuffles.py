"""What a query shuffles, by Spark's own count."""

import random

import __spark_entry__ as entrypoint


def shuffled(spark, run, total=sum):
    """The result of ``run`` and the bytes that its stages write to shuffles (``total``: or the most of them)."""
    sc = spark.sparkContext
    sc.setJobGroup("shuffled", "shuffled")
    try:
        out = run()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup("shuffled") for s in tracker.getJobInfo(job).stageIds}
        return out, total(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_texts_without_a_vector_stay_where_they_are_read(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: f"{rng.randbytes(10).hex()}\n{rng.randbytes(5_000).hex()}"
    docs = [(i, text(), "en", f"src{i % 20}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(5 * i, "2024-01-01 00:00:00", "click") for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts string, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    vectors = [(i, [0.5, 0.25], i % 3) for i in range(0, 400, 20)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, size = shuffled(spark, lambda: entrypoint.queries()["assemble_article"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {int(r.url.rpartition("/")[2]) for r in rows} == {i for i in range(0, 400, 20) if i % 7}
    assert size < 1 << 21


def test_expressions_and_grams_are_not_shuffled_alone(spark, tmp_path):
    from newsloom.llm.toxicity import toxicity

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 12))) for _ in range(20_000)]
    docs = [(i, " ".join(rng.sample(words, 200))) for i in range(1_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(1_000)], "doc_id long, toxic int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, size = shuffled(spark, lambda: toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 1_000
    assert size < 15_000_000


def test_tokens_of_lines_meet_in_parts(spark):
    from newsloom.llm.line_dedup import line_dedup

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30_000)]
    docs = [(i, "\n".join(" ".join(rng.sample(words, 40)) for _ in range(10))) for i in range(1_000)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, size = shuffled(spark, lambda: line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), whole=False).collect(), max)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 1_000 and not any(r.n_removed for r in rows)
    assert size < 1_700_000


def test_texts_of_versions_are_shuffled_once(spark):
    """Four equal sights of each article: their texts meet where they are read and take part in one shuffle."""
    from pyspark.sql import functions as F

    from newsloom.operators.store import article_versions

    text = F.concat(*[F.sha2(F.concat_ws(" ", "id", F.lit(i)), 512) for i in range(40)])
    rows = spark.range(0, 400, 1, 4).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("t").alias("title"), text.alias("content"))
    seen = rows.withColumn("seen_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), F.timestamp_seconds)))
    sc, limit = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup("versions", "versions")
    try:
        out = article_versions(seen).collect()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for job in tracker.getJobIdsForGroup("versions") for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)}
        size = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(out) == 400 and {len(r.content) for r in out} == {40 * 128}
    assert 400 * 40 * 64 < size < 2 * 400 * 40 * 128
