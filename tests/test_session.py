import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.session import as_dimension, numbered, tune


def test_numbered_equals_row_number_with_a_hot_group(spark):
    """Half of the rows share one group and many share one time."""
    df = spark.range(4000).select(
        "id",
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 37).cast("string")).alias("g"),
        F.timestamp_seconds(F.floor(F.col("id") / 500)).alias("t"),
    )
    order = [F.desc("t"), F.asc("id")]
    got = numbered(df, order, by=["g"], start=1)
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint"))
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == 4000
    whole = numbered(df, order, out="n", start=5).agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(whole) == (5, 4004, 4000)


def test_as_dimension_checks_size(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("twice"))
    small, big = as_dimension(df, 100), as_dimension(df, 99)
    assert big is df
    assert "LocalRelation" in small._jdf.queryExecution().optimizedPlan().toString()
    assert small.exceptAll(df).isEmpty()


def test_a_growing_join_side_does_not_pass_through_the_driver(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10m")
        tune(spark)
        left, right = (spark.range(300_000).withColumn(name, F.xxhash64("id", F.lit(name))) for name in "ab")
        joined = left.join(right, "id")
        assert joined.count() == 300_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        for lower in ("-1", "256k"):
            spark.conf.set(key, lower)
            tune(spark)
            assert spark.conf.get(key) in (lower, str(256 << 10))
    finally:
        spark.conf.set(key, before)


def test_batches_of_long_rows_are_bounded(spark):
    """What a Python task holds at once follows from bytes, not from the number of rows."""
    rows = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), F.lit(20_000)).alias("html"))
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"id": pa.array([b.num_rows], pa.int64())}) for b in batches), "id bigint")
    most = sizes.agg(F.max("id"), F.sum("id")).first()
    assert most[1] == 2000 and most[0] * 20_000 <= 8 << 20
