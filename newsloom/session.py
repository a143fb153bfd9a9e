"""Session helpers: clock zone, durable lineage cuts, small dimensions, distributed numbering."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIMENSION_ROWS = 10_000
#: A join side of more bytes does not pass through the driver to all tasks; in memory it takes many times these.
BROADCAST_BYTES = 1 << 20
#: Bytes of an Arrow batch to or from Python: rows may be whole pages, so their number alone bounds no memory.
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time options every operator assumes. A lower limit for broadcasts, or none (-1), stays."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(min(limit, BROADCAST_BYTES)))
    _ship_package(spark)
    return spark


def tidy_shuffles(spark: SparkSession) -> None:
    """Delete a job's shuffle files when it ends, not when the driver next collects its garbage. What
    still wants them (a DataFrame that is run again) has their stages run again."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context; they need it to unpickle tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_newsloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.addPyFile(shutil.make_archive(f"{folder}/newsloom", "zip", package.parent, package.name))
    sc._newsloom_shipped = True


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(shared)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables a check has to write."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, so a lost executor replays from storage."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_dimension(df: DataFrame, max_rows: int = DIMENSION_ROWS) -> DataFrame:
    """Turn a lookup table into local rows when it is proven small, else return it unchanged.

    At most ``max_rows + 1`` rows reach the driver, as Arrow: that makes a local relation whose size
    the planner knows, so it is broadcast without a hint. A bigger table keeps its shuffle join.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def local_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """Literal rows as a local relation."""
    return as_dimension(spark.createDataFrame(list(rows), schema))


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    out: str = "position",
    start: int = 0,
) -> DataFrame:
    """Dense position of each row in ``order`` (per ``by`` group), without a one-task window.

    Rows are range-partitioned on the whole sort key, so a group of any size spreads over many
    slices; each slice numbers its own rows and adds the row count of the slices before it.
    ``order`` must be total. The slice numbers are pinned first: they may not change on replay.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pinned(
        df.repartitionByRange(slices, *[F.col(c) for c in by], *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    local = placed.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order))
    )
    sizes = placed.groupBy(*by, "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("_slice")
    offsets = sizes.select(
        *by,
        "_slice",
        F.coalesce(
            F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return (
        local.join(offsets, [*by, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_before") + F.lit(start - 1)).cast("bigint"))
        .drop("_slice", "_local", "_before")
    )
