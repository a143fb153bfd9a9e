"""Streaming ingest: the batch tick inside ``foreachBatch``, with restart from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators import entries as E
from newsloom.plans import ingest
from newsloom.sources.feeds import parse_feeds

TICK = "10 minutes"


def feed_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw feed bodies as they land in a folder of parquet files."""
    reader = spark.readStream.schema(schemas.RAW_FEED)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def entry_stream(raw: DataFrame, inputs: ingest.Inputs, lateness: str = "1 hour") -> DataFrame:
    """Entries of a feed stream without a store: recent, wanted, one per link within ``lateness``.

    The recency cut drops what is older than the provider's window; the watermark bounds the
    de-duplication state.
    """
    clock = F.col("fetched_at")
    items = E.dated(parse_feeds(raw), inputs.providers, clock).where("published_at IS NOT NULL")
    wanted = E.exclude(E.is_recent(items, inputs.providers, clock), inputs.exclusions)
    return (
        E.clamp_future(wanted, clock)
        .withWatermark("fetched_at", lateness)
        .dropDuplicatesWithinWatermark(["link"])
        .select("link", "provider_key", "title", "published_at", "summary", "fetched_at")
    )


def run_ingest(
    raw: DataFrame,
    inputs: ingest.Inputs,
    path: str,
    checkpoint: str,
    every: str | None = TICK,
    cluster: bool = False,
    titles: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> StreamingQuery:
    """Start the endless ingest; ``every=None`` processes what is there and stops.

    A batch that is replayed after a crash adds nothing twice: its links are found in the index, and its
    quarantine and counts replace those of the first attempt (batches are named by the query and their
    number). Inputs given as functions are read again for every batch (``plans.ingest.living``).
    ``cluster`` also evolves the cluster run after each batch, at the batch's newest fetch time;
    the options are those of ``plans.runs.evolve_run``.
    """

    def process(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        ingest.run_tick(batch, inputs, path, batch=f"{query}-{number:012d}")
        if cluster:
            at = batch.agg(F.max("fetched_at")).first()[0]
            ingest.cluster_tick(batch.sparkSession, path, F.lit(at), titles, **options)

    writer = raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
