"""Table sources and the asset manifest."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types by file extension.
CONTENT_TYPES = {
    "webp": "image/webp",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "avif": "image/avif",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """JDBC table; give a column and bounds to read it in parallel ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One HTML document per URL."""
    return spark.read.parquet(path).select("url", "html")


def scan_articles(
    articles: DataFrame,
    columns: Sequence[str] = ("id", "title", "embedding", "published_at"),
    since: datetime | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Pruned article scan: named columns, strictly after ``since``, newest ``limit`` rows."""
    out = articles
    if since is not None:
        out = out.where(F.col("published_at") > since)
    if limit is not None:
        out = out.orderBy(F.desc("published_at"), F.asc("id")).limit(limit)
    return out.select(*columns)


def content_type(extension: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit(DEFAULT_CONTENT_TYPE))


def manifest(spark: SparkSession, path: str, key_prefix: str = "", key_suffix: str = "") -> DataFrame:
    """Key, md5, extension and content type of every file below ``path``.

    The object key is ``key_prefix`` + relative name, with ``key_suffix`` before the extension.
    """
    root = "file:" + path.rstrip("/") + "/" if path.startswith("/") else path.rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.replace("path", F.lit(root), F.lit("")).alias("name"), F.md5("content").alias("md5"))
    )
    extension = F.regexp_extract("name", r"\.([^./]+)$", 1)
    stem = F.regexp_replace("name", r"\.[^./]+$", "")
    dotted = F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(F.lit(""))
    return files.select(
        F.concat(F.lit(key_prefix), stem, F.lit(key_suffix), dotted).alias("key"),
        "md5",
        extension.alias("ext"),
        content_type(extension).alias("content_type"),
    )


def changed_objects(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files that are missing remotely or whose md5 differs from the (unquoted) etag."""
    etags = remote.select("key", F.trim(F.col("etag"), F.lit('"')).alias("_etag"))
    return local.join(etags, "key", "left").where(~F.col("md5").eqNullSafe(F.col("_etag"))).drop("_etag")
