"""Versioned tables: a version is written to a folder of its own and published by one pointer file.

Pointers are numbered and created only if absent, so a version is visible whole or not at all, two
writers can't publish the same number, and a reader that pinned a version keeps it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_published"


class PublishConflict(RuntimeError):
    """Another writer published the version after the one that this writer started from."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, at = _files(spark, folder), _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return [int(n) for n in _names(spark, f"{path}/{POINTERS}") if n.isdigit() and _folder(spark, path, int(n))]


def _folder(spark: SparkSession, path: str, version: int) -> str | None:
    """Folder of a version. A pointer whose writing did not end names none."""
    at = f"{path}/{POINTERS}/{version:012d}"
    stream = _files(spark, at).open(_path(spark, at))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text.strip() if text.endswith("\n") else None


def latest(spark: SparkSession, path: str) -> int | None:
    found = versions(spark, path)
    return found[-1] if found else None


def location(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """Folder of a version (default: the latest), None if there is none."""
    at = latest(spark, path) if version is None else version
    folder = None if at is None else _folder(spark, path, at)
    return None if folder is None else f"{path}/{folder}"


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A published version (default: the latest), pinned: what is published later does not change it."""
    at = location(spark, path, version)
    return None if at is None else spark.read.parquet(at)


def stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a version that nobody sees yet; returns its folder."""
    folder = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    return folder


def publish(spark: SparkSession, path: str, folder: str, after: int | None = None) -> int:
    """Make a staged folder the version after ``after`` (default: the latest now); returns its number."""
    if after is None:
        after = latest(spark, path) or 0
    number = after + 1
    at = f"{path}/{POINTERS}/{number:012d}"
    try:
        out = _files(spark, at).create(_path(spark, at), False)
    except Exception as error:
        if "FileAlreadyExists" in str(error) or "already exists" in str(error):
            raise PublishConflict(f"version {number} of {path} is there already") from error
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    return number


def write_snapshot(df: DataFrame, path: str, after: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
    """Write a DataFrame as the next version. A write that fails leaves the latest version as it was."""
    return publish(df.sparkSession, path, stage(df, path, partition_by), after)


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` versions, pointers first; returns the numbers that went."""
    gone = versions(spark, path)[: -keep if keep else None]
    for number in gone:
        folder = _folder(spark, path, number)
        for at in (f"{path}/{POINTERS}/{number:012d}", f"{path}/{folder}"):
            _files(spark, at).delete(_path(spark, at), True)
    return gone
