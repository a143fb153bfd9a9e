"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import scratch_path

#: Rows per Arrow batch: whole texts are long, so batches are small.
TEXT_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


class Scratch:
    """Tables of one job in the shared folder: lineage is cut and the planner knows their sizes. Each goes
    when nothing reads it again, i.e. when what was made of it is written itself."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        """``options``: more of Parquet's writer."""
        self.paths[name] = scratch_path(self.spark, name)
        df.write.options(compression="zstd", **options).parquet(self.paths[name])
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join ``many`` to ``one`` (one row per key), dealing each key of ``many`` out to ``salts`` tasks.

    A key that holds a third of all rows is then at most a third / ``salts`` of them in a task;
    ``one`` is repeated ``salts`` times, so it should be the narrow side. Null keys match nothing.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of equal integer keys in a partition that is sorted by them, one table for each."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if carry is not None:
            rows = pa.concat_tables([carry, rows])
        change = np.zeros(rows.num_rows - 1, bool)
        for key in keys:
            values = rows.column(key).to_numpy()
            change |= values[1:] != values[:-1]
        edges = np.flatnonzero(change) + 1
        start = 0
        for end in edges:
            yield rows.slice(start, end - start)
            start = int(end)
        carry = rows.slice(start)
    if carry is not None and carry.num_rows:
        yield carry


class Forest:
    """Union-find over hashable nodes; ``edges`` gives each node's link to the least of its set."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[tuple[int, int]]:
        for x in list(self.parent):
            if (root := self.find(x)) != x:
                yield x, root
