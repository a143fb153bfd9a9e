"""Index of stored URLs, bucketed by hash: a tick reads the buckets of its links and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import pinned
from newsloom.sources import snapshots

#: Buckets of a new index; an index keeps the number that it was made with.
BUCKETS = 64
#: Links of a tick that are sent to where the buckets are read; more of them are joined by a shuffle.
FEW = 100_000
#: Appended files of a bucket that make the index worth compacting.
FILES = 16
#: Bits of the bounded table by which rows of other URLs are left where they are read.
FILTER_BITS = 1 << 22


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def maybe_among(urls: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A condition that holds for every URL of ``urls[url]``, and for few others, to leave rows where they are
    read before a join shuffles them. It is a table of ``bits`` bits, whatever the number of URLs: far more
    URLs than bits leave nothing out, and the join decides in any case."""
    number = lambda url: F.xxhash64(url).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("n").bitwiseAND(F.lit(63)).cast("int"))
    words = urls.where("url IS NOT NULL").select(number(F.col("url")).alias("n"))
    words = words.groupBy(F.shiftright("n", 6).alias("slot")).agg(F.bit_or(bit).alias("word"))
    slots = urls.sparkSession.range(bits // 64).select(F.col("id").alias("slot")).join(words, "slot", "left")
    every = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))))
    table = slots.agg(every.getField("word").alias("words")).scalar()

    def among(url: Column) -> Column:
        n = number(url)
        return F.getbit(F.get(table, F.shiftright(n, 6).cast("int")), n.bitwiseAND(F.lit(63)).cast("int")) == 1

    return among


class UrlIndex:
    """``url`` of every stored article below ``path``, in folders ``bucket=N``.

    The buckets lie in a published version; ticks append files to them, and ``compact`` publishes a
    version with one file a bucket. ``marks`` holds the largest article id that the index covers. The
    article table books ids before it writes, so an index whose mark lags behind the book is one that a
    tick died on; ``catch_up`` then adds the articles above the mark.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path
        at = snapshots.location(spark, path)
        if at is None:
            empty = spark.createDataFrame([], "url string")
            # The number of buckets is part of the version's name: it can't change under its rows.
            empty.write.parquet(f"{path}/b{buckets}-first/bucket=0")
            snapshots.publish(spark, path, f"b{buckets}-first", after=0)
            at = snapshots.location(spark, path)
        self.at = at
        self.buckets = int(at.rsplit("/", 1)[1].split("-")[0][1:])

    def rows(self) -> DataFrame:
        return self.spark.read.schema("url string, bucket int").parquet(self.at)

    def known(self, urls: DataFrame) -> DataFrame:
        """Those of ``urls[url]`` that are stored. Reads only the buckets that the URLs fall in.

        The driver learns the bucket numbers (at most ``buckets``) and the number of URLs. Few URLs go
        to where the buckets are read, so nothing of the index is shuffled; many are joined by key.
        """
        asked = pinned(urls.select("url").where("url IS NOT NULL").distinct().withColumn("bucket", bucket_of(F.col("url"), self.buckets)))
        found = asked.groupBy("bucket").agg(F.count("*").alias("n")).collect()
        stored = self.rows().where(F.col("bucket").isin([r.bucket for r in found]) if found else F.lit(False))
        side = F.broadcast(asked) if sum(r.n for r in found) <= FEW else asked
        return stored.join(side, ["bucket", "url"], "left_semi").select("url").distinct()

    def mark(self) -> int:
        marks = snapshots.read_snapshot(self.spark, f"{self.path}/marks")
        return 0 if marks is None else marks.first()[0]

    def add(self, urls: DataFrame, up_to: int | None = None) -> None:
        """Append URLs; ``up_to`` is the largest id among the articles that are covered from now on.
        URLs that are there already do no harm, so a repeated call changes no answer."""
        rows = urls.select("url").where("url IS NOT NULL").withColumn("bucket", bucket_of(F.col("url"), self.buckets))
        # One file for each bucket: rows of a bucket meet in a task, which sorts them.
        rows.repartition("bucket").sortWithinPartitions("bucket", "url").write.mode("append").partitionBy("bucket").parquet(self.at)
        if up_to is not None:
            snapshots.write_snapshot(self.spark.range(1).select(F.lit(up_to).cast("bigint").alias("up_to")), f"{self.path}/marks")
            snapshots.drop_old(self.spark, f"{self.path}/marks")

    def catch_up(self, articles: DataFrame, booked: int) -> bool:
        """Add the articles above the mark if the book is ahead of it; True if it was."""
        mark = self.mark()
        if booked <= mark:
            return False
        self.add(articles.where(F.col("id") > mark), booked)
        return True

    def files(self) -> int:
        """Most files of a bucket."""
        files, path = snapshots._files(self.spark, self.at), snapshots._path(self.spark, f"{self.at}/bucket=*/*.parquet")
        count: dict[str, int] = {}
        for status in files.globStatus(path) or []:
            folder = status.getPath().getParent().getName()
            count[folder] = count.get(folder, 0) + 1
        return max(count.values(), default=0)

    def compact(self, files: int = FILES) -> bool:
        """Once a bucket has more than ``files`` files, publish a version with one sorted file a bucket and
        each URL once. The version before stays for who reads it."""
        if self.files() <= files:
            return False
        at = snapshots.latest(self.spark, self.path)
        folder = f"b{self.buckets}-{at + 1:012d}"
        rows = self.rows().distinct().repartition("bucket").sortWithinPartitions("bucket", "url")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        snapshots.publish(self.spark, self.path, folder, after=at)
        snapshots.drop_old(self.spark, self.path)
        self.at = f"{self.path}/{folder}"
        return True
