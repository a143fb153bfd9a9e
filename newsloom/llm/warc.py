"""WARC archives: write records, read them back, resolve revisits, write them deduplicated."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import salted_join
from newsloom.session import pinned, scratch_path

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed date of records made from a table without one.
DATE = "1970-01-01T00:00:00Z"
#: Records of one archive file.
FILE_RECORDS = 20_000

RECORD = """record_id string, page_id long, uri string, type string, digest string, payload_bytes long,
refers_to long, computed string, payload string"""


def _header(fields: list[tuple[str, Column]]) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}")]
    for name, value in fields:
        # A null value leaves its line out.
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit(CRLF))


def _uuid(*parts: Column) -> Column:
    return F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(F.md5(F.concat_ws("/", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(">"),
    )


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]", " ")


def response_records(pages: DataFrame) -> DataFrame:
    """``(record)``: a response record for each ``(record_id, page_id, uri, payload)``, without its
    closing line ends."""
    body = F.concat(F.lit(HTTP), F.col("payload"))
    digest = F.sha1(F.encode("payload", "UTF-8"))
    page = F.col("page_id").cast("string")
    return pages.select(
        F.concat(
            _header(
                [
                    ("WARC-Type", F.lit("response")),
                    ("WARC-Record-ID", F.col("record_id")),
                    ("WARC-Date", F.lit(DATE)),
                    ("WARC-Target-URI", _one_line(F.col("uri"))),
                    ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
                    ("Page-Id", page),
                    ("Content-Type", F.lit("application/http; msgtype=response")),
                    ("Content-Length", F.octet_length(body).cast("string")),
                ]
            ),
            body,
        ).alias("record")
    )


def revisit_records(heads: DataFrame) -> DataFrame:
    """``(record)``: a revisit record with fresh headers for each resolved head; its block is empty."""
    page = F.col("page_id").cast("string")
    return heads.select(
        _header(
            [
                ("WARC-Type", F.lit("revisit")),
                ("WARC-Record-ID", _uuid(F.lit("revisit"), page, F.col("record_id"))),
                ("WARC-Date", F.lit(DATE)),
                ("WARC-Target-URI", F.col("uri")),
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Profile", F.lit(PROFILE)),
                ("WARC-Refers-To", F.col("refers_record")),
                ("Page-Id", page),
                ("Refers-To-Page-Id", F.col("refers_to").cast("string")),
                ("Payload-Length", F.col("payload_bytes").cast("string")),
                ("Content-Length", F.lit("0")),
            ]
        ).alias("record")
    )


def write_archive(records: DataFrame, path: str) -> None:
    """Gzip archives, as many as the frame has partitions. Spark's committer publishes them, so a lost
    executor leaves no half-written file. The closing line ends are the writer's line separator."""
    (
        records.write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .mode("append")
        .text(path)
    )


def parse(stream, with_payload: bool) -> Iterator[tuple]:
    """Records of one archive, by their content lengths: a payload may hold anything."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip(" \r\n")
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is cut off")
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        whole = head["warc-type"] == "response"
        number = lambda name: int(head[name]) if name in head else None
        yield (
            head["warc-record-id"],
            number("page-id"),
            head.get("warc-target-uri"),
            head["warc-type"],
            head["warc-payload-digest"].partition(":")[2],
            len(payload) if whole else number("payload-length"),
            number("refers-to-page-id"),
            hashlib.sha1(payload).hexdigest() if whole else None,
            payload.decode("utf-8") if with_payload and whole else None,
        )


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of all archives below ``path``; payloads only where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for row in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), with_payload):
                    rows.append(row)
                    held += 200 + (row[5] or 0) * with_payload
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    kinds = [text, long, text, text, text, long, long, text, text]
    names = [x.split()[0] for x in RECORD.replace("\n", " ").split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def resolve(heads: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Decide which heads are revisits: ``refers_to`` and ``refers_record`` are null for responses.

    Heads are grouped by payload digest (partial sums first, one row per digest). Of a digest with
    several records the one with the largest page_id answers for all; rows that repeat that page_id
    and rows without one stay responses. The join deals a hot digest out to several tasks.
    """
    large = heads.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = large.groupBy("digest").agg(
        F.count("*").alias("_n"), F.max_by("record_id", "page_id").alias("_record"), F.max("page_id").alias("_page")
    )
    met = salted_join(heads, firsts.where("_n > 1").drop("_n"), "digest", F.col("record_id"), "left")
    again = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("_page"))
    return met.select(
        *heads.columns,
        F.when(again, F.col("_page")).alias("refers_to"),
        F.when(again, F.col("_record")).alias("refers_record"),
    )


def deduplicated_archive(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> tuple[str, str]:
    """Write every page to an archive, read it back, and write it deduplicated.

    Returns the folders of the full and of the deduplicated archive, both below the shared checkpoint
    folder. A null page is an empty payload, a null URI leaves its header out. Equal payloads of at
    least ``least_bytes`` are stored once; smaller ones are all stored. Payloads are shuffled once, and
    only those that stay.
    """
    spark = pages.sparkSession
    full, lean = scratch_path(spark, "warc-full"), scratch_path(spark, "warc-lean")
    source = pages.select(
        _uuid(F.col(id_col).cast("string"), F.col(uri_col), F.monotonically_increasing_id().cast("string")).alias("record_id"),
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(uri_col).alias("uri"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    )
    write_archive(response_records(source), full)
    heads = read_archive(spark, full).select("record_id", "page_id", "uri", "digest", "payload_bytes")
    resolved = pinned(resolve(heads, least_bytes))
    kept = resolved.where("refers_to IS NULL").select("record_id").hint("shuffle_hash")
    bodies = read_archive(spark, full, with_payload=True).select("record_id", "page_id", "uri", "payload")
    write_archive(response_records(bodies.join(kept, "record_id")), lean)
    write_archive(revisit_records(resolved.where("refers_to IS NOT NULL")), lean)
    return full, lean


def archive_table(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record below ``path``.
    Digests of stored payloads are computed anew; a revisit carries those of its response."""
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", F.coalesce("computed", "digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )
