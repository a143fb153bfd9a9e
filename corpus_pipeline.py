"""A corpus pipeline of five stages; each works on the rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table
from newsloom.llm.decontamination import decontaminate
from newsloom.llm.line_dedup import line_dedup
from newsloom.llm.pieces import default_model, encode
from newsloom.llm.simhash import without_near_copies
from newsloom.llm.toxicity import toxicity
from newsloom.session import scratch_path, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted to these documents, reject go."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    gone = scored.where((F.col("predicted") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_toxic")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_toxic"), "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly or exactly repeat an earlier line go; every document stays, if with fewer
    lines, and ``n_chars`` counts what is left."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is similar to a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with whether they decode to its text."""
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return encode(docs, default_model(), keep=keep)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("encoding", encode_pieces),
]

#: No SQL states the fitted models, the fingerprints or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a written table that the next stage reads."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
