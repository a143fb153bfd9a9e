"""Text quality from the sizes that two zstandard dictionaries compress a text to.

One dictionary is trained on pieces of good labelled texts, one on pieces of bad ones. A text that is
like the good ones gets smaller with the good dictionary. The difference of both sizes, divided by their
sum, is turned into the likelihood of label 1 by a logistic model fitted on labelled texts that no
dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.session import pinned

#: Labelled rows that are learnt from, at most: those with the smallest hashes of their ids.
LABELLED_ROWS = 40_000
#: Bytes of a dictionary, and of a piece: texts are compressed in pieces, so that every part of a long
#: text meets the dictionary and not only the text before it.
DICTIONARY, PIECE = 112 << 10, 1024
#: Pieces that a dictionary is trained on, at most: those with the smallest hashes, from all over the texts.
SAMPLE_PIECES = 12_000
#: Compression level. Higher ones find more repeats inside the piece and lean less on the dictionary.
LEVEL = 3
#: One in so many labelled rows is kept from the dictionaries, for the calibration.
CALIBRATION = 3
#: Ridge of the logistic model.
RIDGE = 1e-3


def pieces(text: str | None) -> list[bytes]:
    """UTF-8 bytes of a text in pieces; an empty text is one empty piece."""
    data = (text or "").encode("utf-8", "replace")
    return [data[k : k + PIECE] for k in range(0, len(data), PIECE)] or [b""]


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples. Too few or too uniform ones can't be trained on; then the samples
    themselves are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"\n".join(samples)[:DICTIONARY]


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good texts and the weights of the logistic model. Without texts of both
    kinds there is no dictionary, and every text gets ``prior``."""

    dictionaries: tuple[bytes, bytes] | None
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in self.dictionaries:
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            out.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        return out


def sizes(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> tuple[int, int, int]:
    """Bytes of a text, and of its pieces compressed with the bad and with the good dictionary."""
    cut = pieces(text)
    bad, good = (sum(len(c.compress(p)) for p in cut) for c in compressors)
    return sum(map(len, cut)), bad, good


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of (1, normalised difference, log of the compressed share, their product).

    The share tells repetitive texts, both of whose sizes are small, from others with the same difference.
    """
    raw, bad, good = counts.T.astype(np.float64)
    difference = (bad - good) / np.maximum(bad + good, 1)
    share = np.log((bad + good + 1) / (2 * raw + 1))
    # The weights are of like size if the columns are.
    return np.stack([np.ones(len(raw)), 20 * difference, share, 20 * difference * share], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = RIDGE * max(len(y), 1) * np.eye(x.shape[1])
    for _ in range(rounds):
        p = likelihood(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def likelihood(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order, so that a score doesn't depend on the other rows of its batch."""
    at = np.zeros(len(x))
    for k in range(x.shape[1]):
        at += x[:, k] * w[k]
    return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(name, label, text)`` of at most ``rows`` labelled texts that are not held out.

    Labels other than 0 and 1 are none, and neither are ids with both. Of an id with several texts all
    are taken.
    """
    known = (
        labels.select(F.col("doc_id").cast("string").alias("name"), F.col("quality").cast("int").alias("label"))
        .where("name IS NOT NULL AND label IN (0, 1)")
        .where(~held_out(F.col("name")))
        .groupBy("name")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("name", "label", F.xxhash64("name", F.lit("row")).alias("order"))
        # The ids only: the bound keeps what passes the driver small.
        .orderBy("order", "name")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    # At most ``rows`` ids and labels: small enough to go to where the texts are.
    return texts.join(F.broadcast(known), "name").select("name", "label", "text")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, label, text in zip(*(batch.column(c) for c in ("name", "label", "text")), strict=True):
            cut = [p for p in pieces(text.as_py()) if p]
            n = len(cut)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label.as_py()] * n, pa.int32()), pa.array([name.as_py()] * n), pa.array(range(n), pa.int32()), pa.array(cut, pa.binary())],
                    names=["label", "name", "at", "piece"],
                )


def _trained(rows: pa.Table) -> pa.Table:
    held = rows.sort_by([("order", "ascending"), ("piece", "ascending")])
    data = train(held.column("piece").to_pylist())
    return pa.table({"label": pa.array([rows.column("label")[0].as_py()], pa.int32()), "dictionary": pa.array([data], pa.binary())})


def _counts(model: Model, keep: list[tuple[str, pa.DataType]]):
    """Rows with the columns ``keep`` and a text to these columns and the three sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            counts = np.array([sizes(t.as_py(), compressors) for t in batch.column("text")], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).cast(kind) for c, kind in keep), *(pa.array(counts[:, k]) for k in range(3))],
                names=[*(c for c, _ in keep), "raw", "bad", "good"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """The model of ``labels.quality`` for ``docs``.

    Learns from at most ``rows`` labelled rows outside the held-out fold, chosen by a hash of the id.
    A third of them calibrates; pieces of the others, ``SAMPLE_PIECES`` for each label at most, train
    the dictionaries, each in a task of its own. What reaches the driver is two dictionaries and three
    sizes for each calibrating row.
    """
    chosen = pinned(labelled(docs, labels, rows).withColumn("part", F.pmod(F.xxhash64("name", F.lit("part")), F.lit(CALIBRATION))))
    cut = chosen.where("part <> 0").select("name", "label", "text").mapInArrow(_pieces, "label int, name string, at int, piece binary")
    cut = cut.withColumn("order", F.xxhash64("name", "at"))
    first = Window.partitionBy("label").orderBy("order", "piece")
    sample = cut.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_PIECES)
    trained = sample.select("label", "order", "piece").groupBy("label").applyInArrow(_trained, "label int, dictionary binary")
    found = {row.label: bytes(row.dictionary) for row in trained.collect()}
    counted = dict(chosen.groupBy("label").count().collect())
    good, bad = counted.get(1, 0), counted.get(0, 0)
    prior = (good + 1) / (good + bad + 2)
    if 0 not in found or 1 not in found:
        return Model(None, prior=prior)
    model = Model((found[0], found[1]), prior=prior)
    held = chosen.where("part = 0").select("label", "text").mapInArrow(
        _counts(model, [("label", pa.int32())]), "label int, raw long, bad long, good long"
    ).toArrow()
    y = held.column("label").to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        # Nothing to calibrate with: the sign of the difference decides, around the prior.
        return Model(model.dictionaries, (float(np.log(prior / (1 - prior))), 1.0, 0.0, 0.0), prior)
    counts = np.stack([held.column(c).to_numpy() for c in ("raw", "bad", "good")], axis=1)
    order = np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], y))
    return Model(model.dictionaries, tuple(logistic(features(counts[order]), y[order]).tolist()), prior)


def quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, least: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the sizes ``raw, bad, good`` of every row of ``docs``.

    ``score`` is the likelihood of label 1; ``predicted`` is 1 from ``least`` on. Null and empty texts
    are alike and get the score of no evidence. Rows that share an id are scored each by its own text; a
    row without an id is scored, never learnt from and not held out. Without labels of both kinds every
    row gets the smoothed share of label 1 (0.5 without any). Other columns of the tables are not read.
    """
    model = fit(docs, labels, rows)
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType
    if model.dictionaries is None:
        zero = F.lit(0).cast("bigint")
        out = texts.select(
            "doc_id", "held_out", F.lit(float(model.prior)).alias("score"), F.octet_length("text").cast("bigint").alias("raw"),
            zero.alias("bad"), zero.alias("good"),
        )
    else:
        keep = [("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_())]
        weights = np.array(model.weights)
        count = _counts(model, keep)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in count(batches):
                counts = np.stack([rows.column(c).to_numpy() for c in ("raw", "bad", "good")], axis=1)
                values = likelihood(features(counts), weights)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(values), *rows.columns[2:]], names=["doc_id", "held_out", "score", "raw", "bad", "good"])

        out = texts.mapInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, score double, raw long, bad long, good long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), "raw", "bad", "good")
