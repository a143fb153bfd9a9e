"""Token counts of whole texts: batch encoding that returns lengths only."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import text_batches

#: Bytes of distinct pieces that one encoder call gets.
BATCH_BYTES = 1 << 20
#: Bytes of pieces whose lengths a Python worker remembers, over all its tasks.
KNOWN_BYTES = 96 << 20
#: A run of plain white space with the run after it.
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Other white space; libraries differ on what counts, so no cut is made next to it.
ODD = re.compile(r"[^\S \t\n\r]")
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def pieces_of(text: str) -> list[str]:
    return CUT.split(text) if ODD.search(text) else PIECE.findall(text)


def _encoder(path: str):
    """Texts to numbers of tokens, without added tokens."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


class Lengths:
    """Token counts of texts, adding up the counts of pieces cut at safe boundaries.

    For byte-level BPE a boundary between a character that isn't white space and a blank, tab or line
    end is safe: no match of the pre-tokenizer's pattern and no special token crosses it. So a text of
    any length is encoded in small pieces, and each distinct piece of a batch once. A model that adds a prefix to each text (.model) gets whole texts.
    """

    def __init__(self, path: str) -> None:
        self.encode, self.split = _encoder(path), path.endswith(".json")
        self.known: dict[str, int] = {}
        self.bytes = 0

    def _learn(self, pieces: list[str]) -> None:
        part: list[str] = []
        size = 0
        for piece in pieces:
            part.append(piece)
            size += len(piece) + 16
            if size >= BATCH_BYTES:
                self.known.update(zip(part, self.encode(part), strict=True))
                part, size = [], 0
        if part:
            self.known.update(zip(part, self.encode(part), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.split:
            out: list[int] = []
            part: list[str] = []
            size = 0
            for text in texts:
                part.append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    out += self.encode(part)
                    part, size = [], 0
            return out + (self.encode(part) if part else [])
        out = []
        if self.bytes > KNOWN_BYTES:
            self.known, self.bytes = {}, 0
        for text in texts:
            pieces = pieces_of(text)
            known = self.known
            new = [x for x in dict.fromkeys(pieces) if x not in known]
            if new:
                self.bytes += sum(map(len, new)) + 150 * len(new)
                self._learn(new)
            out.append(sum(map(known.__getitem__, pieces)))
        return out


@functools.lru_cache(maxsize=1)
def worker_lengths(path: str) -> Lengths:
    """The counter of this Python worker."""
    return Lengths(path)


def token_counts(
    docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 1024
) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a vocabulary file that every executor has. Null texts count as empty
    (0 bytes, 0 tokens). Rows are never dropped or joined: repeated ids stay repeated, a null id stays
    null. Extra columns are not read. No shuffle: only the counts leave the task, and a text of any
    length is encoded piece by piece.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_lengths(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = lengths.count(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
