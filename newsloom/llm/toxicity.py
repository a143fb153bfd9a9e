"""Toxicity from class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from newsloom.llm.common import Scratch, text_batches
from newsloom.session import tidy_shuffles

#: Letters of a gram: a letter and those before it. Every letter and the end mark of an expression is modelled.
DEPTH = 8
#: Absolute discount and pseudo-count of the shared distribution.
DISCOUNT, SHARED = 0.75, 0.5
#: Share of toxic expressions that the toxic model supposes in a toxic text.
SHARE = 0.02
#: Labelled rows that are learnt from, at most: those with the smallest hashes of their ids.
LABELLED_ROWS = 40_000
#: Texts and letters of a chunk of texts, and expressions of a chunk of expressions.
TEXTS, LETTERS_HELD, WORDS = 2048, 1 << 23, 50_000
#: A chunk is a row of megabytes, so each is a row group: else a task holds up to 100 of them before it writes any, and
#: what reads them gets all of a group at once. Places are distinct numbers, which deltas store better than a dictionary.
CHUNKS = {"parquet.block.row.count.limit": "1", "parquet.writer.version": "v2", "parquet.enable.dictionary#at.list.element": "false"}

LETTERS = re.compile(r"[^\W\d_]+")
END = 0x1FFFFF
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def expressions(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower()) if text else []


def _mixed(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """64-bit hash of a state and the letter after it."""
    state = (state ^ code) * MIX
    state = (state ^ (state >> np.uint64(31))) * MIX2
    return state ^ (state >> np.uint64(29))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of each word and its end mark: the word's index, and 64-bit hashes of what stands
    before the letter and of both. What stands before a letter is the whole prefix, with the word's
    start, for the first DEPTH letters, and the last DEPTH - 1 letters after that."""
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    code = np.full(len(word), END, np.uint64)
    place = np.arange(len(word)) - starts[word]
    code[place < lengths[word] - 1] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    before, here = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    state = np.ones(len(words), np.uint64)
    for k in range(DEPTH):
        live = np.flatnonzero(lengths > k)
        at = starts[live] + k
        before[at] = state[live]
        here[at] = state[live] = _mixed(state[live], code[at])
    far = np.flatnonzero(place >= DEPTH)
    inner = np.full(len(far), 2, np.uint64)
    for k in range(DEPTH - 1, 0, -1):
        inner = _mixed(inner, code[far - k])
    before[far] = inner
    here[far] = _mixed(inner, code[far])
    return word, before.view(np.int64), here.view(np.int64)


def word_keys(words: list[str]) -> np.ndarray:
    """64-bit hashes of expressions."""
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64).view(np.int64)


def slot_bits(lists: DataFrame) -> int:
    """Bits of a key that name its slot, so that the keys of a slot stay as many when there are more lists."""
    return min(12, max(3, lists.count().bit_length() - 1))


def asked(of: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys as rows ``(of, slot, keys)``, one for each slot."""
    slots = keys >> (64 - bits)
    starts = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])[: len(slots)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(keys))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), of), pa.int64()), pa.array(slots[starts], pa.int64()), lists], names=["of", "slot", "keys"])


def answered(asks: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """``(of, slot, values)``: for the keys of each row of ``asks`` their values in ``table`` (columns ``key``,
    ``value``), 0 where it has none. Lists go there and back, so neither a key nor a value is a row alone."""

    def run(ask: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = known.column("key").to_numpy(), known.column("value").to_numpy()
        order = np.argsort(keys)
        keys, values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], 0.0)
        lists = ask.column("keys").combine_chunks()
        wanted = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, wanted)
        found = pa.array(np.where(keys[at] == wanted, values[at], 0.0))
        ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        return pa.table({"of": ask.column("of"), "slot": ask.column("slot"), "values": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)})

    known = table.select(F.shiftright("key", 64 - bits).alias("in"), "key", "value")
    return asks.groupBy("slot").cogroup(known.groupBy("in")).applyInArrow(run, "of long, slot long, values array<double>")


def in_order(found: pa.Table) -> np.ndarray:
    """The values of one list, in the order of its keys."""
    rows = found.sort_by("slot").column("values").combine_chunks()
    return pc.list_flatten(rows).to_numpy(zero_copy_only=False)


def text_chunks(docs: DataFrame, classes: dict[int, int]) -> DataFrame:
    """Chunks of ``(doc_id, text)``, a row for each: the ids, each text's number of distinct expressions
    (``sizes``), their places in ``words`` and how often they occur, the chunk's distinct expressions in
    the order of their keys, and in how many texts of class 0, of class 1 and of all each stands."""
    text_batches(docs.sparkSession)
    tidy_shuffles(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    types = {"chunk": pa.int64(), "doc_id": pa.list_(id_type)}
    types |= {c: pa.list_(pa.int32()) for c in ("sizes", "at", "n")} | {"words": pa.list_(pa.string())}
    types |= {c: pa.list_(pa.int64()) for c in ("d0", "d1", "d2")}

    def row(ids: list, bags: list[Counter]) -> pa.RecordBatch:
        known = shared.value
        places: dict[str, int] = {}
        at = [places.setdefault(w, len(places)) for bag in bags for w in bag]
        sizes = [len(bag) for bag in bags]
        kind = np.repeat(np.array([known.get(x, 2) for x in ids], np.int64), sizes)
        words = list(places)
        order = np.argsort(word_keys(words), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        where = rank[np.array(at, np.int64)]
        d = [np.bincount(where[kind == k], minlength=len(places)) for k in (0, 1)] + [np.bincount(where, minlength=len(places))]
        values = [uuid.uuid4().int >> 65, ids, sizes, where, [n for bag in bags for n in bag.values()], [words[i] for i in order], *d]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types.values(), strict=True)], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bags, held = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(name)
                bags.append(Counter(expressions(text)))
                held += len(text or "")
                if len(ids) >= TEXTS or held >= LETTERS_HELD:
                    yield row(ids, bags)
                    ids, bags, held = [], [], 0
        if ids:
            yield row(ids, bags)

    name = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_id array<{name}>, sizes array<int>, at array<int>, n array<int>, words array<string>, d0 array<long>, d1 array<long>, d2 array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def word_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of the distinct expressions of all texts, neighbours in their order, with the numbers of
    texts they stand in: what the lower orders see is in how many contexts (texts) an expression
    stands, as Kneser-Ney continuation counts do."""
    counted = chunks.select(F.explode(F.arrays_zip("words", "d0", "d1", "d2")).alias("x")).groupBy(F.col("x.words").alias("word"))
    counted = counted.agg(*[F.sum(f"x.{c}").alias(c) for c in ("d0", "d1", "d2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= WORDS):
                whole = pa.Table.from_batches(held).combine_chunks()
                lists = [pa.array([whole.column(c).to_pylist()]) for c in ("word", "d0", "d1", "d2")]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *lists], names=["part", "words", "d0", "d1", "d2"])
                held = []

    schema = "part long, words array<string>, d0 array<long>, d1 array<long>, d2 array<long>"
    return counted.repartitionByRange("word").mapInArrow(run, schema)


def gram_table(parts: DataFrame) -> DataFrame:
    """``(part, before, gram, n0, n1, n2)``: the distinct grams of each chunk of expressions, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                word, before, gram = grams(r["words"])
                kinds, first, where = np.unique(gram, return_index=True, return_inverse=True)
                n = [np.bincount(where, weights=np.array(r[c], np.int64)[word], minlength=len(kinds)).astype(np.int64) for c in ("d0", "d1", "d2")]
                columns = [pa.array(np.full(len(kinds), r["part"]), pa.int64()), *map(pa.array, (before[first], kinds, *n))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "before", "gram", "n0", "n1", "n2"])

    return parts.mapInArrow(run, "part long, before long, gram long, n0 long, n1 long, n2 long")


def steps(counts: DataFrame) -> DataFrame:
    """``(gram, step)``: log-likelihood of the gram's last letter under the toxic class minus that under
    the ordinary one. Where neither class knows what stands before, both are the shared distribution."""
    # One shuffle serves the grams, their contexts and the join of both.
    both = counts.repartition("before").groupBy("before", "gram").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])
    sums = [F.sum(f"n{k}").alias(f"m{k}") for k in range(3)] + [F.count_if(F.col(f"n{k}") > 0).alias(f"f{k}") for k in range(3)]
    contexts = both.groupBy("before").agg(*sums).where("m0 + m1 > 0")
    met = both.join(contexts, "before")
    left = lambda k: F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0))
    met = met.withColumn("shared", (left(2) + DISCOUNT * F.col("f2") / 64 + 0.01) / (F.col("m2") + 0.64))
    own = [(left(k) + (DISCOUNT * F.col(f"f{k}") + SHARED) * F.col("shared")) / (F.col(f"m{k}") + SHARED) for k in range(2)]
    return met.select("gram", (F.ln(own[1]) - F.ln(own[0])).alias("step"))


def gram_lists(parts: DataFrame, bits: int) -> DataFrame:
    """The distinct grams of each chunk of expressions, as ``asked`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield asked(r["part"], np.unique(grams(r["words"])[2]), bits)

    return parts.select("part", "words").mapInArrow(run, "of long, slot long, keys array<long>")


def word_lists(chunks: DataFrame, bits: int) -> DataFrame:
    """The distinct expressions of each chunk of texts, as ``asked`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield asked(r["chunk"], word_keys(r["words"]), bits)

    return chunks.select("chunk", "words").mapInArrow(run, "of long, slot long, keys array<long>")


def word_ratios(parts: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, value)`` from the chunks of expressions and the steps of their grams: an expression's key, and
    its log-likelihood under the toxic model minus that under the ordinary one. The toxic model mixes
    expressions of toxic texts into ordinary language, as toxic texts do."""

    def run(part: pa.Table, found: pa.Table) -> pa.Table:
        words = part.column("words")[0].as_py()
        word, _, gram = grams(words)
        where = np.unique(gram, return_inverse=True)[1]
        logs = np.bincount(word, weights=in_order(found)[where], minlength=len(words))
        return pa.table({"key": word_keys(words), "value": np.log1p(SHARE * np.expm1(np.minimum(logs, 60.0)))})

    return parts.select("part", "words").groupBy("part").cogroup(known.groupBy("of")).applyInArrow(run, "key long, value double")


def mean_ratios(docs: DataFrame, classes: dict[int, int]) -> DataFrame:
    """``(doc_id, ratio)`` of every row of ``(doc_id, text)``: the length-normalised log-likelihood ratio
    of the whole text (0 without expressions), learnt from the ``classes`` of some ids.

    Texts are read once. Expressions, grams and counts are tables, which grow with the texts, and each
    step of the way back looks up lists of a chunk's distinct expressions or grams, so no pair of a text
    and an expression is shuffled alone.
    """
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.write("chunks", text_chunks(docs, classes), **CHUNKS)
    parts = scratch.write("words", word_chunks(chunks), **CHUNKS)
    # Grams are made again rather than written: they are many times as large as the expressions.
    slopes = scratch.write("steps", steps(gram_table(parts).drop("part")))
    bits = slot_bits(parts)
    known = answered(gram_lists(parts, bits), slopes.select(F.col("gram").alias("key"), F.col("step").alias("value")), bits)
    ratios = scratch.write("expressions", word_ratios(parts, known))
    scratch.drop("words", "steps")
    bits = slot_bits(chunks)
    # Written before it meets the chunks, so the words' shuffle and the next one are not on disk together.
    wanted = scratch.write("found", answered(word_lists(chunks, bits), ratios, bits))
    scratch.drop("expressions")
    # The expressions themselves go before the last shuffle.
    slim = scratch.write("texts", chunks.select("chunk", "doc_id", "sizes", "at", "n"), **CHUNKS)
    scratch.drop("chunks")
    name = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        sizes, at, n = (np.array(chunk.column(c)[0].as_py(), np.int64) for c in ("sizes", "at", "n"))
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(text, weights=in_order(found)[at] * n, minlength=len(sizes))
        total = np.bincount(text, weights=n, minlength=len(sizes))
        return pa.table({"doc_id": pa.array(chunk.column("doc_id")[0].as_py(), id_type), "ratio": sums / np.maximum(total, 1)})

    return slim.groupBy("chunk").cogroup(wanted.groupBy("of")).applyInArrow(run, f"doc_id {name}, ratio double")


def calibrate(ratio: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve (Newton steps, slight ridge); the prior if a class is missing."""
    share = (label.sum() + 0.5) / (len(label) + 1.0)
    if not 0 < label.sum() < len(label):
        return 0.0, float(np.log(share / (1 - share)))
    mean, scale = ratio.mean(), ratio.std() or 1.0
    design = np.column_stack([(ratio - mean) / scale, np.ones(len(ratio))])
    weights = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -500, 500)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        weights += np.clip(np.linalg.solve(hessian, design.T @ (label - p) - 1e-3 * weights), -4, 4)
    return float(weights[0] / scale), float(weights[1] - weights[0] * mean / scale)


def fold(id_col: Column) -> Column:
    return (F.crc32(id_col.cast("string").cast("binary")) % 5).cast("int")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float]:
    """``(doc_id, ratio)`` of every row, and slope and bias of its score, learnt from the labelled rows
    of ``docs`` whose crc32(doc_id) mod 5 is not 0.

    Folds 1-3 give the class counts, fold 4 the calibration; all texts give the shared counts, without
    their labels. At most LABELLED_ROWS labels are used, so they can be looked up where the texts are
    read, and no text is shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)
    rows = known.toArrow()
    learn = {r["doc_id"]: r["toxic"] for r in rows.to_pylist() if r["fold"] != 4}
    scored = Scratch(docs.sparkSession).write("ratios", mean_ratios(docs, learn))
    check = docs.sparkSession.createDataFrame(rows, known.schema).where("fold = 4").select("doc_id", "toxic")
    pairs = scored.join(check, "doc_id").select("ratio", "toxic").toArrow().to_pylist()
    slope, bias = calibrate(np.array([r["ratio"] for r in pairs], float), np.array([r["toxic"] for r in pairs], float))
    return scored, slope, bias


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``score`` is a calibrated probability of label 1 from the text alone; empty and null texts get the
    score of ratio 0. Labels that are null or not 0/1 are ignored, of repeated labels the larger
    counts. Rows with a null id are scored and never held out or learnt from. Without labels of both
    classes the score is the class prior for every text.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, slope, bias = fit(source, labels)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(slope) * F.col("ratio") + F.lit(bias)))))
    return out.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )
