"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import text_batches

#: Characters of distinct units that one suffix array indexes.
INDEX_CHARS = 1 << 19
#: Units longer than this are merged with a heap instead of in vector rounds.
LONG = 64
#: Bytes of encoded units that a Python worker remembers, over all its tasks.
KNOWN_BYTES = 96 << 20
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A SentencePiece BPE model with an identity normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kinds = {p.type for p in proto.pieces}
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave the text as it is")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models that fall back to bytes")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        self.ids = {piece: i for piece, i, _ in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        #: What each id stands for: text as bytes, nothing for control pieces.
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b" \xe2\x81\x87 " if p.type == UNKNOWN else b""
            for p in proto.pieces
        ]
        #: A cut before a blank is safe if no piece has a blank after anything else.
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.longest = max(len(piece) for piece in self.ids)
        # Pieces for the index, sorted; the order of merges: better scores first, equal ones together.
        order = sorted(normal)
        self.names = [piece for piece, _, _ in order]
        self.codes = np.zeros((len(order), self.longest), np.uint32)
        for row, piece in enumerate(self.names):
            self.codes[row, : len(piece)] = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        self.lengths = np.array([len(x) for x in self.names])
        self.piece_ids = np.array([i for _, i, _ in order], np.int32)
        self.ranks = np.unique(-np.array([s for _, _, s in order]), return_inverse=True)[1].astype(np.int32)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)

    def units(self, text: str) -> list[str]:
        """Parts of the normalised text that no merge crosses; they add up to it."""
        if not text:
            return []
        whole = self.prefix + text.replace(" ", SPACE)
        return self.unit.findall(whole) if self.cuts else [whole]

    def spell(self, char: str) -> list[int]:
        """Ids of one character that isn't part of a merge."""
        own = self.ids.get(char)
        return [own] if own is not None else [self.bytes[b] for b in char.encode()]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as int32 bytes: match every piece in a suffix array of all units at once,
        lay the edges out by position, and relax them."""
        text = "\0".join(units) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = edge_table(codes, self)
        lengths = np.array([len(u) for u in units])
        starts = np.cumsum(lengths + 1) - lengths - 1
        out: list[bytes] = [b""] * len(units)
        short = np.flatnonzero(lengths <= LONG)
        if len(short):
            at, size, owner = relax(edges, self.ranks, starts[short], lengths[short])
            self._name(text, edges, at, size, short[owner], out)
        for k in np.flatnonzero(lengths > LONG).tolist():
            at, size = relax_long(edges, self.ranks, int(starts[k]), int(lengths[k]))
            self._name(text, edges, at, size, np.full(len(at), k), out)
        return out

    def _name(self, text: str, edges: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, out: list[bytes]) -> None:
        rows = edges[at, size - 1]
        ids = np.where(rows >= 0, self.piece_ids[rows], -1)
        plain = np.flatnonzero(ids < 0)
        if len(plain):
            spelt = [self.spell(text[at[k]]) for k in plain.tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[plain] = [len(s) for s in spelt]
            full = np.repeat(ids, counts)
            ends = np.cumsum(counts)
            for k, s in zip(plain.tolist(), spelt, strict=True):
                full[ends[k] - len(s) : ends[k]] = s
            owner, ids = np.repeat(owner, counts), full
        data = ids.astype("<i4").tobytes()
        edge = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(ids)]]).tolist(), strict=True):
            out[owner[a]] = data[4 * a : 4 * b]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that aren't UTF-8 become replacement characters."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.prefix else text


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` characters at least, by doubling of ranks. The first
    ranks are of as many characters as fit 62 bits once the text's own characters are numbered."""
    seen = np.flatnonzero(np.bincount(codes))
    number = np.zeros(int(seen[-1]) + 1, np.int64)
    number[seen] = np.arange(1, len(seen) + 1)
    letters = number[codes]
    bits = int(len(seen)).bit_length()
    width = max(1, min(depth, 62 // bits))
    key = np.zeros(len(codes), np.int64)
    for k in range(width):
        key <<= bits
        key[: len(codes) - k] |= letters[k:]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty_like(key)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        key = rank * (len(codes) + 1)
        key[:-width] += rank[width:] + 1
        width *= 2


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the suffix array in which each piece occurs: one binary search a character, of all
    pieces at once."""
    low = np.zeros(len(pieces), np.int64)
    high = np.full(len(pieces), len(order), np.int64)
    last = len(codes) - 1
    for depth in range(pieces.shape[1]):
        live = np.flatnonzero((lengths > depth) & (low < high))
        if not len(live):
            break
        want = pieces[live, depth]
        for upper in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                got = codes[np.minimum(order[np.minimum(mid, last)] + depth, last)]
                right = (got <= want) if upper else (got < want)
                a = np.where(open_ & right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if upper:
                high[live] = a
            else:
                first = a
        low[live] = first
    return low, high


def edge_table(codes: np.ndarray, model: Pieces) -> np.ndarray:
    """Row of the piece that starts at each position with each length, -1 if there is none: the
    occurrences of all pieces, in order of position."""
    order = suffix_array(codes, model.longest)
    low, high = occurrences(codes, order, model.codes, model.lengths)
    counts = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = order[np.repeat(low, counts) + within]
    table = np.full((len(codes), model.longest), -1, np.int32)
    table[start, model.lengths[row] - 1] = row
    return table


def relax(edges: np.ndarray, ranks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the symbols of all units in rounds: in each, every unit merges the neighbours whose joint
    piece has the best score, the leftmost of equals. Returns starts, sizes and owners of the symbols."""
    longest = edges.shape[1]
    owner = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    size = np.ones(len(at), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    worst = np.int64(1) << 60
    # The key of a pair is its rank, then its place among the symbols of the round.
    ranked = np.append(ranks.astype(np.int64), worst >> 32)
    while len(at):
        joint = np.full(len(at), worst)
        size_two = size[:-1] + size[1:]
        fits = np.flatnonzero((owner[1:] == owner[:-1]) & (size_two <= longest))
        rows = edges[at[fits], size_two[fits] - 1]
        good = rows >= 0
        joint[fits[good]] = (ranked[rows[good]] << 32) + fits[good]
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        best = np.minimum.reduceat(joint, first)
        live = best < worst
        counts = np.diff(np.append(first, len(at)))
        if not live.all():
            rest = np.repeat(~live, counts)
            done.append((at[rest], size[rest], owner[rest]))
        left = best[live] & 0xFFFFFFFF
        size[left] += size[left + 1]
        keep = np.repeat(live, counts)
        keep[left + 1] = False
        at, size, owner = at[keep], size[keep], owner[keep]
    at, size, owner = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (at, size, owner)
    order = np.argsort(at, kind="stable")
    return at[order], size[order], owner[order]


def relax_long(edges: np.ndarray, ranks: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same merges for one long unit, with a heap of pairs."""
    longest = edges.shape[1]
    table = edges[start : start + length]
    size = [1] * length
    before = list(range(-1, length - 1))
    after = [*range(1, length), -1]
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if left >= 0 and right >= 0 and (both := size[left] + size[right]) <= longest:
            row = table[left, both - 1]
            if row >= 0:
                heapq.heappush(heap, (int(ranks[row]), left, both))

    for k in range(length - 1):
        offer(k)
    while heap:
        _, left, both = heapq.heappop(heap)
        right = after[left]
        if not size[left] or right < 0 or size[left] + size[right] != both:
            continue
        size[left], size[right] = both, 0
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    kept = [k for k in range(length) if size[k]]
    return np.array(kept) + start, np.array([size[k] for k in kept])


class Encoder:
    """Encodes batches of texts, indexing each distinct unit once while it is remembered."""

    def __init__(self, model: Pieces) -> None:
        self.model, self.known, self.held = model, {}, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes; empty for null and empty texts."""
        if self.held > KNOWN_BYTES:
            self.known, self.held = {}, 0
        out = []
        for group in self._groups(texts):
            known = self.known
            new = list(dict.fromkeys(u for units in group for u in units if u not in known))
            part: list[str] = []
            size = 0
            for unit in [*new, None]:
                if part and (unit is None or size + len(unit) >= INDEX_CHARS):
                    for name, ids in zip(part, self.model.encode_units(part), strict=True):
                        known[name] = ids
                        self.held += 120 + 2 * len(name) + len(ids)
                    part, size = [], 0
                if unit is not None:
                    part.append(unit)
                    size += len(unit) + 1
            out += [b"".join(map(known.__getitem__, units)) for units in group]
        return out

    def _groups(self, texts: list[str | None]) -> Iterator[list[list[str]]]:
        group, size = [], 0
        for text in texts:
            group.append(self.model.units(text or ""))
            size += len(text or "")
            if size > 4 * INDEX_CHARS:
                yield group
                group, size = [], 0
        if group:
            yield group


@functools.lru_cache(maxsize=1)
def worker_encoder(model_path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(Pieces(model_path))


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``piece_ids array<int>``, ``n_pieces`` and ``decoded_equal``: whether
    decoding the ids gives the text back.

    Ids are those of the SentencePiece library for the model file, which every executor has, without
    begin and end marks. The method's last step, relaxing edges, is done in the order of BPE merges:
    a best path by total score is right for unigram models, not for BPE ones. Null and empty texts
    have no ids and decode to empty text. Rows are never dropped; repeated rows are repeated. Nothing
    is shuffled. A text is encoded in units that no merge crosses, so its length does not matter.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model_path)
        decode = encoder.model.decode
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            coded = [np.frombuffer(x, "<i4") for x in encoder.encode(texts)]
            counts = np.array([len(c) for c in coded], np.int64)
            flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
            same = [decode(c.tolist()) == (t or "") for c, t in zip(coded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], ids, pa.array(counts), pa.array(same)], names=[*keep, "piece_ids", "n_pieces", "decoded_equal"]
            )

    return rows.mapInArrow(run, f"{kinds}, piece_ids array<int>, n_pieces long, decoded_equal boolean")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")
