"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import text_batches

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens on each side of a marked token that a window holds.
CONTEXT = 3
#: Windows decoded at once.
WINDOWS = 2048

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@\[]")
TOKEN = re.compile(r"\S+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Checksum of a card number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of the four patterns without overlap within a kind, less those that fail the
    kind's test; ordered by start, then kind. The patterns are stated so that a long run of any
    character takes linear time."""
    found: list[tuple[int, int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        # The name starts where its run of characters does, or where the last match ended.
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# ---- word shapes


@functools.lru_cache(1 << 16)
def shape(token: str) -> tuple[str, ...]:
    """Features of one token, none of which is the word itself (but for the few marker words)."""
    core = token.strip(".,;:!?\"'")
    runs: list[str] = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", core, re.DOTALL):
        part = m[0]
        runs.append(f"d{min(len(part), 20)}" if part[0].isdigit() and part.isascii() else "x" if part[0].isalpha() else part)
    form = "".join(runs[:24])
    digits = digits_of(core)
    feats = [f"s={form}", f"n={min(len(digits), 20)}", f"c={''.join(dict.fromkeys(r[0] for r in runs))[:8]}"]
    if token != core:
        feats.append("edge")
    if 12 <= len(digits) <= 19 and luhn(digits):
        feats.append("sum")
    if (parts := core.split("."))[3:] and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        feats.append("bytes")
    if core.lower() in MARKERS:
        feats.append(f"w={core.lower()}")
    return tuple(feats)


#: Words and signs that stand near or inside personal data. Fixed values of this operator.
MARKERS = frozenset("[at] (at) [dot] (dot) tel tel. phone fax call mobile card account ip host email mail".split())


def window_features(tokens: Sequence[str]) -> list[list[str]]:
    shapes = [shape(t) for t in tokens]
    out = []
    for i, own in enumerate(shapes):
        before = shapes[i - 1] if i else ("^",)
        after = shapes[i + 1] if i + 1 < len(shapes) else ("$",)
        out.append(["bias", *own, *(f"<{x}" for x in before), *(f">{x}" for x in after)])
    return out


# ---- the labelled table


def labelled_table(rows: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, made by rule: sentences with personal data in spellings that the
    patterns know and that they do not, and with numbers that are nobody's."""
    rng = random.Random(seed)
    plain = lambda: ["".join(rng.choice("aeinorstlhd") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 4))]
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: rng.choice(("ana", "bo.li", "kim", "sam_k", "lee", "max.m"))

    def card(sep: str) -> str:
        body = rng.choice("45") + num(14)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def odd_number() -> str:
        while luhn(x := num(16)):
            pass
        return x

    byte = lambda: str(rng.randint(0, 255))
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    makers = [
        ("email", lambda: f"{name()}@{name().replace('_', '')}.{rng.choice(('org', 'net', 'com'))}"),
        ("email", lambda: f"{name()}{num(2)}@mail{num(1)}.example.com"),
        ("email", lambda: f"{name()} [at] mail{num(1)} [dot] com"),
        ("email", lambda: f"{name()} [at] mail{num(1)}.example.com"),
        ("ip", lambda: ".".join(byte() for _ in range(4))),
        ("card", lambda: card("")),
        ("card", lambda: card(" ")),
        ("card", lambda: card("-")),
        ("phone", lambda: f"+1 ({num(3)}) 555-{num(4)}"),
        ("phone", lambda: f"({num(3)}) 555-{num(4)}"),
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        ("phone", lambda: f"+{num(2)} {num(3)} {num(3)} {num(4)}"),
        ("O", odd_number),
        ("O", odd_number),
        ("O", lambda: f'"{hexa()}"'),
        ("O", lambda: f'= "{hexa()}"'),
        ("O", lambda: rng.choice(("Version 2.0.", "version 3.", "BY-NC 4.0.", "v1.2.3", "10.5.2"))),
        ("O", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/20{num(2)}"),
        ("O", lambda: f"20{num(2)}-0{rng.randint(1, 9)}-{num(2)}"),
        ("O", lambda: rng.choice((num(1), num(2), num(4), f"{num(2)}:{num(2)}", f"{num(1)},{num(3)}", f"{num(2)}%"))),
        ("O", lambda: f"[{num(2)}]"),
        ("O", lambda: f"{rng.randint(256, 999)}.{byte()}.{rng.randint(256, 999)}.{byte()}"),
        ("O", lambda: f"({num(3)}) {num(2)}"),
        ("O", lambda: f"({num(4)})"),
        ("O", lambda: f"@{name()}"),
        ("O", lambda: ""),
    ]
    out = []
    for i in range(rows):
        kind, make = makers[i % len(makers)]
        value = make().split()
        if value and rng.random() < 0.2:
            value[-1] += rng.choice(".,")
        labels = ["O"] * len(value) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(value) - 1)]
        before, after = plain(), plain()
        out.append((before + value + after, ["O"] * len(before) + labels + ["O"] * len(after)))
    return out


# ---- the field


class Field:
    """Weights of the token features (features x labels) and of the steps between labels."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray) -> None:
        self.names, self.emit, self.step = names, emit, step

    def scores(self, windows: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (window, place, label), zero past the end, and the windows' lengths."""
        lengths = np.array([len(w) for w in windows])
        out = np.zeros((len(windows), int(lengths.max(initial=0)), len(LABELS)))
        rows, where = [], []
        for i, window in enumerate(windows):
            for j, feats in enumerate(window_features(window)):
                ids = [self.names[f] for f in feats if f in self.names]
                rows += ids
                where += [i * out.shape[1] + j] * len(ids)
        flat = out.reshape(-1, len(LABELS))
        np.add.at(flat, where, self.emit[rows])
        return out, lengths

    def decode(self, windows: Sequence[Sequence[str]]) -> list[list[int]]:
        """Best labels of each window: Viterbi over all windows at once."""
        emit, lengths = self.scores(windows)
        if not emit.size:
            return [[] for _ in windows]
        best = emit[:, 0].copy()
        back = np.zeros(emit.shape, np.int8)
        for t in range(1, emit.shape[1]):
            reach = best[:, :, None] + self.step[None]
            back[:, t] = reach.argmax(axis=1)
            grown = reach.max(axis=1) + emit[:, t]
            best = np.where((t < lengths)[:, None], grown, best)
        last = best.argmax(axis=1)
        paths = np.zeros(emit.shape[:2], np.int8)
        for t in range(emit.shape[1] - 1, -1, -1):
            paths[:, t] = last
            inside = (t < lengths) & (t > 0)
            last = np.where(inside, back[np.arange(len(last)), t, last], last)
        return [paths[i, :n].tolist() for i, n in enumerate(lengths.tolist())]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@functools.lru_cache(1)
def _default_field() -> Field:
    return train(labelled_table())


def train(table: Sequence[tuple[list[str], list[str]]], rounds: int = 120, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge: forward and backward passes over all sentences at once, Adam
    steps. An inside label without a begin of its kind before it is ruled out."""
    names: dict[str, int] = {}
    for sentence, _ in table:
        for feats in window_features(sentence):
            for f in feats:
                names.setdefault(f, len(names))
    size, count = len(LABELS), len(table)
    lengths = np.array([len(s) for s, _ in table])
    longest = int(lengths.max())
    rows, where = [], []
    gold = np.full((count, longest), -1)
    for i, (sentence, labels) in enumerate(table):
        gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
        for j, feats in enumerate(window_features(sentence)):
            rows += [names[f] for f in feats]
            where += [i * longest + j] * len(feats)
    rows, where = np.array(rows), np.array(where)
    banned = np.zeros((size, size))
    for a, x in enumerate(LABELS):
        for b, y in enumerate(LABELS):
            if y[0] == "I" and x[1:] != y[1:]:
                banned[a, b] = -1e4
    start = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
    weights = np.zeros((len(names) + size, size))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    live = np.arange(longest)[None, :] < lengths[:, None]
    at = np.nonzero(live)
    truth = np.zeros((count * longest, size))
    truth[at[0] * longest + at[1], gold[at]] = 1
    pairs = live[:, 1:]
    steps = np.zeros((size, size))
    np.add.at(steps, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    for t in range(1, rounds + 1):
        emit = np.zeros((count * longest, size))
        np.add.at(emit, where, weights[rows])
        emit = emit.reshape(count, longest, size)
        step = weights[len(names) :] + banned
        forward = np.zeros_like(emit)
        backward = np.zeros_like(emit)
        forward[:, 0] = emit[:, 0] + start
        for k in range(1, longest):
            grown = _log_sum(forward[:, k - 1][:, :, None] + step, 1) + emit[:, k]
            forward[:, k] = np.where(live[:, k][:, None], grown, forward[:, k - 1])
        norm = _log_sum(forward[:, -1], 1)
        for k in range(longest - 2, -1, -1):
            grown = _log_sum(step[None] + (emit[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(live[:, k + 1][:, None], grown, 0.0)
        belief = np.exp(forward + backward - norm[:, None, None]) * live[:, :, None]
        both = forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        gradient = np.zeros_like(weights)
        np.add.at(gradient, rows, (truth - belief.reshape(-1, size))[where])
        gradient[len(names) :] = steps - expected
        gradient = gradient / count - ridge * weights / len(LABELS)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights += 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Field(names, weights[: len(names)], weights[len(names) :] + banned)


def windows_of(text: str) -> list[tuple[list[str], list[int]]]:
    """Tokens and their starts around each marked token (one with a digit, '@' or '['), by line.

    All other tokens have the shape of a plain word. Away from marked tokens their features are the
    same everywhere, and the field labels them as outside; ``test_plain_words_are_outside`` holds it
    to that. So these windows are all that needs decoding.
    """
    out = []
    begin = 0
    m = MARK.search(text)
    while m:
        begin = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        tokens = list(TOKEN.finditer(text, begin, end))
        marked = [i for i, t in enumerate(tokens) if MARK.search(t[0])]
        low = high = -1
        for i in marked:
            if low >= 0 and i - CONTEXT > high:
                out.append(([t[0] for t in tokens[low:high]], [t.start() for t in tokens[low:high]]))
                low = -1
            if low < 0:
                low = max(0, i - CONTEXT)
            high = min(len(tokens), i + CONTEXT + 1)
        if low >= 0:
            out.append(([t[0] for t in tokens[low:high]], [t.start() for t in tokens[low:high]]))
        m = MARK.search(text, end)
    return out


def found_spans(tokens: Sequence[str], starts: Sequence[int], labels: Sequence[int]) -> list[Span]:
    """Spans of a decoded window, without punctuation at their ends."""
    out: list[Span] = []
    for token, start, label in zip(tokens, starts, labels, strict=True):
        name = LABELS[label]
        if name[0] == "B":
            out.append((start, start + len(token), name[2:]))
        elif name[0] == "I" and out:
            out[-1] = (out[-1][0], start + len(token), out[-1][2])
    cut = []
    whole = dict(zip(starts, tokens, strict=True))
    for s, e, k in out:
        first = whole[s]
        last_start = max(x for x in starts if x < e)
        last = whole[last_start].rstrip(".,;:!?\"'")
        s += len(first) - len(first.lstrip(".,;:!?\"'"))
        e = last_start + len(last)
        if s < e:
            cut.append((s, e, k))
    return cut


def add_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans and those others that overlap none of them, by start, then kind."""
    new = [x for x in more if not any(x[0] < e and s < x[1] for s, e, _ in base)]
    return sorted(base + new, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def personal_data(docs: DataFrame, field: Field | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    The counts and the hash are of the pattern spans, ``spans`` has those and the spans the field adds
    (``kind:start:end`` in code points, end exclusive). Null texts are empty: no spans. Rows are
    independent and none is dropped; repeated rows are repeated. The field is trained on
    ``labelled_table`` unless one is given, and goes to the tasks as a broadcast of a few thousand
    weights. Whole texts are read; nothing is shuffled.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(field or _default_field())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more: list[list[Span]] = [[] for _ in texts]
            todo = [(i, *w) for i, t in enumerate(texts) for w in windows_of(t)]
            todo.sort(key=lambda w: len(w[1]))
            for k in range(0, len(todo), WINDOWS):
                part = todo[k : k + WINDOWS]
                for (i, tokens, starts), labels in zip(part, model.decode([w[1] for w in part]), strict=True):
                    if any(labels):
                        more[i] += found_spans(tokens, starts, labels)
            counts = [[sum(1 for x in spans if x[2] == kind_) for spans in base] for kind_ in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]),
                    pa.array([written(add_spans(x, y)) for x, y in zip(base, more, strict=True)]),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
