"""The compression classifier, the conversation trie and hard-negative mining, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import negatives as N
from newsloom.llm import quality as Q
from newsloom.llm import trie as T
from newsloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"

# -- quality ---------------------------------------------------------------------------------------

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def held(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled_texts(n: int) -> tuple[list, list]:
    rng = random.Random(3)
    good, bad = "river stone window garden letter morning".split(), "WIN!!! $$$ click&&& free*** now### buy%%%".split()
    docs, labels = [], []
    for k in range(n):
        words = bad if k % 4 == 0 else good
        docs.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 200)))))
        labels.append((k, int(k % 4 != 0)))
    return docs, labels


def test_quality_of_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = QUERIES["op11_compression"](spark, "/root/testdata/sf0.1").join(labels.select("doc_id", "quality"), "doc_id").collect()
    fold = [r for r in rows if r.held_out]
    assert {r.doc_id for r in fold} == {r.doc_id for r in rows if held(r.doc_id)}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    right = sum(r.predicted == r.quality for r in fold) / len(fold)
    good = [r for r in fold if r.quality == 1]
    assert right >= 0.98 and sum(r.predicted for r in good) / len(good) >= 0.99
    # Calibrated: scores are likelihoods.
    assert abs(sum(r.score for r in fold) / len(fold) - len(good) / len(fold)) < 0.02
    assert documents.count() == QUERIES["op11_compression"](spark, "/root/testdata/sf0.1").count()


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled_texts(240)
    turned = [(i, 1 - q if held(i) else q) for i, q in labels]
    a = Q.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    b = Q.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(turned, LABELS))
    assert a == b and a.dictionaries is not None


def test_quality_of_odd_rows(spark):
    docs, labels = labelled_texts(240)
    odd = [(None, "free*** now###"), (9000, None), (9001, ""), (9002, "garden " * 40_000), (9003, "buy%%% WIN!!! " * 40_000), (0, "river stone")]
    table = spark.createDataFrame(docs + odd, DOCS).withColumn("score", F.lit("x")).withColumn("label", F.lit(7)).withColumn("raw", F.lit(None))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 9), (7, 0), (7, 1)], LABELS).withColumn("text", F.lit("t"))
    rows = Q.quality(table, marks).collect()
    assert len(rows) == 246
    by = {r.doc_id: r for r in rows}
    assert not by[None].held_out and by[9000].score == by[9001].score and by[9000].raw == 0
    assert by[9002].predicted == 1 and by[9003].predicted == 0 and by[9003].raw == 14 * 40_000
    assert sum(r.doc_id == 0 for r in rows) == 2
    # A score does not depend on the rows beside it.
    alone = Q.quality(table.where("doc_id = 9002 OR doc_id < 240"), marks).where("doc_id = 9002").first()
    assert alone.raw == by[9002].raw


def test_quality_without_labels(spark):
    docs, labels = labelled_texts(40)
    table = spark.createDataFrame(docs, DOCS)
    assert {r.score for r in Q.quality(table, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    only = [x for x in labels if x[1] == 1]
    scores = {r.score for r in Q.quality(table, spark.createDataFrame(only, LABELS)).collect()}
    assert len(scores) == 1 and 0.9 < scores.pop() < 1
    assert Q.quality(table.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_sizes_are_those_of_all_pieces():
    model = Q.Model((b"bad words here " * 30, b"good words there " * 30))
    bad, good = model.compressors()
    text = "good words there é" * 500
    cut = Q.pieces(text)
    assert b"".join(cut) == text.encode() and max(map(len, cut)) == Q.PIECE
    assert Q.sizes(text, [bad, good]) == (len(text.encode()), sum(len(bad.compress(p)) for p in cut), sum(len(good.compress(p)) for p in cut))


# -- trie ------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, period=None):
    """Nodes of the trie, one by one."""
    turns: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    if period is not None:
        share = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        built = {c: own.get(c - int(math.fmod(c, period)), [])[: share[c]] + own[c][share[c] :] for c in own}
    else:
        built = own
    nodes: dict[tuple, list] = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    kids: dict[tuple, int] = {}
    for key in nodes:
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(members) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), kids.get(key, 0), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def share():
    return F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 6


def random_turns(rng, convs, most=7, words="abc"):
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([*words, "", None])))
    return rows


@pytest.mark.parametrize("period", [None, 100])
def test_trie_against_brute_force(spark, period):
    rng = random.Random(11)
    rows = random_turns(rng, [*range(0, 260), *range(905, 990), -3, -120])
    rows += [(None, 1, "user", "x"), (7, None, "user", "first"), (7, 3, "user", "a"), (7, 3, "user", "a")]
    rows = [r for r in dict.fromkeys(rows)] + [(8, 50, "user", "z"), (8, 50, "user", "z")]
    table = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("n", F.lit(None)).repartition(5)
    found = T.prefix_trie(table, period=period or 100, shares=share() if period else None)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_trie(rows, period)


def test_trie_of_long_chains_and_copies(spark):
    """A conversation of a quarter of the rows, a nested family of prefixes, and copies."""
    rows = [(1, t, "user", f"turn {t % 7}") for t in range(900)]
    rows += [(c, t, "user", f"turn {t % 7}") for c in range(2, 42) for t in range(c)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 800) for t in range(3)]
    found = T.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_trie(rows)


def test_empty_trie(spark):
    assert T.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS), shares=share()).count() == 0
    one = T.prefix_trie(spark.createDataFrame([(3, None, None, None)], TURNS)).collect()
    assert sorted(map(tuple, one), key=repr) == brute_trie([(3, None, None, None)])


def test_parentheses():
    rng = random.Random(5)
    for n in (1, 2, 60, 700, 5000):
        bits, depth = [], 0
        for k in range(2 * n):
            left = 2 * n - k
            up = depth == 0 or (depth < left and rng.random() < (0.9 if (k // 50) % 2 else 0.45))
            bits.append(int(up))
            depth += 1 if up else -1
        bits = np.array(bits, np.int8)
        stack, close = [], {}
        for k, b in enumerate(bits):
            if b:
                stack.append(k)
            else:
                close[stack.pop()] = k
        opens = np.flatnonzero(bits)
        assert T.Parentheses(bits).find_close(opens).tolist() == [close[k] for k in opens.tolist()]


def test_shards_add_up_at_their_spines():
    """However sorted paths are cut into shards, the classes add up to those of one shard."""
    rng = random.Random(2)
    built = {c: [rng.choice("ab") for _ in range(rng.randrange(0, 6))] for c in range(60)}
    members: dict[tuple, list] = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    number = {key: k for k, key in enumerate(sorted(members))}
    sequences: dict[tuple, list] = {}
    for c, t in built.items():
        sequences.setdefault(tuple(t), []).append(c)

    def solve(keys):
        elements = [tuple(key[:d]) for key in keys for d in range(len(key) + 1)]
        columns = {
            "ka": np.array([number[e] for e in elements]), "kb": np.zeros(len(elements), np.int64),
            "n": np.array([len(members[e]) for e in elements]), "m": np.array([min(members[e]) for e in elements]),
            "a": np.array([len(e) for e in elements]), "b": np.array([len(e) for e in elements]),
            "cum_a": np.array([max(0, len(e) - 1) for e in elements]), "cum_b": np.array([len(e) for e in elements]),
        }
        offsets = np.cumsum([0, *(len(k) + 1 for k in keys)])
        out = T.shard_classes(offsets, columns, np.array([min(sequences[k]) for k in keys]), np.array([len(sequences[k]) for k in keys]))
        rows: dict[tuple, list] = {}
        for k in range(len(out["m"])):
            rows.setdefault((out["m"][k], out["a"][k]), []).append((out["leaves"][k], out["below"][k], out["kids"][k], out["spine"][k]))
        return rows

    order = sorted(sequences, key=lambda k: [number[tuple(k[:d])] for d in range(len(k) + 1)])
    whole = {k: v[0][:3] for k, v in solve(order).items()}
    for size in (1, 2, 7, 25):
        added: dict[tuple, list] = {}
        for k in range(0, len(order), size):
            for key, rows in solve(order[k : k + size]).items():
                assert len(rows) == 1
                added.setdefault(key, []).append(rows[0])
        for key, rows in added.items():
            assert len(rows) == 1 or all(r[3] for r in rows)
            assert tuple(map(sum, zip(*(r[:3] for r in rows), strict=True))) == whole[key]


# -- hard negatives --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, every=5, positives=5, many=3):
    held = set()
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in held:
        if a[0] % every:
            continue
        scored = sorted((-sum(map(int.__mul__, a[2], b[2])), b[0], b[1]) for b in held if b != a and len(b[2]) == len(a[2]))
        for score, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            found = [x for x in scored if x[2] != a[1] and 50 * -score <= 100 * -x[0] <= 95 * -score][:many]
            out += [(a[0], p, k, x[1], -score, -x[0]) for k, x in enumerate(found, 1)]
    return sorted(out)


def clustered(rng, n, size, centres=12, labels=4):
    heart = rng.normal(size=(centres, size))
    v = heart[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, size))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, v[i].astype(np.float32).tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("shard", [64, 4096])
def test_negatives_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(N, "SHARD", shard)
    rng = np.random.default_rng(1)
    rows = clustered(rng, 700, 6)
    # Copies of one vector (anchors too), ties, rows that share an id, other lengths, and rows that take no part.
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(60)] + [(2100 + k, rows[5][1], 9) for k in range(20)]
    rows += [(10, rows[3][1], rows[3][2]), (10, rows[10][1], rows[10][2]), (15, rows[3][1], rows[15][2]), (3000, [0.0] * 6, 1), (3005, [0.0] * 6, 2)]
    rows += [(4000 + k, rng.normal(size=3).tolist(), k % 2) for k in range(30)]
    rows += [(5000, None, 1), (5005, [float("nan")] * 6, 1), (5010, [float("inf")] * 6, 1), (5015, rows[0][1], None), (None, rows[0][1], 1), (5020, [], 1), (5025, [None] * 6, 1)]
    table = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("cell", F.lit(1)).repartition(6)
    found = N.hard_negatives(table, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)


def test_no_vectors(spark):
    assert N.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
    assert N.hard_negatives(spark.createDataFrame([(5, [1.0], 1), (6, [1e30], 1)], VECTORS), F.col("vec_id") % 5 == 0).count() == 0


def test_ranges_never_pass_over_a_row():
    """Each subtree's bounds hold for all its rows, and the search equals sorting all rows, in either direction."""
    rng = np.random.default_rng(4)
    v = np.floor(256 * np.array([r[1] for r in clustered(rng, 4000, 8, centres=40)])).astype(np.int64)
    v = np.concatenate([v, v[:300], np.zeros((5, 8), np.int64)])
    v[::7] *= 2
    labels, ids = rng.integers(0, 5, len(v)), rng.permutation(len(v))
    norm = int((v * v).sum(axis=1).max())
    tree = N.Tree(v, norm, ids, labels, ids)
    scored = []
    plain = tree._score
    tree._score = lambda rows, active: (scored.append(len(rows) * len(active)), plain(rows, active))
    q, mine = v[::97], labels[::97]
    top = np.sort(N.products(q, v), axis=1)[:, -6]
    low, high = top // 2, top * 19 // 20
    score, rows = tree.search(q, mine, low, high, np.full(len(q), N.LOWEST), False, 3)
    for k in range(len(q)):
        s = v @ q[k]
        fits = np.flatnonzero((labels != mine[k]) & (s >= low[k]) & (s <= high[k]))
        want = sorted((-s[x], ids[x]) for x in fits)[:3]
        got = [(-score[k, j], tree.ids[rows[k, j]]) for j in range(3) if score[k, j] > N.LOWEST]
        assert got == want
    # The ranges do save work on rows that have a structure.
    assert sum(scored) < 0.9 * len(q) * len(v)


def test_products_of_large_components_are_exact():
    big = np.array([[(1 << 22) - 1] * 600, [-(1 << 22) + 3] * 600], np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]
    assert N.products(big, big).tolist() == want
