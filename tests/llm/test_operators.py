"""The corpus operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

ID_TEXT = "doc_id long, text string"
ODD = [None, "", " ", "\n\n", "!!! ???", "a", "A b", "x" * 5000, "é̀ ü ñ 漢字 🙂", "tab\tand\nline", "<|endoftext|> x <|endoftext|>", "\xa0 \xa0  x\x1c y"]


def frame(spark, rows, schema=ID_TEXT):
    return spark.createDataFrame(rows, schema)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def odd_docs():
    rng = random.Random(3)
    texts = [*ODD, *(sentence(rng, rng.randint(1, 80)) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (None, "nobody's text"), (None, None), (5, texts[5]), (20, texts[20]), (900, texts[30])]


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def empty(spark, schema=ID_TEXT):
    return spark.createDataFrame([], schema)


# ---- components


def test_components(spark):
    from newsloom.llm.graph import components

    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(4000, 4050)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(empty(spark, "a long, b long")).count() == 0


def test_joined_components(spark):
    from newsloom.llm.graph import components, joined

    rng = random.Random(2)
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    for n in (20, 60, 150):
        old, new = ([(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(n)] for _ in range(2))
        rows = joined(components(links(old)), links(new)).collect()
        got, every = {r.node: r.component for r in rows}, [p for p in old + new if p[0] != p[1]]
        assert len(rows) == len(got) and got == roots({x for p in every for x in p}, every)
    assert joined(components(links([(1, 2)])), links([])).collect() == components(links([(1, 2)])).collect()


@pytest.mark.parametrize("small", [False, True])
def test_star_repeats_no_node(spark, small):
    """What goes back to the edges of a contraction has no more rows than the edges, and a centre's are spread."""
    from newsloom.llm import graph

    edges = [(2 * i + 1, 2 * i) for i in range(2000)] + [(x, 4000) for x in range(5000, 7000)]
    out = graph._star(spark.createDataFrame(edges, "u long, v long"), small)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == set(edges)


# ---- 1 toxicity


def labelled(n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(rng, 60).split() if i % 50 else []
        if bad:
            for _ in range(3):
                text.insert(rng.randint(0, len(text)), rng.choice(("vileword", "nastyterm", "rudething")))
        docs.append((i, re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], " ".join(text))))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(spark):
    from newsloom.llm.toxicity import toxicity

    docs, labels = labelled()
    schema = "doc_id long, quality int, toxic int"
    # Labels of the held-out rows are turned around: they must not matter.
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels] + [(None, 1, 1), (3, 1, None), (7, 0, 9)]
    rows = toxicity(frame(spark, [*docs, (None, "w"), (9000, None)]), frame(spark, turned, schema)).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == len(docs) + 2
    assert {i for i, r in got.items() if r.held_out} - {9000} == held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [got[i].predicted == t for i, _, t in labels if i in held]
    assert sum(right) / len(right) >= 0.97


def test_toxicity_without_labels(spark):
    from newsloom.llm.toxicity import toxicity

    none = empty(spark, "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity(frame(spark, odd_docs()), none).collect()} <= {0, 1}
    assert toxicity(empty(spark), none).count() == 0


def test_toxicity_reads_every_letter(spark):
    from newsloom.llm.toxicity import toxicity

    # Toxic and other compounds start alike, and differ far behind.
    docs, labels = labelled()
    ends = {"vileword": "grundstueckvileword", "nastyterm": "grundstuecknastyterm", "rudething": "grundstueckrudething"}
    texts = []
    for i, text in docs:
        words = [ends.get(w, w) for w in text.split()]
        texts.append((i, " ".join([*words, "grundstueckverkehr", "grundstuecksteuer", "grundstueckpreise"])))
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r for r in toxicity(frame(spark, texts), frame(spark, labels, "doc_id long, quality int, toxic int")).collect()}
    toxic = [got[i].predicted for i, _, t in labels if i in held and t]
    other = [got[i].predicted for i, _, t in labels if i in held and not t]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(other) <= 0.05 * len(other)


def test_chunks_are_read_one_by_one(spark, monkeypatch):
    """Chunks are rows of megabytes: neither what writes nor what reads them holds all those of a file."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from newsloom.llm import toxicity as T
    from newsloom.llm.common import Scratch

    paths = {}
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: paths.update(self.paths))
    docs = spark.range(0, 2 * T.TEXTS + 1, 1, 1).selectExpr("id AS doc_id", "concat('word ', repeat('x', int(id % 50))) AS text")
    assert T.mean_ratios(docs, {0: 0, 1: 1}).count() == 2 * T.TEXTS + 1
    for name, rows in (("chunks", 3), ("words", 1), ("texts", 3)):
        files = [pq.ParquetFile(p).metadata for p in Path(paths[name].removeprefix("file:")).glob("*.parquet")]
        groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
        assert sum(groups) == rows and max(groups) == 1


def test_grams_do_not_collide():
    from newsloom.llm.toxicity import grams

    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 8))) for _ in range(600_000)]
    prefixes = {w[:k] for w in names for k in range(1, len(w) + 1)} | {w + "\n" for w in names if len(w) < 8}
    prefixes |= {("", w[1:]) for w in names if len(w) == 8}  # the end mark after the last seven letters
    _, _, gram = grams(names)
    assert len(set(gram.tolist())) == len(prefixes) > 1 << 20


# ---- 2 SimHash


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    from newsloom.llm.simhash import hex_print, simhash_groups

    rng = random.Random(4)
    rows = odd_docs()
    for i in range(30):
        words = sentence(rng, 1500).split()
        rows += [(1000 + 3 * i, " ".join(words)), (1001 + 3 * i, " ".join(words + ["end"])), (1002 + 3 * i, " ".join(words[:-1]).upper())]
    got = simhash_groups(frame(spark, rows)).select("doc_id", hex_print().alias("fp"), "component_id").collect()
    prints = [(d, brute_print(t)) for d, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp) for r in got) == sorted((d is None, d or 0, f"{p:016x}") for d, p in prints)
    known = [(d, p) for d, p in prints if d is not None]
    pairs = [(a, b) for a, p in known for b, q in known if a < b and (p ^ q).bit_count() <= 2]
    pairs += [(a, b) for a, p in known for b, q in known if a == b]
    expected = roots({d for d, _ in known}, [(a, b) for a, b in pairs if a != b])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert len(set(expected.values())) < len(expected) - 20
    assert simhash_groups(empty(spark)).count() == 0


def test_bk_tree_and_shards(spark, monkeypatch):
    from newsloom.llm import simhash

    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    values = sorted(values)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.near(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]
    # Buckets of more than a shard's members give the same groups.
    monkeypatch.setattr(simhash, "SHARD", 16)
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long, rep long"), 2)).collect()
    pairs = [(i, j) for i, v in enumerate(values) for j, w in enumerate(values) if i < j and (v ^ w).bit_count() <= 2]
    expected = roots({x for p in pairs for x in p}, pairs)
    assert {r.node: r.component for r in found} == expected


def test_near_copies(spark):
    from newsloom.llm.simhash import near_copies, shingle_hashes

    rng = random.Random(6)
    rows = odd_docs()
    for i in range(25):
        words = sentence(rng, 300, 5000).split()
        rows.append((2000 + 10 * i, " ".join(words)))
        for k in range(1, 4):
            changed = list(words)
            for _ in range(rng.choice((1, 2, 12))):
                changed[rng.randrange(300)] = f"new{rng.random()}"
            rows.append((2000 + 10 * i + k, " ".join(changed)))
    got = {r.doc_id: r.component_id for r in near_copies(frame(spark, rows)).collect()}
    sets: dict = {}
    texts: dict = {}
    for d, t in rows:
        if d is not None:
            sets[d], texts[d] = set(shingle_hashes(t, 5)), t or ""
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and (texts[a] == texts[b] or ((u := sets[a] | sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(u)))
    ]
    assert got == roots(set(sets), pairs)
    assert near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_near_copies_among_false_neighbours(spark, monkeypatch, held):
    from newsloom.llm import simhash

    monkeypatch.setattr(simhash, "MET", held, raising=False)
    rng = random.Random(12)
    base = [f"b{rng.random()}" for _ in range(300)]
    jaccard = lambda x, y: len(x & y) / len(x | y)

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(5, 295), n):
            out[at] = f"new{rng.random()}"
        return out

    # A family whose members are similar at about 0.75, and copies of a few of them at about 0.82.
    texts, sets = [], []
    while len(texts) < 160:
        words = changed(base, 4)
        own = set(simhash.shingle_hashes(" ".join(words), 5))
        if all(jaccard(own, x) < 0.795 for x in sets):
            texts.append(words)
            sets.append(own)
    for i in range(20):
        texts.append(changed(texts[i], 6))
        sets.append(set(simhash.shingle_hashes(" ".join(texts[-1]), 5)))
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard(sets[a], sets[b]) >= 0.8]
    assert len(pairs) >= 20
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == roots(range(len(texts)), pairs)


# ---- 3 WARC


def test_warc(spark):
    from newsloom.llm.warc import archive_table, deduplicated_archive

    big, other = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60, "z" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", other), (10, "u", "y" * 999), (11, "u", "y" * 999)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    full, lean = deduplicated_archive(table)
    got = sorted(map(tuple, archive_table(spark, lean).collect()), key=repr)
    last: dict = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 1000:
            last[h] = max(p, last.get(h, p))
    expected = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = p is not None and h in last and p < last[h]
        expected.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    assert got == sorted(expected, key=repr)
    from newsloom.llm.warc import read_archive

    assert sorted((r.page_id or 0, r.payload) for r in read_archive(spark, full, True).collect()) == sorted((p or 0, h or "") for p, _, h in rows)
    assert archive_table(spark, deduplicated_archive(table.limit(0))[1]).count() == 0


# ---- 4 personal data


def brute_base(text):
    found = []
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def passes(d):
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0

    found += [(m.start(), 0, m.end()) for m in email.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in card.finditer(text) if passes(digits(m))]
    found += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(s, e, ("email", "ip", "card", "phone")[k]) for s, k, e in sorted(found)]


def test_base_spans():
    from newsloom.llm.pii import base_spans

    rng = random.Random(7)
    parts = ["a.b@c.de", "@", "x@y", "..@a.b.c-d.e@f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.004", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "+1 (555) 123-4567", "+12", "+1 2", "++1 23456789", "é", " ", "-", ".", "%", "\n", "7", "12345678901234567890", "word", "+49.30.123456.", "(", ")"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert base_spans(text) == brute_base(text), text


def test_long_runs_are_linear():
    from newsloom.llm.pii import base_spans

    for c in "a1.@+-":
        assert base_spans(c * 200_000) == [] or c == "1"


def test_field_and_rows(spark):
    from newsloom.llm import pii

    field = pii._default_field()
    table = pii.labelled_table(200, seed=77)
    right = [[pii.LABELS[x] for x in path] == labels for path, (_, labels) in zip(field.decode([s for s, _ in table]), table, strict=True)]
    assert sum(right) / len(right) > 0.95
    rows = [(1, "call (555) 123-4567 now"), (2, None), (3, "write to kim [at] mail7 [dot] com"), (4, "plain words only. " * 50), (5, "a.b@c.de and 1.2.3.4\n+1 (555) 123-4567"), (5, "x"), (None, "4111 1111 1111 1111")]
    got = pii.personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (_, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.spans)), sorted(rows, key=lambda x: (x[0] or 0, pii.written(pii.base_spans(x[1] or "")))), strict=True):
        base = brute_base(t or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[2] for x in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1] == "phone:5:19" and spans[3].startswith("email:9:") and spans[4] == ""
    assert pii.personal_data(empty(spark)).count() == 0


def test_plain_words_are_outside():
    """Away from marked tokens the field labels plain words as outside, by more than any step can gain."""
    from newsloom.llm.pii import LABELS, _default_field

    field = _default_field()
    for word in ("word", "word,", "Word."):
        emit, _ = field.scores([["word", word, "word", "word"]])
        own = emit[0, 1:3]
        steps = field.step[field.step > -1e3]
        assert (own[:, 0] - own[:, 1:].max(axis=1) > 2 * (steps.max() - field.step[0, 0])).all()
        assert field.decode([["word", word] * 50]) == [[LABELS.index("O")] * 100]


def test_viterbi_is_best():
    import itertools

    from newsloom.llm.pii import LABELS, _default_field

    field = _default_field()
    windows = [["call", "(555)", "123-4567"], ["1.2.3.4"], ["a@b.c", "+1"]]
    for window, path in zip(windows, field.decode(windows), strict=True):
        emit, _ = field.scores([window])
        value = lambda p: sum(emit[0, i, x] for i, x in enumerate(p)) + sum(field.step[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(itertools.product(range(len(LABELS)), repeat=len(window)), key=value)
        assert math.isclose(value(path), value(best))


# ---- 5 shards


def test_shards(spark):
    from newsloom.llm.shards import shard

    rows = [(i, "é" * (i % 7)) for i in range(3000)] + [(1, "é"), (None, None), (None, "x")]
    got = shard(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by_key = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 8 and by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
    for k in range(8):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots))) and 280 < len(slots) < 470
    assert 230 < sum(r.grown_shard == 8 for r in got) < 450
    assert shard(empty(spark)).count() == 0


def test_weight_moves_only_its_subtree(spark):
    from pyspark.sql import functions as F

    from newsloom.llm.shards import assign

    ids = spark.range(4000).withColumn("k", F.col("id").cast("string"))
    before, after = [1.0] * 8, [1.0] * 7 + [2.0]
    rows = ids.select(assign(F.col("k"), before).alias("a"), assign(F.col("k"), after).alias("b")).collect()
    # The weight of shard 7 (region 1, rack 1) grows: nothing moves between the shards of region 0.
    assert all(r.a == r.b or r.b >= 4 for r in rows) and any(r.a != r.b for r in rows)


# ---- 6 token counts


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece
    import tokenizers

    from newsloom.llm.token_counts import token_counts

    rows = odd_docs() + [(7000, "word " * 3000), (7001, "  a b \n\n c")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    key = lambda x: tuple((v is None, v) for v in x)
    got = sorted(map(tuple, token_counts(frame(spark, rows), path).collect()), key=key)
    expected = [(d, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows]
    assert got == sorted(expected, key=key)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id or -1, r.n_tokens) for r in token_counts(frame(spark, rows), path).collect()))
    assert got == sorted((d or -1, len(model.encode(t or ""))) for d, t in rows)
    assert token_counts(empty(spark), path).count() == 0


# ---- 7 pieces


def test_pieces(spark):
    import sentencepiece

    from newsloom.llm.pieces import default_model, encode

    rng = random.Random(8)
    letters = "aeithsrno▁ \n.ÀÉ漢🙂0123ABC"
    rows = odd_docs() + [(8000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))) for i in range(300)]
    rows += [(9000, "e" * 700), (9001, " " * 90 + "x"), (9002, "in" * 400 + " on")]
    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = encode(frame(spark, rows), default_model()).collect()
    key = lambda x: (x[0] or -1, x[1])
    assert sorted(((r.doc_id, r.piece_ids) for r in got), key=key) == sorted(((d, model.encode(t or "")) for d, t in rows), key=key)
    assert all(r.n_pieces == len(r.piece_ids) for r in got)
    plain = {d for d, t in rows if "▁" not in (t or "")}
    assert all(r.decoded_equal for r in got if r.doc_id in plain)
    assert encode(empty(spark), default_model()).count() == 0


# ---- 8 line dedup


def brute_lines(rows):
    tokens = lambda line: frozenset(re.findall(r"[^\W_]+", line.lower()))
    lines = [(d is None, d or 0, i, tokens(x)) for d, t in dict.fromkeys(rows) for i, x in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: x[:3])
    gone = set()
    for k, (n, d, i, s) in enumerate(lines):
        if s and any(len(s & o[3]) * 5 >= 4 * len(s | o[3]) for o in lines[:k] if o[3]):
            gone.add((None if n else d, i))
    return gone


def test_line_dedup(spark):
    from newsloom.llm import line_dedup

    rng = random.Random(9)
    pool = [sentence(rng, rng.randint(1, 40)).split() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(ODD)]
    for d in range(100, 180):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2, 5))):
                line[rng.randrange(len(line))] = f"w{rng.randint(0, 400)}"
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    rows += [(None, "\n".join(" ".join(p) for p in pool[:3])), rows[40]]
    docs = frame(spark, rows)
    expected = brute_lines(rows)
    got = line_dedup.line_dedup(docs, whole=False).collect()
    assert {(r.doc_id, i) for r in got for i in r.removed} == expected
    assert len(got) == len(rows) and all(r.n_removed == len(r.removed) for r in got)
    extra = docs.selectExpr("doc_id", "text", "doc_id AS d", "text AS line", "1 AS l", "2 AS token")
    left = line_dedup.line_dedup(extra)
    assert left.columns == extra.columns
    for r in left.collect():
        text = next(t for d, t in rows if d == r.doc_id)
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (r.doc_id, i) not in expected)
        assert r.text == kept
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_without_id(spark):
    from newsloom.llm import line_dedup

    line = [f"w{i}" for i in range(20)]
    rows = [(7, " ".join(line)), (None, " ".join([*line[:19], "other"]) + "\nnothing like it")]
    # Of the near copies inside a document without an id, the later goes too.
    rows.append((None, "\n".join(" ".join([*(f"v{i}" for i in range(20)), x]) for x in ("first", "second"))))
    got = {(r.doc_id, r.n_lines, tuple(r.removed)) for r in line_dedup.line_dedup(frame(spark, rows), whole=False).collect()}
    assert got == {(7, 1, ()), (None, 2, (0,)), (None, 2, (1,))}


def test_line_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """A large group of near copies, and long lines that share rare words: few pairs are compared."""
    from newsloom.llm import line_dedup

    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(300):
        line = [w for w in base if rng.random() > 0.03]
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = f"w{rng.randrange(10**6)}"
        rows.append((d, " ".join(line)))
    for d in range(300, 360):
        rows.append((d, " ".join(rng.sample([f"v{i}" for i in range(700)], 160))))
    seen = []
    pinned = line_dedup.pinned

    def counted(df):
        out = pinned(df)
        seen.append(out.count() if "early" in out.columns else 0)
        return out

    monkeypatch.setattr(line_dedup, "pinned", counted)
    got = line_dedup.line_dedup(frame(spark, rows), whole=False).collect()
    assert {(r.doc_id, i) for r in got for i in r.removed} == brute_lines(rows)
    assert sum(seen) < 4 * len(rows)


# ---- 9 decontamination


def test_leaks(spark):
    from newsloom.llm.decontamination import decontaminate, leaks

    rng = random.Random(10)
    items = [(i, sentence(rng, rng.randint(14, 50), 900)) for i in range(30)] + [(50, "one two"), (51, None), (52, ""), (None, "a b c d e f"), (0, "other text of a repeated item id here now")]
    rows = odd_docs()
    planted = {}
    for k in range(40):
        item, text = items[k % 30]
        words = text.split()
        if k % 4 == 1 and len(words) > 40:
            words = words[2:]
        if k % 4 == 2:
            words = [w.upper() + "," for w in words]
        before, after = sentence(rng, rng.randint(0, 60), 900), sentence(rng, rng.randint(0, 60), 900)
        rows.append((3000 + k, f"{before} {' '.join(words)} {after}"))
        planted[3000 + k] = item
    rows.append((3999, "One two"))
    clean = {d for d, _ in rows if d is not None and d < 3000}
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = leaks(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    from collections import Counter

    expected = {}
    for d, t in rows:
        for item, text in items:
            a, b = tokens(t), tokens(text)
            if d is None or item is None or not b or not a:
                continue
            for s in range(max(1, len(a) - len(b) + 1)):
                x, y = Counter(shingles(a[s : s + len(b)])), Counter(shingles(b))
                sim = sum((x & y).values()) / sum((x | y).values())
                if sim >= 0.8:
                    expected[d, item] = max(sim, expected.get((d, item), 0))
    assert pairs == set(expected)
    assert all(math.isclose(r.similarity, expected[r.doc_id, r.item_id]) for r in got)
    assert set(planted.items()) <= pairs and not {d for d, _ in pairs} & clean
    left = {r.doc_id for r in decontaminate(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in pairs}
    assert leaks(empty(spark), bench).count() == 0 and leaks(docs, empty(spark, "item_id long, text string")).count() == 0


def test_leaks_of_short_texts_and_items(spark):
    from newsloom.llm.decontamination import leaks

    long = [f"w{i}" for i in range(50)]
    items = [(1, " ".join(long)), (2, "alpha beta gamma"), (3, "solo"), (4, "Three of four words"[6:])]
    docs = [
        (10, " ".join(long[:44])),  # 40 of 46 shingles
        (11, " ".join(long[:40])),  # 36 of 46 are too few
        (12, "one two three Alpha, beta gamma four five six"),
        (13, "alpha beta delta gamma five six"),
        (14, "so we met, solo"),
        (15, "alpha beta gamma"),
        (16, "x of four words"),
    ]
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert got == {(10, 1): (0, 40 / 46), (12, 2): (3, 1.0), (14, 3): (3, 1.0), (15, 2): (0, 1.0), (16, 4): (1, 1.0)}


# ---- 10 vectors


@pytest.mark.parametrize("shard_size", [2048, 8])
def test_vector_groups(spark, monkeypatch, shard_size):
    from newsloom.llm import vector_dedup

    monkeypatch.setattr(vector_dedup, "SHARD", shard_size)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(260):
        if i % 3 and rows:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            v = base + rng.normal(size=16) * 0.07 * np.linalg.norm(base)
        else:
            v = rng.normal(size=16)
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(300, rows[0][1], rows[0][2]), (301, rows[0][1], 1 - rows[0][2]), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [float("inf")] + [1.0] * 15, 0), (307, [None] + [1.0] * 15, 0), (308, [], 0), (309, [1.0, 2.0], 0), (310, [2.0, 4.0], 0), (None, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2])]
    got = vector_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    good = [
        (i, np.array(v), label) for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links = []
    degree: dict = {}
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, u, x), (j, v, y) = good[a], good[b]
            if x == y and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.93:
                links.append((i, j))
                degree[i] = degree.get(i, 0) + 1
                degree[j] = degree.get(j, 0) + 1
    root = roots({i for i, _, _ in rows if i is not None}, [p for p in links if p[0] != p[1]])
    assert len(got) == len(rows) and len(links) > 100
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        elif r.vec_id != 5:
            assert (r.vec_id, r.n_links, r.component_id, r.kept) == (r.vec_id, degree.get(r.vec_id, 0), root[r.vec_id], root[r.vec_id] == r.vec_id)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dedup.vector_groups(none).count() == 0
