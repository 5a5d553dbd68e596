from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, fingerprints, quality, textops, toxicity

from .conftest import EDGE, frame

SF = "/root/testdata/sf0.01"


def distance_to_substring(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rnd = random.Random(1)
    for _ in range(400):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 120)))
        want = distance_to_substring(p, t)
        got = decontamination.distance_within(decontamination.peq(p), len(p), t, 40)
        assert got == (min(want, 41) if want < len(p) else got)


def test_decontamination(spark, edge, empty):
    rnd = random.Random(4)
    letters = "abcdefghij klmnop"
    items = [(k, "".join(rnd.choice(letters) for _ in range(150)).strip()) for k in range(6)] + [(6, None), (7, ""), (None, "no id")]

    def edited(text, n):
        out = list(text)
        for _ in range(n):
            out[rnd.randrange(len(out))] = rnd.choice(letters)
        return "".join(out)

    noise = lambda: "".join(rnd.choice(letters) for _ in range(300))
    rows = [(i, noise() + " " + edited(items[i % 6][1], i).upper() + "\n" + noise()) for i in range(24)] + [(100, noise()), (101, None), (102, ""), (None, items[0][1]), (103, items[1][1]), (103, items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.decontaminate(frame(spark, rows), bench).collect()
    assert len(got) == len(rows)
    texts = {i: decontamination.normal(t or "") for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            assert r["items"] == [0]
            continue
        want = [k for k, t in items[:6] if distance_to_substring(decontamination.normal(t), texts[r.doc_id]) <= decontamination.budget(decontamination.normal(t), decontamination.EDIT_RATE)]
        assert list(r["items"]) == want and r.contaminated == bool(want)
    assert decontamination.decontaminate(empty, bench).count() == 0
    none = decontamination.decontaminate(edge, bench.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() == len(EDGE)
    assert decontamination.drop_contaminated(edge, bench).columns == edge.columns


def test_item_blocks_give_the_same(spark, monkeypatch):
    items = [(k, f"a test item of its own number {k} with some more words {k * 7}") for k in range(5)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, [(i, f"before {items[i % 5][1]} after {items[(i + 1) % 5][1]}") for i in range(10)])
    one = sorted(decontamination.decontaminate(docs, bench).collect())
    real = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda b: real(b, 60))
    assert len(list(decontamination.item_blocks(bench))) > 2
    assert sorted(decontamination.decontaminate(docs, bench).collect()) == one


def test_fingerprints(spark, edge, empty):
    for parts in (1, 3):
        got = fingerprints.fingerprints(edge, parts).collect()
        assert len(got) == len(EDGE)
        by_id = {}
        for r in got:
            by_id.setdefault(r.doc_id, []).append(r)
        rows = sorted((x for x in EDGE if x[0] is not None), key=lambda x: -x[0])
        for k, (i, t) in enumerate(rows[:-1]):
            if i in (2, 1):
                continue
            t, after = t or "", rows[k + 1][1] or ""
            want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            assert by_id[i][0].n_chars == len(t) and by_id[i][0].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert by_id[1][0].fingerprint == by_id[2][0].fingerprint == by_id[2][1].fingerprint != by_id[3][0].fingerprint
        assert by_id[4][0].fingerprint == by_id[5][0].fingerprint
        assert sorted(r.near_next for r in by_id[2]) == [1.0, 1.0]  # the repeated row, then the copy with id 1
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprints(empty).count() == 0
    alone = fingerprints.fingerprints(frame(spark, [(1, "abcdef")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and alone.near_next == 1.0


def test_prefix_hashes():
    rnd = random.Random(6)
    s = "".join(rnd.choice("ab") for _ in range(300))
    f = fingerprints.PrefixHashes((s + s[50:]).encode())
    at = np.array([(rnd.randrange(300), rnd.randrange(250), rnd.randrange(40)) for _ in range(300)])
    i, j, n = at[(at[:, 0] + at[:, 2] <= 300) & (at[:, 1] + at[:, 2] <= 250)].T
    assert f.equal(i, 300 + j, n).tolist() == [s[a : a + m] == s[50 + b : 50 + b + m] for a, b, m in zip(i, j, n, strict=True)]
    ahead = f.common_extension(i, 300 + j, np.minimum(300 - i, 250 - j))
    back = f.common_extension(i, 300 + j, np.minimum(i, j), back=True)
    for a, b, got, before in zip(i, j, ahead, back, strict=True):
        assert got == len(os.path.commonprefix([s[a:], s[50 + b :]])) and before == len(os.path.commonprefix([s[:a][::-1], s[50 : 50 + b][::-1]]))


def brute_sample(data):
    """The smallest hashes of a text's spans, from each span by itself."""
    out = set()
    for k in range(max(len(data) - fingerprints.SPAN + 1, 1 if data else 0)):
        span, h = data[k : k + fingerprints.SPAN], 0
        for p, base in zip(fingerprints.MODULI, fingerprints.BASES, strict=True):
            h = h << 31 | sum((c + 1) * pow(base, i, p) for i, c in enumerate(span)) % p
        out.add(int(textops.mix(np.array([h], np.uint64))[0]) >> 32)
    return sorted(out)[: fingerprints.SKETCH]


def brute_likeness(x, y):
    """Covered bytes from each common sampled span, and from the begins, byte by byte."""
    size, common = fingerprints.SPAN, set(brute_sample(x)) & set(brute_sample(y))
    place = lambda d: {brute_sample(d[k : k + size])[0]: k for k in reversed(range(max(len(d) - size + 1, 1 if d else 0)))}
    one, two, got_x, got_y = place(x), place(y), set(), set()
    for a, b in [(0, 0), *((one[v], two[v]) for v in common)]:
        n = len(os.path.commonprefix([x[a:], y[b:]]))
        m = len(os.path.commonprefix([x[:a][::-1], y[:b][::-1]]))
        got_x |= set(range(a - m, a + n))
        got_y |= set(range(b - m, b + n))
    return 2 * min(len(got_x), len(got_y)) / (len(x) + len(y)) if x or y else 1.0


def test_fingerprints_against_brute_force():
    rnd = random.Random(9)
    some = lambda n: bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
    base = some(400)
    texts = [base, base[:200] + some(200), some(350), base[100:300], b"", some(5), base[:150] + some(7) + base[150:], b"", some(60)]
    f = fingerprints.Fingerprints(texts)
    for i, t in enumerate(texts):
        assert f.mark(i).split(".")[2] == "".join(f"{v:08x}" for v in brute_sample(t))
        assert f.mark(i) == fingerprints.Fingerprints([b"other text before", t]).mark(1)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    for (i, j), got in zip(pairs, f.likeness(pairs), strict=True):
        assert abs(got - brute_likeness(texts[i], texts[j])) < 1e-9
    assert f.likeness([(0, 0), (0, 1), (0, 2), (4, 7), (0, 4)]).round(2).tolist()[0] == 1.0 and 0.45 < f.likeness([(0, 1)])[0] < 0.6 and f.likeness([(0, 4)])[0] == 0


def test_held_out(spark):
    rows = spark.range(50).select("id", textops.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize(("module", "label", "query", "least"), [(toxicity, "toxic", "op10_toxicity", 0.8), (quality, "quality", "op5_quality", 0.95)])
def test_held_out_accuracy(spark, module, label, query, least):
    got = getattr(module, query)(spark, SF).where("held_out")
    both = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", label).collect()
    pos, neg = [r.score for r in both if r[1]], [r.score for r in both if not r[1]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc >= least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifier_edges(spark, edge, empty, module):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 0, 1), (6, 1, 0), (6, 1, 0), (11, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = module.fit(edge, labels)
    got = module.score(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[4] == by_id[5]
    assert module.score(empty, model).count() == 0
    blank = module.fit(empty, labels)
    assert len({r.score for r in module.score(edge, blank).collect()}) == 1


def test_rare_toxic_words_count():
    """A word in five of few toxic rows tells, though fewer than ten rows hold it."""
    rnd = random.Random(4)
    words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('klmnp')}{rnd.choice('aeiou')}{rnd.choice('rstvw')}" for _ in range(60)]
    some = lambda: [rnd.choice(words) for _ in range(30)]
    texts = [" ".join(some()) for _ in range(40)] + [" ".join([*some(), "zxqhyj", *some()]) for _ in range(5)]
    model = toxicity.NaiveBayesLinear.fit(texts, [0] * 40 + [1] * 5)
    held = [" ".join([*some(), "zxqhyj"]) for _ in range(20)] + [" ".join(some()) for _ in range(20)]
    data = [t.encode() for t in held]
    got = model.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert (got[:20] >= 0.5).all() and (got[20:] < 0.5).all()


def test_toxicity_score_against_brute_force(spark):
    """A text's score from the set of its n-grams, spelled out, and the rule that says which of them count."""
    rnd = random.Random(12)
    words = ["grün", "lawn", "spade", "mud", "rot", "ÉTÉ", "日本", "weed"]
    texts = [" ".join(rnd.choice(words[: 8 if k % 3 else 5]) for _ in range(12)).title() for k in range(30)]
    y = [int("weed" in t.lower() or "日本" in t) for t in texts]
    model = toxicity.NaiveBayesLinear.fit(texts, y)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = lambda t: {t[i : i + n] for t in [t.translate(lower)] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}

    def key(gram):
        """An n-gram alone in a text: its own hash is the longest one's."""
        data = np.frombuffer(gram.encode(), np.uint8)
        return int([h for _, h in toxicity.grams(data, np.array([0, len(data)]))][-1][0])

    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    one, zero = sum(y), len(y) - sum(y)
    every = set().union(*map(found, texts))
    p = {g: sum(g in found(t) for t, k in zip(texts, y, strict=True) if k) for g in every}
    q = {g: sum(g in found(t) for t, k in zip(texts, y, strict=True) if not k) for g in every}
    ratio = {g: np.log((p[g] + 1) / (one + 2)) - np.log((q[g] + 1) / (zero + 2)) for g in every}
    counts = {g for g in every if p[g] + q[g] >= toxicity.LEAST and abs(ratio[g]) >= toxicity.ERRORS * np.sqrt(1 / (p[g] + 1) + 1 / (q[g] + 1))}
    assert {key(g) for g in counts} == set(weight)
    held = [*texts[:5], "", "mu", "WEED weed Weed", "日本"]
    got = [r.score for r in spark.createDataFrame(list(enumerate(held)), "i int, text string").select("i", toxicity.likeliness(F.col("text"), model).alias("score")).orderBy("i").collect()]
    want = [1 / (1 + np.exp(-(model.bias + sum(weight.get(key(g), 0) for g in found(t))))) for t in held]
    assert np.allclose(got, want)


def test_training_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(1, "another text"), (50, "x" * 100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(2, 1), (50, 1), (None, 1), (3, None), (99, 0)], "doc_id bigint, toxic int")
    rows = textops.training_rows(docs, labels, "toxic", 100, 80)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert all(not held(int(t.split()[1])) for t, _ in rows if t.startswith("text ")) and "x" * 100 not in [t for t, _ in rows]
    for k in (0, 1):
        assert 0 < sum(len(t) for t, y in rows if y == k) <= 80
    assert all(y == 1 for t, y in textops.training_rows(docs, labels, "toxic", 100) if t == "text 2")
    assert textops.training_rows(docs, labels, "toxic", 100) == textops.training_rows(docs.repartition(3), labels.repartition(2), "toxic", 100)


def test_drop_toxic(spark, edge):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = toxicity.drop_toxic(edge, labels)
    assert kept.columns == edge.columns and kept.count() == len(EDGE)


def test_line_features_against_brute_force():
    texts = ["Two words, here!\n\nthen 12 12 |x|", "", "é ÄB a a"]
    data = [t.encode() for t in texts]
    x, row, size = quality.line_features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    own = []
    for line in (line for t in data for line in t.split(b"\n")):
        n, words = max(len(line), 1), line.split()
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        w = max(len(words), 1)
        own.append([sum(c in k for c in line) / n for k in quality.CLASSES] + [sum(c > 127 for c in line) / n, repeats / w, min(len(line) / w, 40) / 10, np.log1p(len(line)) / 5, float(not line)])
    lines = [k for k, t in enumerate(data) for _ in t.split(b"\n")]
    assert row.tolist() == lines and size.tolist() == [len(line) for t in data for line in t.split(b"\n")]
    zero = [0.0] * len(own[0])
    for i, k in enumerate(lines):
        before = own[i - 1] if i and lines[i - 1] == k else zero
        after = own[i + 1] if i + 1 < len(own) and lines[i + 1] == k else zero
        edge = [float(before is zero), float(after is zero)]
        assert np.allclose(x[i], [*own[i], *before, *after, *edge, 1])


def test_document_score_is_weighted_by_length():
    rnd = np.random.default_rng(8)
    text = b"a good line of plain words\n### 77 @@ ##\nshort\n\nand one more good line of words"
    x, row, size = quality.line_features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    model = quality.LineCrf(rnd.normal(size=x.shape[1]), rnd.normal(size=(2, 2)), np.zeros(x.shape[1]), np.ones(x.shape[1]))
    sums, total = np.zeros(len(x)), 0.0
    for code in range(2 ** len(x)):
        y = [code >> k & 1 for k in range(len(x))]
        w = np.exp(sum(f @ model.weights * v for f, v in zip(x, y, strict=True)) + sum(model.turn[a, b] for a, b in zip(y, y[1:], strict=False)))
        sums, total = sums + w * np.array(y), total + w
    want = (sums / total * size).sum() / size.sum()
    assert np.allclose(model.score(np.frombuffer(text, np.uint8), np.array([0, len(text)])), want)


def test_lines_of_both_kinds_in_one_document():
    """Bad lines inside a good row are told from their neighbours, though each row has one label."""
    rnd = random.Random(5)
    good = lambda: " ".join(rnd.choice("the garden path leads past an old wall to where roses grow".split()) for _ in range(10))
    bad = lambda: "".join(rnd.choice("#@%|0123456789") for _ in range(40))
    texts = ["\n".join(good() if rnd.random() < 0.9 else bad() for _ in range(10)) for _ in range(40)] + ["\n".join(bad() if rnd.random() < 0.9 else good() for _ in range(10)) for _ in range(40)]
    model = quality.LineCrf.fit(texts, [1] * 40 + [0] * 40)
    lines = [good(), good(), bad(), bad(), good()]
    data = "\n".join(lines).encode()
    x, row, _ = quality.line_features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    chance, _ = model.marginals(x, row)
    assert (chance[[0, 1, 4]] > 0.5).all() and (chance[[2, 3]] < 0.5).all()


def test_forward_backward_against_sums():
    rnd = np.random.default_rng(3)
    model = quality.LineCrf(rnd.normal(size=3), rnd.normal(size=(2, 2)), np.zeros(3), np.ones(3))
    x, row = rnd.normal(size=(7, 3)), np.array([0, 0, 0, 0, 1, 2, 2])
    good, turn = model.marginals(x, row)
    want, want_turn = np.zeros(7), np.zeros((2, 2))
    for r in range(3):
        at = np.flatnonzero(row == r)
        weights = {}
        for code in range(2 ** len(at)):
            y = [code >> k & 1 for k in range(len(at))]
            weights[tuple(y)] = np.exp(sum(x[i] @ model.weights * v for i, v in zip(at, y, strict=True)) + sum(model.turn[a, b] for a, b in zip(y, y[1:], strict=False)))
        total = sum(weights.values())
        for y, w in weights.items():
            for i, v in zip(at, y, strict=True):
                want[i] += v * w / total
            for a, b in zip(y, y[1:], strict=False):
                want_turn[a, b] += w / total
    assert np.allclose(good, want) and np.allclose(turn, want_turn)
