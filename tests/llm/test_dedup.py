from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import components, jaccard_join, line_dedup, sentence_spans, suffix_dedup

from .conftest import EDGE, frame

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def near_copies(n=60, seed=3):
    """Families of edited copies, shared passages, and a short text that many hold."""
    rnd = random.Random(seed)
    words = ["w" + str(i) for i in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    rows, base = [], None
    for i in range(n):
        if i % 6 == 0:
            base = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        text = list(base)
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text) + (". " + passage if i % 4 == 1 else "") + ("\nShared line of the corpus" if i % 3 == 0 else "")))
    return rows


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for x in ids:
            for y in ids:
                inter = len(sets[x] & sets[y])
                if inter and 100 * inter >= 80 * (len(sets[x]) + len(sets[y]) - inter) and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return sets, label


@pytest.mark.parametrize("few", [8, 2])
def test_jaccard_components(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = near_copies()
    sets, label = brute_components(rows)
    got = jaccard_join.classes(frame(spark, rows).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MANY", 3)
    rows = near_copies(40, 5)
    sets, label = brute_components(rows)
    got = jaccard_join.classes(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_links_inside_a_group_alone(spark):
    """Members of one group that link with each other, and not with the group's leader: the group's postings may be nobody else's."""
    some = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rare = some("rare", 12)  # eight shingles in four texts only: the prefix of all four
    fill = {k: [some(f"{k}{j}", 7) for j in range(10)] for k in "ab"}
    text = lambda k, own: " ".join(sum(fill[k], []) + rare + own)
    rows = [(i, text("ab"[i % 2], [])) for i in range(4)] + [(2, text("a", ["tail"])), (3, text("b", ["tail", "end"]))]
    rows += [(100 + j, " ".join(fill[k][j] + fill[k][j + 1])) for k in "ab" for j in range(9) for _ in range(8)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sets, label = brute_components(rows)
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(frame(spark, rows)).collect()}
    assert got == label and len({label[i] for i in range(6)}) == 2


@pytest.mark.parametrize("chunk", [512, 7])
def test_jaccard_all_links(spark, monkeypatch, chunk):
    """n_links and the pairs have every link, also those inside a group that is already connected."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[: 7 * i], f"other{i}", *base[7 * i + 1 :]])) for i in range(40)] + [(100 + i, t) for i, t in near_copies(30)]
    sets, _ = brute_components(rows)
    distinct = {frozenset(v): i for i, v in sorted(sets.items(), reverse=True)}
    ids = sorted(distinct.values())
    want = {(x, y) for x in ids for y in ids if x > y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert len([p for p in want if p[0] < 40]) == 780
    degree = Counter(i for p in want for i in p)
    docs = frame(spark, rows).repartition(3)
    assert {r.doc_id: r.n_links for r in jaccard_join.classes(docs).collect()} == {i: degree[distinct[frozenset(sets[i])]] for i in sets}
    pairs, membership = jaccard_join.link_pairs(docs)
    of = {}
    for r in membership.collect():
        of[bytes(r.id)] = min(r.doc_id, of.get(bytes(r.id), r.doc_id))
    got = [tuple(sorted((of[bytes(r.a)], of[bytes(r.b)]), reverse=True)) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_packed_tables():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 1000):
        v = np.sort(rnd.integers(0, 1 << 48, n, dtype=np.uint64))
        place, rank = rnd.integers(0, 60_000, n).astype(np.uint16), rnd.integers(0, 40, n).astype(np.uint8)
        got = jaccard_join.unpacked(jaccard_join.packed(v, place, rank))
        assert all((x == y).all() and len(x) == n for x, y in zip(got, (v, place, rank), strict=True))


@pytest.mark.parametrize("often", [2, 16])
def test_jaccard_frequent_shingles(spark, monkeypatch, often):
    """Shingles that many sets of a chunk hold send only their number; sets over several chunks with repeated ids and rows."""
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    monkeypatch.setattr(jaccard_join, "CHUNK_ROWS", 7)
    rows = near_copies(48, 11)
    sets, label = brute_components(rows)
    got = jaccard_join.classes(frame(spark, rows + rows).repartition(3)).collect()
    assert len(got) == 2 * len(rows) and {r.doc_id: r.component_id for r in got} == label


def test_jaccard_edges(spark, edge, empty):
    got = defaultdict(list)
    for r in jaccard_join.classes(edge).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id))
    assert sum(map(len, got.values())) == len(EDGE)
    assert [c for _, c in got[2]] == [1, 1] and got[4] == [(0, 4)] and got[5] == [(0, 5)] and got[9] == [(1, 9)]
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids and ids[None] == 2 and ids[4] == 1
    assert jaccard_join.classes(empty).count() == 0


def test_components(spark):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(30)] + [(100 + rnd.randrange(20), 100 + rnd.randrange(20)) for _ in range(15)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    label = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner.setdefault(key(line), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or owner.get(key(x), i) == i]
        out.append((i or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines(spark, edge, batches):
    for rows in (EDGE, near_copies()):
        got = line_dedup.dedup_lines(frame(spark, rows), batches)
        assert sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == brute_lines(rows)
    assert set(got.columns) == set(edge.columns) | {"n_dropped"}


def test_lines_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


def test_suffix_array():
    rnd = random.Random(3)
    for _ in range(2000):
        k = rnd.choice([1, 2, 3, 5, 40])
        t = [rnd.randint(1, k) for _ in range(rnd.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute_bytes(rows):
    texts = {(i, t) for i, t in rows if i is not None and t}
    seen = Counter(b[k : k + 200] for b in (t.encode() for _, t in texts) for k in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone, end = bytearray(len(b)), 0
        for k in range(len(b) - 199 if i is not None else 0):
            if seen[b[k : k + 200]] > 1:
                for q in range(max(end, k), k + 200):
                    gone[q] = 1
                end = k + 200
        runs = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i or 0, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("many", [20_000, 2])
def test_repeated_bytes(spark, empty, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    small = [(i, t if t is None or len(t) < 50_000 else t[:4000]) for i, t in EDGE]
    for rows in (small, near_copies(), [(1, "ab" * 400), (2, "x" * 199), (3, "x" * 200), (4, "x" * 200)]):
        got = suffix_dedup.kept_texts(frame(spark, rows).repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows)
    assert suffix_dedup.kept_texts(empty).count() == 0


def test_unpunctuated_passages(spark):
    """A repeated passage without any punctuation, and a run of one word, have bounds of their own."""
    rnd = random.Random(8)
    some = lambda n: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(n))
    passage, junk = some(80), " ".join(["and"] * 90)
    rows = [(1, f"{some(30)} {passage} {some(40)}"), (2, f"{some(45)} {passage} {some(20)}"), (3, f"{some(9)} {junk}"), (4, junk + " " + some(31))]
    got = {r.doc_id: r for r in sentence_spans.dedup_spans(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 0 and got[4].n_removed > 0
    left = got[2].text.split()
    assert len(left) <= 145 - 50 and left[:40] == rows[1][1].split()[:40] and left[-15:] == rows[1][1].split()[-15:]
    assert got[4].text.split().count("and") < 20


def test_sentence_spans(spark, edge, empty):
    same = "Seven wizards walked over the stone bridge. They mixed potions near the river at dawn. Nobody saw them leave the town again."
    rows = [(1, "An opening of its own here. " + same), (2, "Another opening, quite unlike. " + same + " And its own end."), (3, "Nothing of it is here at all. Only two sentences stand in this text.")]
    got = {r.doc_id: r for r in sentence_spans.dedup_spans(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1] and got[3].n_removed == 0
    assert got[2].n_removed == 3 and got[2].text == "Another opening, quite unlike. And its own end."
    out = sentence_spans.dedup_spans(edge)
    assert out.count() == len(EDGE) and sentence_spans.dedup_spans(empty).count() == 0
    assert out.where("doc_id IS NULL AND n_removed > 0").count() == 0
    hashes = {r.doc_id: r.n_sentences for r in out.where("doc_id IN (4, 5, 7)").collect()}
    assert hashes == {4: 0, 5: 0, 7: 0}


def test_spans_against_brute_force(spark):
    rows = near_copies(40, 9)
    rows = [(i, ". ".join(re.findall(r"(?:\S+ ){4}\S+", t))) for i, t in rows]

    def parts(text):
        words = text.split()
        ends = [k + 1 for k, w in enumerate(words) if w[-1] in ".!?"] + [len(words)]
        first = sorted({0, *ends})[:-1]
        return words, first

    seen, gone = {}, defaultdict(set)
    for i, t in rows:
        words, first = parts(t)
        edge = [*first, len(words)]
        for a in range(len(first)):
            b = next((b for b in range(a + 2, len(first) + 1) if edge[b] - edge[a] >= 12), None)
            if b is not None:
                span = tuple(w.lower() for w in words[edge[a] : edge[b]])
                if span in seen:
                    gone[i] |= set(range(a, b))
                else:
                    seen[span] = (i, a)
    got = {r.doc_id: r.n_removed for r in sentence_spans.dedup_spans(frame(spark, rows)).collect()}
    assert got == {i: len(gone[i]) for i, _ in rows} and sum(got.values()) > 0


def test_clashing_names(spark):
    """Names that operators might use inside, and upper-case twins of them, stay what they are."""
    from quarry.llm import decontamination, toxicity

    docs = frame(spark, EDGE[:8]).selectExpr("*", "1 AS _n", "2 AS _id", "3 AS _t", "4 AS _gone", "5 AS _items", "6 AS _q0", "7 AS _Q1", "8 AS of", "9 AS h1")
    bench = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id bigint, text string")
    out = line_dedup.dedup_lines(docs)
    assert out.where("_gone = 4 AND _n = 1 AND _Q1 = 7").count() == 8 and [c for c in out.columns if c != "n_dropped"] == [c for c in docs.columns if c != "n_lines"] + ["n_lines"]
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r._t for r in kept.collect()} == {3}
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r._items for r in clean.collect()} == {5} and clean.where("doc_id IN (1, 2)").count() == 0
    assert toxicity.drop_toxic(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).columns == docs.columns


def test_long_texts_lose_repeats(spark):
    """A very long text whose middle another holds, and one that repeats itself."""
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long), (2, "x" + long[20_000:20_900] + "y"), (3, None), (4, long[:500] + "-" + long[:500])]
    got = suffix_dedup.kept_texts(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_bytes(rows)


def test_kept_hash_is_of_the_text(spark):
    row = line_dedup.dedup_lines(frame(spark, [(1, "one")])).first()
    assert hashlib.sha256(row.text.encode()).hexdigest() == hashlib.sha256(b"one").hexdigest()
