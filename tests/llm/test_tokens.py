from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bpe, pretoken, token_counts

from .conftest import EDGE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    import regex

    assert pretoken.PATTERN == public_tokenizers.PATTERN
    find = regex.compile(public_tokenizers.PATTERN).findall
    rnd = random.Random(1)
    letters = "aZé9²½ª \t\n\x0b\x1c\x85\xa0'sdtmlvre_-!?日🎉 ȴ"
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        assert pretoken.split(t) == find(t)


def test_counts_of_every_row(spark, edge, empty, library):
    rows = token_counts.count_tokens(edge).collect()
    assert len(rows) == len(EDGE)
    want = sorted(((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE))
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count_tokens(empty).count() == 0


def test_prefixes_and_budgets(library):
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    for text in ("it's   a  test\n\n of   white space 12345 !!", "naïve 日本語 🎉🎉 xyzzy", "word" * 40, "a<|endoftext|>b c"):
        table = c.table(text)
        for k in [0, len(text), *(rnd.randint(0, len(text)) for _ in range(30))]:
            if "<" in text and 0 < k < len(text):
                continue
            assert c.count_at(text, len(text[:k].encode()), table) == len(library.encode(text[:k], add_special_tokens=False).ids)
        for budget in (0, 1, 5, 1000):
            cut = text.encode()[: c.cut(text, budget)].decode()
            assert c.count(cut) <= budget


def test_cut_is_the_longest_prefix(library):
    """Against the maximum over all prefixes; the counts of ' worthless' fall and rise again."""
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" worthless", "a worthless, priceless thing\n\nthey're worthless   indeed", "naïve 日本語 🎉🎉 xyzzy worthless"):
        sizes = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        for budget in range(max(sizes) + 2):
            most = max(k for k, n in enumerate(sizes) if n <= budget)
            assert c.cut(text, budget) == len(text[:most].encode())


def test_limit_bytes(library):
    """What the query reads from the sums around the limit is what cut() finds in the whole table, and the library's maximum over all prefixes."""
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    some = ["worthless", " \n\n", "they're", "日本語", "12345", "🎉🎉", "  ", "naïve", "x" * 30, ", ", "<|endoftext|>"]
    for k in range(60):
        text = " ".join(rnd.choice(some[: 11 if k % 5 == 0 else 10]) for _ in range(60))
        for budget in (0, 1, 7, 40, 90):
            n, cut = c.within([text], budget)[0]
            assert n == len(library.encode(text, add_special_tokens=False).ids)
            assert cut == (len(text.encode()) if n <= budget else c.cut(text, budget))
            if k < 6 and "<" not in text:
                assert cut == max(len(text[:i].encode()) for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= budget)


def test_counts_forgotten_inside_a_step(library, monkeypatch):
    """More pre-tokens than are kept: a text that is cut makes room for its own, while the counts of the texts behind it are still needed."""
    monkeypatch.setattr(token_counts, "KEPT", 3)
    c = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    some = ["worthless they're  going", "naïve 日本語 \n\n we'll", "x<|endoftext|>y worthless", "12345 priceless"]
    texts = [f"{s} w{i} {'tail ' * i}" * 3 for i, s in enumerate(some * 3)]
    whole = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    got = c.within(texts, 9)
    assert [n for n, _ in got] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(token_counts, "KEPT", 300_000)
    assert [b for _, b in got] == [whole.cut(t, 9) for t in texts]


def test_prefix_counts_are_looked_up(library, monkeypatch):
    c = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "they've a worthless\n\nthing, " + "日本語 naïve" * 3 + "x" * 400 + "!<|endoftext|>  '\n\n we'll"
    table = c.table(text)
    ends = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert [c.count_at(text, n, table) for n in ends] == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    plain = "a worthless, priceless thing 12345 " + "x" * 400
    table = c.table(plain)
    monkeypatch.setattr(c, "within", None)  # no encoding
    monkeypatch.setattr(c, "learn", None)
    assert c.count_at(plain, len(plain), table) == table[1][-1] and c.count_at(plain, 6, table) == 3
    c.cut(plain, 5)


def test_truncate(spark, edge):
    got = {r.doc_id: r.text for r in token_counts.truncate(edge.where("doc_id IN (4, 6)"), 10).collect()}
    assert got[4] is None and len(got[6]) < 100
    assert token_counts.prefix_tables(edge).where("doc_id = 5").first().counts == [0]


def test_bpe_round_trip(spark, edge, empty, tik):
    rows = bpe.digests(edge).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in EDGE:
        ids = tik.encode_ordinary(t or "")
        want.append((i or 0, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert bpe.digests(empty).count() == 0
    back = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(bpe.encode(edge)).collect()}
    assert back[8] == dict(EDGE)[8] and back[5] == ""
    assert sorted(r.n_tokens for r in bpe.tokens(edge).collect()) == sorted(w[1] for w in want)


def test_decode_of_unknown_ids(spark, tik):
    rows = [(1, [tik.encode_ordinary("abc")[0], None, 10_000_000, -5]), (2, None), (3, []), (None, tik.encode_ordinary(" tail"))]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>")).collect()
    assert {r.doc_id: bytes(r.data) for r in got} == {1: b"abc", 2: b"", 3: b"", None: b" tail"}


def test_bpe_chunks(spark, edge, tik, monkeypatch):
    """Equal chunks are chunks of their own, and a worker that forgets words finds them again."""
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 300)
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "STEP", 20)
    rows = edge.where("doc_id IN (1, 2, 3, 8, 11)")
    both = rows.unionAll(rows)
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(both).collect())
    want = sorted((i, tik.encode_ordinary(t)) for i, t in EDGE if i in (1, 2, 3, 8, 11))
    assert got == sorted(want + want)


def test_bpe_chunk_memory(tik, monkeypatch):
    """A chunk is put together some words at a time: what that takes doesn't grow with the chunk."""
    steps = []

    class Docs:
        sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda _: "4"))
        select = repartitionById = groupBy = lambda self, *_: self

        def mapInArrow(self, run, _):
            steps.append(run)
            return self

        applyInArrow = mapInArrow

    bpe.tokens(Docs())
    words, encode, assemble = steps
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rnd = random.Random(4)
    some = ["".join(rnd.choices("abcdefghij", k=rnd.randint(1, 8))) for _ in range(5000)]
    texts = [" ".join(rnd.choices(some, k=3000)) for _ in range(300)]
    size = sum(map(len, texts))
    packed = list(encode(words(iter([pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])]))))
    tracemalloc.start()
    n, tokens = 0, 0
    for batch in assemble(iter(packed)):
        n += batch.num_rows
        tokens += sum(batch.column("n_tokens").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 and tokens == sum(map(len, tik.encode_ordinary_batch(texts)))
    assert peak < 6 * size


def test_packed_numbers():
    assert bpe.from_planes(bpe.planes(np.array([0, 1, 70_000, 1 << 31]))).tolist() == [0, 1, 70_000, 1 << 31] and len(bpe.from_planes(bpe.planes(np.zeros(0)))) == 0
    x = np.array([0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 200_000_000])
    assert bpe.unpack(bpe.pack(x)).tolist() == x.tolist()
    assert bpe.unpack(bpe.pack(x[:0])).tolist() == []
