from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import exact, hashing, text, url


#: One case or two of each law, of our own making.
URLS = [
    # scheme, host, port, user
    ("HTTPS://Garden.Test/beds", "https://garden.test/beds"),
    ("http://garden.test:80/", "http://garden.test/"),
    ("https://garden.test:8443/x", "https://garden.test:8443/x"),
    ("http://garden.test:443/", "http://garden.test:443/"),
    ("http://anna@garden.test/plan", "http://garden.test/plan"),
    ("http://garden.test./plan", "http://garden.test/plan"),
    ("http://10.0.0.7/plan", "http://10.0.0.7/plan"),
    ("https://grün.test/weg", "https://xn--grn-ioa.test/weg"),
    # what can't be fetched
    ("gopher://garden.test/", None),
    ("tel:555", None),
    ("http:///beds", None),
    ("beds/3", None),
    ("http://garden.test/%zz", None),
    (None, None),
    # path: segments, slashes, escapes, session ids
    ("http://garden.test", "http://garden.test/"),
    ("http://garden.test/x/./y/../z", "http://garden.test/x/z"),
    ("http://garden.test/../up", "http://garden.test/up"),
    ("http://garden.test/x/y/..", "http://garden.test/x/"),
    ("http://garden.test//x///y", "http://garden.test/x/y"),
    ("http://garden.test/%62%65%64", "http://garden.test/bed"),
    ("http://garden.test/x%2fy", "http://garden.test/x%2Fy"),
    ("http://garden.test/two words", "http://garden.test/two%20words"),
    ("http://garden.test/bäume", "http://garden.test/b%C3%A4ume"),
    ("http://garden.test/shed;JSessionID=77/tools", "http://garden.test/shed/tools"),
    # query: what goes, what stays in its order
    ("http://garden.test/?b=2&a=1", "http://garden.test/?b=2&a=1"),
    ("http://garden.test/?utm_term=k&plot=4", "http://garden.test/?plot=4"),
    ("http://garden.test/?plot=4&FBCLID=w&row=1", "http://garden.test/?plot=4&row=1"),
    ("http://garden.test/?sessionid=w", "http://garden.test/"),
    ("http://garden.test/?aspsessionidabc=w&row=1", "http://garden.test/?row=1"),
    ("http://garden.test/?&&row=1&", "http://garden.test/?row=1"),
    ("http://garden.test/?q=red+rose", "http://garden.test/?q=red+rose"),
    # fragment, and all at once
    ("http://garden.test/beds#north", "http://garden.test/beds"),
    ("HTTP://Anna@Garden.Test.:80/a/../Beds//3;jsessionid=1?utm_id=9&Row=2#n", "http://garden.test/Beds/3?Row=2"),
]


@pytest.mark.parametrize(("raw", "want"), URLS)
def test_url_laws(raw, want):
    assert url.canonical(raw) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abC./%41;=&?#:@é ", max_size=30))
def test_canonical_urls_stay(tail):
    once = url.canonical("https://Host.Example/" + tail)
    assert once is None or url.canonical(once) == once


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Plot 14: Anna's ROSES-red", [("plot", "word"), ("14", "number"), ("anna", "word"), ("s", "word"), ("roses", "word"), ("red", "word")]),
        ("花の庭 木", [("花の", "cjk-bigram"), ("の庭", "cjk-bigram"), ("木", "cjk-unigram")]),
        ("1" * 16 + " " + "1" * 17, [("1" * 16, "number"), ("1" * 17, "drop-long-number")]),
        ("ab" * 32 + " " + "ab" * 32 + "c", [("ab" * 32, "word"), ("ab" * 32 + "c", "drop-too-long")]),
        ("aaaaaaa aaaaaaaa", [("a" * 7, "word"), ("a" * 8, "drop-repeat")]),
        ("abcdefghijklmnopqrstuv12 abcdefghijklmnopqrstuvwx", [("abcdefghijklmnopqrstuv12", "drop-base64"), ("abcdefghijklmnopqrstuvwx", "word")]),
        ("a ��� b", [("a", "word"), ("�", "drop-binary"), ("b", "word")]),
        ("ﬁne ① İΣ", [("fine", "word"), ("1", "number"), ("iσ", "word")]),
        ("한국어", [("한국어", "word")]),
        ("", []),
    ],
)
def test_tokenizer_forms_agree(spark, raw, want):
    assert list(exact.classified(raw)) == want
    rows = text.positioned(spark.createDataFrame([(1, raw)], "id int, text string"), ["id"]).orderBy("pos").collect()
    assert [(r.term, r["class"]) for r in rows] == want
    assert [r.pos for r in rows] == list(range(len(want)))


def test_registered_functions(spark):
    from quarry.functions.register import register

    register(spark)
    row = spark.sql("SELECT canonicalize_url('HTTP://A.test:80') AS u, hamming64(5, 6) AS h, nfkc('ﬁ') AS n, simhash64('a b') AS s, snippet('x y') AS p").first()
    assert (row.u, row.h, row.n, row.p) == ("http://a.test/", 2, "fi", "x y")
    assert [(r.pos, r.term) for r in spark.sql("SELECT pos, term FROM tokens('One 2')").collect()] == [(0, "one"), (1, "2")]


def test_fnv(spark):
    from pyspark.sql import functions as F

    def fnv32(data):
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 % (1 << 32)
        return h

    words = ["", "a", "example.com", "münchen"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv32(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in rows} == {w: fnv32(w.encode()) for w in words}
    assert hashing.fnv64(b"a") == 0xAF63DC4C8601EC8C


def test_simhash_votes():
    words = "the quick brown fox the end".split()
    want = 0
    for b in range(64):
        ones = sum(hashing.fnv64(w.encode()) >> b & 1 for w in words)
        want |= (ones > len(words) - ones) << b
    assert hashing.simhash(" ".join(words)) == want
    assert hashing.simhash("") == 0


def test_snippet():
    assert text.snippet("short") == "short"
    dull, rich = "rain and rain and rain and rain. ", "Later one quiet gardener planted eleven roses beside old walls. "
    got = text.snippet(dull * 20 + rich + dull * 40)
    assert got.startswith("rain") or got.startswith("Later")
    assert len(got.encode()) <= 1024
    # The first sentence has one new word in two; the richer one, 13 later, has all of its words new but fewer points for its place.
    points = lambda i, fresh, total: fresh * 256 // total + max(0, 64 - 4 * i)
    assert got.startswith("Later") == (points(20, 10, 10) > points(0, 3, 7))
    assert text.snippet("é" * 2000).encode().decode() and len(text.snippet("x" * 5000)) == 1024
    assert text.snippet(" " * 3000) is not None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.! ?\n", max_size=900))
def test_sentence_ends(raw):
    data = raw.encode()
    ends = text.sentence_ends(data).tolist()
    want, last = [], 0
    for i in range(len(data)):
        mark = i > 0 and data[i] == 32 and data[i - 1] in b".!?"
        if mark or data[i] == 32 and i - last >= 200:
            last = i + 1
            want.append(last)
    if last < len(data):
        want.append(len(data))
    assert ends == want
