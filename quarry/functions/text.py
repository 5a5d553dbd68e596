"""Text to terms: NFKC, lower case, CJK bigrams, admission classes, snippets. All but NFKC and snippets are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
WORD = r"\p{L}\p{Nd}\p{Mn}"
BINARY = "�"
#: A run of CJK, of one word's characters, or of undecodable ones.
RUNS = f"[{CJK}]+|[{WORD}&&[^{CJK}]]+|{BINARY}+"
#: A run of one word's characters in lower case; those that most words are of come first, as Java looks the general classes up one character at a time.
WORDS = f"[a-z0-9{WORD}]+"
#: Texts with none of these have no CJK and nothing undecodable: a test of a range, not of scripts.
HIGH = "[^\\x{0}-\\x{2e7f}]"
#: Limits of admission.
MAX_NUMBER, MAX_BYTES, REPEAT, BASE64_LEAST = 16, 64, 8, 24
MAX_POSITION = 65535
ADMITTED = ("word", "number", "cjk-bigram", "cjk-unigram")
DROPPED = ("drop-too-long", "drop-long-number", "drop-binary", "drop-base64", "drop-repeat")
#: Texts with none of these are their own NFKC form.
MAY_CHANGE = "[^\\x{0}-\\x{9f}\\x{a1}-\\x{a7}\\x{a9}\\x{ab}-\\x{ae}\\x{b0}\\x{b1}\\x{b6}\\x{b7}\\x{bb}\\x{bf}-\\x{131}\\x{134}-\\x{13e}\\x{141}-\\x{148}\\x{14a}-\\x{17e}]"
#: The same but for the marks of Latin-1 and what lies beyond, of which some are their own form too: two ranges are tried faster than eighteen.
MAY_CHANGE_AT_ALL = "[^\\x{0}-\\x{9f}\\x{c0}-\\x{131}]"


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def not_ascii(text: Column) -> Column:
    """Found by lengths alone, so the patterns below are tried on few texts."""
    return F.octet_length(text) > F.char_length(text)


def simple_lower(text: Column) -> Column:
    """Lower case rune by rune: no final sigma, one rune for the dotted capital I."""
    return F.when(not_ascii(text) & (text.contains("İ") | text.contains("Σ")), F.lower(F.translate(text, "İΣ", "iσ"))).otherwise(F.lower(text))


def normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text in NFKC. Only rows that may change go through Python."""
    t = F.col(text)
    change = F.coalesce(not_ascii(t) & t.rlike(MAY_CHANGE_AT_ALL) & t.rlike(MAY_CHANGE), F.lit(False))
    # One scan: the others go as nulls, which cost Python nothing.
    return df.withColumn(text, F.coalesce(nfkc(F.when(change, F.col(text))), F.col(text)))


def raw_tokens(text: Column) -> Column:
    """Array of all tokens in order, dropped ones too; the index of a token is its position."""
    found = F.regexp_extract_all(simple_lower(text), F.lit(RUNS), F.lit(0))
    cut = F.transform(
        found,
        lambda m: F.when(~m.rlike(f"^[{CJK}{BINARY}]"), F.array(m))
        .when(m.startswith(BINARY), F.array(F.lit(BINARY)))
        .when(F.char_length(m) == 1, F.array(m))
        .otherwise(F.transform(F.sequence(F.lit(1), F.char_length(m) - 1), lambda i: F.substring(m, i, F.lit(2)))),
    )
    plain = F.regexp_extract_all(simple_lower(text), F.lit(WORDS), F.lit(0))
    return F.when(not_ascii(text) & text.rlike(HIGH) & text.rlike(f"[{CJK}{BINARY}]"), F.flatten(cut)).otherwise(plain)


def term_class(term: Column) -> Column:
    """Admission class, in the order of the checks. A length that rules a pattern out is looked at first."""
    n = F.char_length(term)
    return (
        F.when(term == BINARY, "drop-binary")
        .when((n == 2) & term.rlike(f"^[{CJK}]{{2}}$"), "cjk-bigram")
        .when((n == 1) & term.rlike(f"^[{CJK}]$"), "cjk-unigram")
        .when(term.rlike("^[0-9]+$"), F.when(n > MAX_NUMBER, "drop-long-number").otherwise("number"))
        .when(F.octet_length(term) > MAX_BYTES, "drop-too-long")
        .when((n >= REPEAT) & term.rlike(f"(.)\\1{{{REPEAT - 1}}}"), "drop-repeat")
        .when((n >= BASE64_LEAST) & term.rlike("^[\\p{L}0-9]+$") & term.rlike("[0-9]") & term.rlike("\\p{L}"), "drop-base64")
        .otherwise("word")
    )


def tokenized(df: DataFrame, keys: list[str], text: str = "text", normal: bool = False) -> DataFrame:
    """keys, pos, term of every token. Positions count dropped tokens too. normal: the text is in NFKC already."""
    rows = df.select(*keys, F.col(text).alias("_text"))
    return (rows if normal else normalized(rows, "_text")).select(*keys, F.posexplode(raw_tokens(F.col("_text"))).alias("pos", "term"))


def positioned(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """tokenized() with the class of each."""
    return tokenized(df, keys, text).withColumn("class", term_class(F.col("term")))


def is_admitted(term: Column) -> Column:
    """Whether the class is one of ADMITTED. Short terms are, but for undecodable ones: every other drop needs REPEAT characters at least."""
    return (term != BINARY) & ((F.char_length(term) < REPEAT) | term_class(term).isin(*ADMITTED))


def admitted(df: DataFrame, keys: list[str], text: str = "text", normal: bool = False) -> DataFrame:
    return tokenized(df, keys, text, normal).where(is_admitted(F.col("term")))


#: Bytes after which a sentence without an end mark ends at a space.
SENTENCE_BYTES = 200


def sentence_ends(data: bytes) -> np.ndarray:
    """Where each sentence ends: behind a mark (. ! ?) and its space, and inside what is long without one at the first space from SENTENCE_BYTES on."""
    marked = np.array([m.end() for m in re.finditer(rb"[.!?] ", data)], np.int64)
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    edges = np.unique(np.append(marked, len(data)))
    begins = np.append(0, edges[:-1])
    soft = []
    for a, b in zip(*(x[edges - begins > SENTENCE_BYTES].tolist() for x in (begins, edges)), strict=True):
        own = blanks[np.searchsorted(blanks, a) : np.searchsorted(blanks, b - 1 if b < len(data) or b in marked else b)]
        while (k := int(np.searchsorted(own, a + SENTENCE_BYTES))) < len(own):
            a = int(own[k]) + 1
            soft.append(a)
    return np.unique(np.append(edges, soft)).astype(np.int64) if data else np.zeros(0, np.int64)


def snippet(text: str, most: int = 1024) -> str:
    """The text itself if it fits, else the best sentence and what follows it, in most bytes.

    Best: 256 times its share of words that no earlier sentence has, and 64 points for the first sentence, 4 fewer for each later one."""
    data = text.encode()
    if len(data) <= most:
        return text
    ends = sentence_ends(data)
    found = [(m.start(), m[0]) for m in re.finditer(rb"\S+", data)]
    of = np.searchsorted(ends, np.fromiter((i for i, _ in found), np.int64, len(found)), "right")
    first = np.fromiter({w: k for k, (_, w) in reversed(list(enumerate(found)))}.values(), np.int64)
    total, fresh = (np.bincount(x, minlength=len(ends)) for x in (of, of[first] if len(first) else of))
    points = np.where(total > 0, fresh * 256 // np.maximum(total, 1) + np.maximum(0, 64 - 4 * np.arange(len(ends))), -1)
    best = int(points.argmax())
    begin = int(ends[best - 1]) if best else 0
    last = max(best, int(np.searchsorted(ends, begin + most, "right")) - 1)
    return data[begin : min(int(ends[last]), begin + most)].decode("utf-8", "ignore")


@F.arrow_udf(StringType())
def snippets(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else snippet(t) for t in texts.to_pylist()], pa.string())


def bit_length_capped(n: Column, most: int) -> Column:
    """Bits that a count needs, 0 for 0, at most so many."""
    return F.least(F.when(n == 0, 0).otherwise(F.length(F.bin(n))), F.lit(most)).cast("int")
