"""Operator 1: exact token counts at every prefix.

For each distinct pre-token a dynamic program over its bytes stores how many tokens each prefix has: the last token of a prefix is the one
whose pair with the last token before it survives the merges, and there is exactly one. A document's prefix counts are the running sums over
its pre-tokens and, inside one, that pre-token's own prefix counts, so truncation and budget questions are lookups. Only where a cut makes other pre-tokens of
the text before it (in white space after white space, in an apostrophe's ending, in an added token) are those few encoded anew."""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import textops as X
from quarry.llm.pretoken import split

#: Pre-tokens whose counts a worker keeps.
KEPT = 300_000
#: The encoding of a prefix differs from that of the whole text in no more pre-tokens than these, its last ones.
BACK = 4
#: Pre-tokens whose first two characters are two pre-tokens where the text ends there.
ENDINGS = {"'re", "'ve", "'ll"}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Counts of a byte-level BPE tokenizer file (.json). Added tokens inside a text count as one each, as the library has it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer, prefix space or ignored merges is counted here")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        added = {t["content"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in white space aren't supported")
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in added}
        self.rank = {tuple(map(raw, m if isinstance(m, list) else m.split(" "))): i for i, m in enumerate(spec["model"]["merges"])}
        self.ends = {t[i:] for t in self.vocab for i in range(len(t))}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.total: dict[str, int] = {}
        self.inner: dict[str, Sequence[int]] = {}

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stood at one end of a token (side 1: the right end) while it was merged, each with the rank of the merge that took it."""
        if (found := self.spines.get((token, side))) is None:
            found, part, until = [], token, 1 << 60
            while True:
                found.append((part, until))
                if len(part) == 1:
                    break
                until = self.rank[self.halves[part]]
                part = self.halves[part][side]
            self.spines[token, side] = found
        return found

    def together(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of left + right is these two tokens: no merge across the border came up while both its parts stood there.
        Of two equal merges the one further left goes first."""
        if (ok := self.pairs.get((left, right))) is None:
            rank, ok = self.rank.get, True
            others = self.spine(right, 0)
            for a, until_a in self.spine(left, 1):
                for b, until_b in others:
                    if (r := rank((a, b))) is not None and r < until_a and r <= until_b:
                        ok = False
            if len(self.pairs) > 4 * KEPT:
                self.pairs.clear()
            self.pairs[left, right] = ok
        return ok

    def prefixes(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """For each of the pre-tokens, in byte order: the tokens of each of its prefixes, from the empty one on. What a pre-token shares with
        the one before it is not worked out again. The lists are only valid until the next."""
        vocab, ends, together = self.vocab, self.ends, self.together
        last: list[bytes] = [b""]
        at = [0]
        before = b""
        for data in pieces:
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same + 1 :], at[same + 1 :]
            for i in range(same + 1, len(data) + 1):
                j, found = i - 1, []
                while j >= 0 and (t := data[j:i]) in ends:
                    if t in vocab:
                        found.append(j)
                    j -= 1
                for j in reversed(found):
                    t = data[j:i]
                    if not j or together(last[j], t):
                        last.append(t)
                        at.append(at[j] + 1)
                        break
            before = data
            yield at

    def learn(self, pieces: set[str], inner: bool = False) -> None:
        """inner: also the counts of all their prefixes, which whole texts' totals don't need."""
        if len(self.total) > KEPT:
            self.total, self.inner = {}, {}  # not cleared: within() goes on reading the counts that its texts need, also after a cut has learned more
        new = sorted((w.encode(), w) for w in pieces - (self.inner if inner else self.total).keys())
        for (_, w), at in zip(new, self.prefixes([d for d, _ in new]), strict=True):
            self.total[w] = at[-1]
            if inner:
                self.inner[w] = bytes(at) if len(at) <= 256 else array("I", at)

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens in order; True: an added token."""
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                yield part, True
            else:
                yield from ((w, False) for w in split(part))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        return [n for n, _ in self.within(texts)]

    def within(self, texts: list[str], budget: int | None = None) -> list[tuple[int, int]]:
        """Tokens of each text, and the bytes of its longest prefix with at most budget tokens (-1 without a budget). The texts' new pre-tokens are worked out together.

        The prefix is read from the running sums and, inside a pre-token, from the stored counts of its prefixes."""
        parts = [[split(p) for p in (self.added.split(t)[::2] if self.added and self.added.search(t) else [t])] for t in texts]
        self.learn({w for p in parts for found in p for w in found})
        of, out = self.total.__getitem__, []
        for text, p in zip(texts, parts, strict=True):
            if budget is None:
                out.append((len(p) - 1 + sum(sum(map(of, found)) for found in p), -1))
            elif len(p) > 1:  # added tokens inside
                n = len(p) - 1 + sum(sum(map(of, found)) for found in p)
                out.append((n, len(text.encode()) if n <= budget else self.cut(text, budget)))
            else:
                sums = list(accumulate(map(of, p[0]), initial=0))
                out.append((sums[-1], len(text.encode()) if sums[-1] <= budget else self._cut_near(p[0], sums, budget)))
        return out

    def _cut_near(self, found: list[str], sums: list[int], budget: int) -> int:
        """cut() from the pre-tokens around the budget alone."""
        a, b = max(0, bisect_right(sums, budget) - 1 - 4 * BACK), bisect_right(sums, budget) + 2 * BACK
        some = found[a:b]
        at = list(accumulate((len(w.encode()) for w in some), initial=0))
        return len("".join(found[:a]).encode()) + self._cut("".join(some).encode(), at, sums[a : a + len(at)], budget)

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Byte offset of each pre-token's end, and the tokens up to there; both begin with 0."""
        at, counts = [0], [0]
        for w, whole in self.pieces(text):
            at.append(at[-1] + len(w.encode()))
            if not whole and w not in self.inner:
                self.learn({w}, inner=True)
            counts.append(counts[-1] + (1 if whole else self.total[w]))
        return at, counts

    def count_at(self, text: str, n_bytes: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of the first n_bytes bytes (cut back to a whole code point), as encoding that prefix alone gives them.

        Looked up; encoded are only pre-tokens that the cut changes."""
        at, counts = table or self.table(text)
        return self._count_at(text.encode(), n_bytes, at, counts)

    def _count_at(self, data: bytes, n_bytes: int, at: list[int], counts: list[int]) -> int:
        n_bytes = max(0, min(n_bytes, len(data)))
        while n_bytes < len(data) and data[n_bytes] & 0xC0 == 0x80:
            n_bytes -= 1
        k = bisect_right(at, n_bytes) - 1
        piece = lambda i: data[at[i] : at[i + 1]].decode()
        if at[k] == n_bytes:
            blank = k > 1 and piece(k - 1).isspace() and piece(k - 2).isspace()
            if not blank:
                return counts[k]
        else:
            whole, part = piece(k), data[at[k] : n_bytes].decode()
            blank = k > 0 and part.isspace() and piece(k - 1).isspace()
            added = self.added and self.added.fullmatch(whole)
            if not (blank or added or whole in ENDINGS and len(part) > 1):
                if whole not in self.inner:
                    self.learn({whole}, inner=True)
                return counts[k] + self.inner[whole][n_bytes - at[k]]
        k = max(0, k - 1)
        while k and piece(k).isspace():
            k -= 1
        return counts[k] + self.count(data[at[k] : n_bytes].decode())

    def cut(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix of whole code points with at most budget tokens. Counts aren't monotone: a prefix may fit behind one that doesn't."""
        return self._cut(text.encode(), *self.table(text), budget)

    def _cut(self, data: bytes, at: list[int], counts: list[int], budget: int) -> int:
        # count_at() counts anew from BACK pre-tokens before the cut at most, so a prefix behind this bound has more tokens than the budget.
        start = bisect_right(counts, budget - 1) - 1
        low, ends = at[max(0, bisect_right(counts, budget) - 1 - BACK)], at[min(len(at) - 1, start + BACK + 1)]
        for c in reversed(data[low:ends].decode()):
            if self._count_at(data, ends, at, counts) <= budget:
                return ends
            ends -= len(c.encode())
        return low


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and limit_bytes (the longest prefix of at most limit tokens) of every row. A null text is empty and has no token; texts of any
    length are counted whole; repeated rows and null ids give a row each; an empty table gives none; other columns are left out, whatever their names.
    path: of the tokenizer file on the workers; by default that of the public tokenizers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path or tokenizer_path("byte_bpe_50k.json"))
        n: list[tuple[int, int]] = []
        for a, b in X.steps(X.flat(batch.column(1))[1], 2 << 20):
            n += c.within([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], limit)
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
        columns = [batch.column(0), size, pa.array([x for x, _ in n], pa.int64()), pa.array([x > limit for x, _ in n]), pa.array([x for _, x in n], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    return X.map_arrow(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long")


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ends, counts: the running sums of every row at the ends of its pre-tokens, both from 0 (of a null or empty text that alone); repeated rows and null ids give a row each. Counts inside a pre-token are the same in every text: PrefixCounter.inner."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path or tokenizer_path("byte_bpe_50k.json"))
        both = [c.table(t or "") for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in both], kind), pa.array([n for _, n in both], kind)], ["doc_id", "ends", "counts"])

    return X.map_arrow(docs.select("doc_id", "text"), work, "doc_id long, ends array<long>, counts array<long>")


def truncate(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id and text of every row, cut to its longest prefix within the budget of tokens; a null text stays null, an empty one empty, and one within the budget whole."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(path or tokenizer_path("byte_bpe_50k.json"))
        texts = [None if t is None else t.encode()[: c.cut(t, budget)].decode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return X.map_arrow(docs.select("doc_id", "text"), work, "doc_id long, text string")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' counts; the cases are those of count_tokens()."""
    return count_tokens(X.documents(spark, sf_dir))
