"""Operator 10: toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X

#: Lengths of the character n-grams.
GRAMS = (3, 4, 5, 6)
#: Bound of the training sample: so many rows of each class, and textops.SAMPLE_BYTES of them.
PER_CLASS = 1000
#: An n-gram counts if this share of the rarer class's rows in the sample hold it, LEAST rows at least, and if its log-count ratio is so many times its standard
#: error. However many n-grams that gives, all have a weight: what is left out can't be told from chance.
SUPPORT_SHARE, LEAST, ERRORS = 0.01, 2, 1.5
#: Bits of the table that tells most other n-grams from those that count.
FILTER_BITS = 20
#: Bytes of text that are scored at once; a longer text is scored at once by itself.
STEP = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and 64-bit hash of every n-gram, one length after another; keep: flags of the hashes' first bits, others are left out."""
    points, at = X.characters(data, offsets)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    h = points
    for n in range(2, max(GRAMS) + 1):
        if len(points) < n:
            return
        h = h[:-1] * X.BASE + points[n - 1 :]
        if n in GRAMS:
            full = (h + np.uint64(n)) * X.MIX_A
            use = np.arange(len(full)) if keep is None else np.flatnonzero(keep[full >> np.uint64(64 - FILTER_BITS)])
            use = use[owner[use] == owner[use + n - 1]]
            yield owner[use], full[use]


def holders(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts, in order, and how many texts hold each."""
    found = [np.zeros(0, np.uint64)]
    for text in texts:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        own = [h for _, h in grams(data, np.array([0, len(data)]))]
        if own:
            found.append(np.unique(np.concatenate(own)))
    every = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, int)
    return every[first], np.diff(np.append(first, len(every)))


@dataclass
class NaiveBayesLinear:
    """keys: the n-grams that count, in order of their hashes; weights: naive Bayes ratio times learnt coefficient."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        head = (self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        self.keep = np.zeros(1 << FILTER_BITS, bool)
        self.keep[head] = True
        # Keys with the same first bits stand next to each other: where they begin, and how many there are at most.
        self.first = np.searchsorted(head, np.arange(1 << FILTER_BITS)).astype(np.int32)
        self.most = int(np.bincount(head).max(initial=0)) if len(head) else 0

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Of each row the places in keys of its n-grams that count, each once."""
        n, parts = len(offsets) - 1, []
        for row, h in grams(data, offsets, self.keep):
            at = self.first[h >> np.uint64(64 - FILTER_BITS)].astype(np.int64)
            for _ in range(self.most - 1):  # to the next key with these bits, if this one isn't it
                at += (self.keys[at] < h) & (at + 1 < len(self.keys))
            ok = self.keys[at] == h if len(h) else np.zeros(0, bool)
            row, at = row[ok], at[ok]
            parts.append((at, np.searchsorted(row, np.arange(n + 1)).tolist()))
        last = np.empty(max(len(self.keys), 1), np.int64)
        for i in range(n):
            own = np.concatenate([at[e[i] : e[i + 1]] for at, e in parts]) if parts else np.zeros(0, np.int64)
            order = np.arange(len(own))
            last[own] = order
            yield own[last[own] == order]

    @classmethod
    def fit(cls, texts: list[str], y: list[int], rounds: int = 150, l2: float = 1e-2) -> NaiveBayesLinear:
        """Without rows of both classes the score is the same for all texts: the share of label 1, smoothed towards a third; if no n-gram counts, it is a third."""
        target = np.asarray(y, np.float64)
        share = (target.sum() + 1) / (len(target) + 3)
        none = np.zeros(0, np.uint64)
        if not len(target) or target.min() == target.max():
            return cls(none, np.zeros(0), float(np.log(share / (1 - share))))
        one, zero = target.sum(), len(target) - target.sum()
        toxic, n_toxic = holders([t for t, k in zip(texts, y, strict=True) if k])
        clean, n_clean = holders([t for t, k in zip(texts, y, strict=True) if not k])
        keys = np.union1d(toxic, clean)
        p, q = np.zeros(len(keys)), np.zeros(len(keys))
        p[np.searchsorted(keys, toxic)] = n_toxic
        q[np.searchsorted(keys, clean)] = n_clean
        ratio = np.log((p + 1) / (one + 2)) - np.log((q + 1) / (zero + 2))
        counts = (p + q >= max(LEAST, int(SUPPORT_SHARE * min(one, zero)))) & (np.abs(ratio) >= ERRORS * np.sqrt(1 / (p + 1) + 1 / (q + 1)))
        ratio = ratio[counts]
        if not len(ratio):
            return cls(none, np.zeros(0), float(np.log(0.5)))
        model = cls(keys[counts], np.zeros(len(ratio)), 0.0)
        found = [next(model.found(data, np.array([0, len(data)]))) for data in (np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts)]
        row, f = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate(found)
        value, n = ratio[f], len(ratio)
        # Each class counts as much as in the sample; the mean of the two keeps the decision between them.
        weight = np.where(target == 1, 0.5 / one, 0.5 / zero)
        w, b, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, rounds + 1):
            score = np.bincount(row, value * w[f], len(target)) + b
            error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target)
            grad = np.append(np.bincount(f, value * error[row], n) + l2 * w, error.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
        return cls(model.keys, ratio * w, float(b))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b in X.steps(offsets, STEP):
            out[a:b] = [self.weights[f].sum() for f in self.found(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> NaiveBayesLinear:
    sample = X.training_rows(docs, labels, "toxic", per_class)
    return NaiveBayesLinear.fit([t for t, _ in sample], [y for _, y in sample])


def likeliness(text: Column, model: NaiveBayesLinear) -> Column:
    """The score of a text as a column: the text alone goes to Python, the number alone comes back. Null is empty."""
    keys, weights, bias = model.keys, model.weights, model.bias

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = NaiveBayesLinear(keys, weights, bias)
        for texts in batches:
            yield pa.array(model.score(*X.flat(texts)))
        X.hand_back()

    return scored(text)


def score(docs: DataFrame, model: NaiveBayesLinear, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts have no n-gram and get the bias's score; texts of any length are scored whole; equal
    texts have equal scores; repeated rows and null ids give a row each; an empty table gives none; other columns are left out, whatever their names."""
    rows = docs.select("doc_id", X.held_out().alias("held_out"), likeliness(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores by a model of the labels that aren't held out; the cases are those of score()."""
    docs = X.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that the classifier doesn't reject, with their columns, whatever their names; each row by its own text, so repeated rows go or stay together. Without
    labels of both classes no row goes."""
    return docs.where(likeliness(F.col("text"), fit(docs, labels)) < threshold)
