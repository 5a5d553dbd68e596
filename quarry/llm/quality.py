"""Operator 5: quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of its neighbours; the documents' score is the mean of the lines'
forward-backward marginals, weighted by their length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import textops as X

#: Bound of the training sample: so many rows of each class, and textops.SAMPLE_BYTES of them.
PER_CLASS = 1000
#: How much of a good row's text is good, and of a bad one's bad.
MOSTLY = 0.95
#: Byte classes of which a line's shares are features.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"", b"!?", b"%#&$*@^~=+", b"|", b"<>{}[]()/\\_", X.SPACES]
#: Features of a line by itself; then come those of the line before and after, whether there is one, and a constant.
N_OWN = len(CLASSES) + 5


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and its row. A row has one line more than line feeds; an empty row has one empty line."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, feeds, "right") - 1
    start, row = np.concatenate([offsets[:-1], feeds + 1]), np.concatenate([np.arange(n), of])
    end, end_row = np.concatenate([feeds, offsets[1:]]), np.concatenate([of, np.arange(n)])
    by, by_end = np.lexsort((start, row)), np.lexsort((end, end_row))
    return start[by], end[by_end], row[by]


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with its neighbours', its row, and its length in bytes."""
    start, end, row = line_bounds(data, offsets)
    size = (end - start).astype(np.float64)

    def sums(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return (total[end] - total[start]).astype(np.float64)

    w_start, w_end, _ = X.words(data, np.unique(np.concatenate([start, [len(data)]])))
    hashes = X.span_hashes(data, w_start, w_end)
    is_word, repeat = np.zeros(len(data), bool), np.zeros(len(data), bool)
    is_word[w_start] = True
    repeat[w_start[1:][hashes[1:] == hashes[:-1]]] = True
    n_words = np.maximum(sums(is_word), 1)
    safe = np.maximum(size, 1)
    own = [sums(np.isin(data, np.frombuffer(c, np.uint8))) / safe for c in CLASSES]
    own += [sums(data >= 128) / safe, sums(repeat) / n_words, np.minimum(size / n_words, 40) / 10, np.log1p(size) / 5, (size == 0).astype(np.float64)]
    own = np.stack(own, 1)
    same = row[1:] == row[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    edge = np.stack([np.append(True, ~same), np.append(~same, True)], 1).astype(np.float64)
    return np.hstack([own, before, after, edge, np.ones((len(own), 1))]), row, size


@dataclass
class LineCrf:
    """weights: of the features, for good against bad; turn: transition scores [from][to], 0 bad and 1 good; centre, scale: of the features."""

    weights: np.ndarray
    turn: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def marginals(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance that each line is good, and the chances of each pair of neighbours [from][to], summed over all pairs."""
        unary = ((x - self.centre) / self.scale) @ self.weights
        unary = np.clip(np.stack([np.zeros_like(unary), unary], 1), -60, 60)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        count = np.diff(np.append(first, len(row)))
        by = np.argsort(-count, kind="stable")  # the longest first: those still running are always the front ones
        first, count = first[by], count[by]
        alpha, beta, turn = unary.copy(), np.zeros_like(unary), np.zeros((2, 2))
        running = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")
        for t in range(1, len(running)):
            at = first[: running[t]] + t
            alpha[at] += np.logaddexp(alpha[at - 1, :1] + self.turn[0], alpha[at - 1, 1:] + self.turn[1])
        for t in range(len(running) - 1, 0, -1):
            at = first[: running[t]] + t
            ahead = unary[at] + beta[at]
            beta[at - 1] = np.logaddexp(ahead[:, :1] + self.turn[:, 0], ahead[:, 1:] + self.turn[:, 1])
        total = alpha + beta
        inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, int)
        norm = np.logaddexp(total[:, 0], total[:, 1])
        for i in (0, 1):
            for j in (0, 1):
                turn[i, j] = np.exp(np.minimum(alpha[inner, i] + self.turn[i, j] + unary[inner + 1, j] + beta[inner + 1, j] - norm[inner], 0)).sum()
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -60, 60))), turn

    @classmethod
    def fit(cls, texts: list[str], y: list[int], rounds: int = 120, l2: float = 1e-4) -> LineCrf:
        """A row's label is that of most of its text, not of every line. A model of lines alone, by their own features, is fitted first, each line with its row's label.
        What it makes of the lines, moved row by row so far that the share of good text is MOSTLY in a good row and the rest of it in a bad one, is what the
        chain learns: so it sees lines of both kinds beside each other. Each class has the same weight, each row the same in its class. Without rows of both classes every text
        gets the same score."""
        data, offsets = X.flat(pa.array([*texts, ""], pa.large_string()))
        parts = [line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) + (a,) for a, b in X.steps(offsets)]
        x, row, size = np.vstack([p[0] for p in parts]), np.concatenate([p[1] + p[3] for p in parts]), np.concatenate([p[2] for p in parts])
        use = row < len(texts)
        x, row, size = x[use], row[use], np.maximum(size[use], 1e-9)
        centre, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        centre[-1], scale[-1] = 0, 1
        model = cls(np.zeros(x.shape[1]), np.zeros((2, 2)), centre, scale)
        target = np.asarray(y, np.float64)
        if not len(target) or target.min() == target.max():
            model.weights[-1] = 0 if not len(target) else (3 if target.max() else -3)
            return model
        of_class = np.where(target == 1, 0.5 / target.sum(), 0.5 / (len(target) - target.sum()))
        share = size / np.bincount(row, size, len(target))[row]
        weight = (of_class / np.bincount(row, minlength=len(target)))[row]
        alone = x.copy()
        around = slice(N_OWN, 3 * N_OWN + 2)
        alone[:, around] = centre[around]
        model._descend(alone, row, target[row], weight, rounds, l2, False)
        truth = _moved(model.marginals(alone, row)[0], row, share, np.where(target == 1, MOSTLY, 1 - MOSTLY))
        model._descend(x, row, truth, weight, rounds, l2, True)
        return model

    def _descend(self, x: np.ndarray, row: np.ndarray, truth: np.ndarray, weight: np.ndarray, rounds: int, l2: float, chained: bool) -> None:
        """truth: how likely each line is good; weight: of each line, 1 in all; chained: the transitions are learnt too."""
        inner = np.flatnonzero(row[1:] == row[:-1])
        both = np.stack([1 - truth, truth], 1)
        seen = both[inner].T @ both[inner + 1]
        z = (x - self.centre) / self.scale
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for t in range(1, rounds + 1):
            good, turn = self.marginals(x, row)
            grad = np.append(z.T @ ((good - truth) * weight) + l2 * self.weights, ((turn - seen) / max(len(inner), 1) + l2 * self.turn).ravel())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            self.weights = self.weights - step[:-4]
            self.turn = self.turn - chained * step[-4:].reshape(2, 2)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b in X.steps(offsets):
            x, row, size = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            good, _ = self.marginals(x, row)
            size = np.maximum(size, 1e-9)
            out[a:b] = np.bincount(row, good * size, b - a) / np.bincount(row, size, b - a)
        return np.clip(out, 0, 1)


def _moved(good: np.ndarray, row: np.ndarray, share: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The lines' chances with each row's log odds moved alike, so that the mean over its text is the row's goal."""
    odds = np.log(np.clip(good, 1e-6, 1 - 1e-6) / np.clip(1 - good, 1e-6, 1))
    low, high = np.full(len(goal), -40.0), np.full(len(goal), 40.0)
    for _ in range(40):
        middle = (low + high) / 2
        less = np.bincount(row, share / (1 + np.exp(-(odds + middle[row]))), len(goal)) < goal
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return 1 / (1 + np.exp(-(odds + ((low + high) / 2)[row])))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LineCrf:
    sample = X.training_rows(docs, labels, "quality", per_class)
    return LineCrf.fit([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: LineCrf, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts are one empty line; texts of any length are scored whole; equal texts have equal scores; repeated rows
    and null ids give a row each; an empty table gives none; other columns are left out, whatever their names."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(*X.flat(batch.column(2)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", X.held_out().alias("held_out"), "text")
    return X.map_arrow(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' scores by a model of the labels that aren't held out; the cases are those of score()."""
    docs = X.documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
