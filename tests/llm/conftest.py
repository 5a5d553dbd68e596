from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, score double, t string, n_lines string, label string"

A = "the quick brown fox jumps over the lazy dog while seven wizards mix potions near the old stone bridge at dawn"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))

#: doc_id, text: nulls, empty and very long texts, ties, repeated rows, copies, odd characters.
EDGE = [
    (1, A),
    (2, A),
    (2, A),
    (3, A.replace("lazy", "sleepy")),
    (4, None),
    (5, ""),
    (None, "a row without an id keeps its whole text"),
    (None, None),
    (6, LONG),
    (7, "\n\n \n"),
    (8, "日本語 🎉 naïve café x<|endoftext|>"),
    (9, "a"),
    (10, "x" * 5000),
    (11, "A line that is repeated often\nown line eleven\nA line that is repeated often"),
    (12, "  a LINE that is repeated often \r\nown line twelve"),
    (13, LONG[:3000] + " new tail"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 0.5, "clash", "clash", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    return frame(spark, EDGE).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, []).cache()
