"""Registered queries of the corpus operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.bpe import op3_bpe
from quarry.llm.decontamination import op8_decontamination
from quarry.llm.fingerprints import op9_fingerprints
from quarry.llm.jaccard_join import op2_jaccard_join
from quarry.llm.line_dedup import OP6_SQL, op6_line_dedup
from quarry.llm.quality import op5_quality
from quarry.llm.sentence_spans import op7_sentence_spans
from quarry.llm.suffix_dedup import op4_suffix_dedup
from quarry.llm.token_counts import op1_token_counts
from quarry.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_jaccard_join, op3_bpe, op4_suffix_dedup, op5_quality, op6_line_dedup, op7_sentence_spans, op8_decontamination, op9_fingerprints, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL}
