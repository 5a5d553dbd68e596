"""Corpus pipeline: toxic documents go, then repeated lines, near copies and benchmark leaks; what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written and read again. Null and empty texts, null ids, repeated
rows and other columns, whatever their names, pass through every stage but the last, and an empty table stays empty with its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from quarry.llm import textops as X


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each by its own text; without labels of both classes none goes. The labels are those of sf_dir."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text. No document goes; rows with a null id keep their lines."""
    mine = {c: name for c, name in zip(("n_lines", "n_dropped"), X.fresh(docs, 2), strict=True) if c in docs.columns}  # columns of that name are the documents'
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(mine))
    size = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(mine.get(c, c)).alias(c) for c in docs.columns])


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; documents without words and rows with a null id all stay, repeated rows once."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. The items are those of sf_dir; without any, no document goes."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the SHA-256 of the decoded bytes of every row; a null text has no ids."""
    return bpe.tokens(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's rows are written to the shared scratch folder and read again."""
    docs, folder = X.documents(spark, sf_dir), line_dedup.scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
