"""SQL names of the engine's functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import simhash64
from quarry.functions.text import nfkc, snippets
from quarry.functions.url import canonicalize_url


@F.udtf(returnType="pos INT, term STRING, class STRING")
class Tokens:
    """tokens(text): position, term and class of each token, for use in SQL; the built-in path in functions.text is the fast one."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        from quarry.functions.exact import classified

        yield from ((i, t, c) for i, (t, c) in enumerate(classified(text or "")))


def register(spark: SparkSession) -> None:
    spark.udf.register("canonicalize_url", canonicalize_url)
    spark.udf.register("simhash64", simhash64)
    spark.udf.register("nfkc", nfkc)
    spark.udf.register("snippet", snippets)
    spark.udtf.register("tokens", Tokens)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION url_fp(u STRING) RETURNS STRING RETURN substring(sha2(u, 256), 1, 32)")
