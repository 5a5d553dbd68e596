"""Fixed schemas, as DDL, and versions. Nothing is inferred: readers are given these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

URL_LAW_VERSION = 1
TOKENIZER_VERSION = 1

PAGE = (
    "urlfp BINARY, url STRING, fetch_ms BIGINT, status INT, flags BIGINT, sha256 BINARY, simhash BIGINT, lang INT, canon_fp BINARY, hdr BINARY, "
    "title STRING, text STRING, outlinks ARRAY<STRUCT<dst: BINARY, flags: INT, anchor: STRING>>, raw_ref STRUCT<seq: BIGINT, off: BIGINT, len: BIGINT>, law_ver INT"
)
LOG_RECORD = (
    "seq BIGINT, ord INT, writer BIGINT, incarnation BIGINT, batch_id BIGINT, kind STRING, unit BIGINT, node BIGINT, epoch BIGINT, deadline_ms BIGINT, "
    "partition BIGINT, man_seq BIGINT, watermark BIGINT, shard BIGINT, generation BIGINT, version BIGINT"
)
LEDGER = "urlfp BINARY, ts BIGINT, status INT, bytes BIGINT"
POSTING = "shard BIGINT, generation BIGINT, term STRING, docid BIGINT, tf INT, impact INT, mask INT, body_pos ARRAY<INT>, title_pos ARRAY<INT>"
GC_TOMBSTONE = "key STRING, reason INT, eligible_ms BIGINT"
DOCMAP = "urlfp BINARY, docid BIGINT, canon_fp BINARY, flags INT"

#: Most outlinks of a page, and bytes of an anchor.
MAX_OUTLINKS = 65535
MAX_ANCHOR = 256


def checked(df: DataFrame, ddl: str) -> DataFrame:
    """df with the schema's columns in order; an error if one is missing or of another type."""
    schema = StructType.fromDDL(ddl)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"missing columns or other types: {', '.join(wrong)}")
    return df.select(*schema.names)
