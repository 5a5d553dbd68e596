"""FNV-1a, simhash, fingerprints and small numeric encodings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: FNV-1a parameters; fixed.
FNV64_BASIS, FNV64_PRIME = 14695981039346656037, 1099511628211
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619
MASK32 = 0xFFFFFFFF
MASK64 = (1 << 64) - 1


def fnv64(data: bytes) -> int:
    h = FNV64_BASIS
    for b in data:
        h = (h ^ b) * FNV64_PRIME & MASK64
    return h


def _bytes(text: Column) -> Column:
    raw = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint"))


def fnv32(text: Column) -> Column:
    """32-bit FNV-1a as a BIGINT, without Python: each product stays below 2 ** 57."""
    step = lambda h, b: h.bitwiseXOR(b) * F.lit(FNV32_PRIME) % F.lit(1 << 32)
    return F.when(F.octet_length(text) == 0, F.lit(FNV32_BASIS)).otherwise(F.aggregate(_bytes(text), F.lit(FNV32_BASIS).cast("bigint"), step))


def fnv64_each(values: list[bytes]) -> np.ndarray:
    """fnv64 of every value: the longest first, one byte of all of them at a time."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    by = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    at, size = (np.cumsum(size) - size)[by], size[by]
    h = np.full(len(values), FNV64_BASIS, np.uint64)
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for k, m in enumerate(running.tolist()):
        h[:m] = (h[:m] ^ data[at[:m] + k]) * np.uint64(FNV64_PRIME)
    out = np.empty_like(h)
    out[by] = h
    return out


def simhash_each(texts: list[str]) -> np.ndarray:
    """Bit b is set if more of the whitespace tokens' FNV-1a hashes have it than not; repeated tokens vote again. Distinct tokens are hashed once."""
    place: dict[str, int] = {}
    found = []
    for text in texts:
        found.append([place.setdefault(t, len(place)) for t in text.split()])
    bits = np.unpackbits(fnv64_each([t.encode("utf-8", "replace") for t in place]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    out = np.zeros(len(texts), np.uint64)
    for i, tokens in enumerate(found):
        if tokens:
            own, times = np.unique(np.array(tokens), return_counts=True)
            ones = times.astype(np.float32) @ bits[own] if len(tokens) < 1 << 24 else times @ bits[own].astype(np.int64)
            out[i] = np.packbits(2 * ones > len(tokens), bitorder="little").view(np.uint64)[0]
    return out


def simhash(text: str) -> int:
    return int(simhash_each([text])[0])


@F.arrow_udf(LongType())
def simhash64(texts: pa.Array) -> pa.Array:
    """As a signed 64-bit number; a null text has none. A part of a batch at a time, so few tokens are held at once."""
    parts = [simhash_each([t or "" for t in texts.slice(a, 500).to_pylist()]) for a in range(0, len(texts), 500)]
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64), mask=texts.is_null().to_numpy(zero_copy_only=False))


#: Not to be worked out again where the plan refers to it twice.
simhash64 = simhash64.asNondeterministic()


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def fingerprint(text: Column) -> Column:
    """First 128 bits of SHA-256, as hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def global_docid(shard: Column, docid: Column) -> Column:
    return F.shiftleft(shard.cast("bigint"), 32).bitwiseOR(docid)


def split_docid(docid: Column) -> tuple[Column, Column]:
    return F.shiftright(docid, 32), docid.bitwiseAND(F.lit(MASK32))


def rfc3339_ms(date: Column) -> Column:
    """Milliseconds since 1970, 0 for what can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(date)), F.lit(0).cast("bigint"))


def remaining_us(budget: Column, elapsed: Column) -> Column:
    return F.greatest(F.least(budget - elapsed, F.lit(MASK32)), F.lit(0))


def days_since_2000(date: Column) -> Column:
    return F.datediff(date, F.lit("2000-01-01").cast("date"))


def object_key(seq: Column, width: int = 16) -> Column:
    return F.format_string(f"%0{width}d", seq)


def anchor_cut(anchor: Column, most: int = 256) -> Column:
    """At most so many bytes."""
    return F.substring(F.encode(anchor, "UTF-8"), 1, most)
