"""Operator 3: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are taken in chunks, once. A chunk explodes into its distinct pre-tokens, and keeps of its documents the places of those words in order.
The words of all chunks are shuffled by the word's hash, packed into one row for each chunk and bucket, so that each distinct word of the corpus is encoded once; the ids go
back to their chunks, where the documents are put together by position. Decoding joins every id with its row of the token-byte table, whose key is the row's number."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import textops as X
from quarry.llm.pretoken import PATTERN, split
from quarry.llm.token_counts import tokenizer_path

#: Bytes of text that share a dictionary of words; a longer document is a chunk of its own.
CHUNK_BYTES = 24 << 20
#: Words whose ids a worker keeps, and words of documents that are put together at once; the latter take about 100 bytes each meanwhile.
KEPT, STEP = 1_000_000, 1 << 17


@lru_cache(2)
def codec(path: str) -> tuple[tiktoken.Encoding, pa.BinaryArray]:
    """The encoder of a rank file, and the token-byte table: row i holds the bytes of id i, null if there is no such id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), pa.array(table, pa.large_binary())


def token_bytes(ids: np.ndarray, table: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids one after another, and where each begins (one more entry for the end); an id without a row has none."""
    known = (ids >= 0) & (ids < len(table))
    return X.flat(table.take(pa.array(np.where(known, ids, 0), mask=~known)))


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """Parts of a batch of (doc_id, text), each with a key: a hash of its rows, and of the task's number and the part's, as equal parts are different chunks."""
    _, offsets = X.flat(batch.column(1))
    for a, b in X.steps(offsets, CHUNK_BYTES):
        part = batch.slice(a, b - a)
        key = hashlib.blake2b(repr((TaskContext.get().partitionId(), part.column(0).to_pylist())).encode(), digest_size=16)
        data, where = X.flat(part.column(1))
        key.update(where)
        key.update(data)
        yield key.digest(), part


def numbered(part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a chunk, the most frequent first, all rows' pre-tokens as their places in that list, and where each row's begin (one more entry for the end)."""
    place: dict[str, int] = {}
    steps, sizes, counts = [], [0], np.zeros(0, np.int64)
    for a, b in X.steps(X.flat(part.column(1))[1], 1 << 20):
        rows = []
        for text in part.column(1).slice(a, b - a).to_pylist():
            found = split(text or "")
            for w in found:
                if w not in place:
                    place[w] = len(place)
            rows.append(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)))
            sizes.append(len(found))
        steps.append(np.concatenate(rows))
        more = np.bincount(steps[-1], minlength=len(place))
        more[: len(counts)] += counts
        counts = more
    by = np.argsort(-counts, kind="stable")
    rank = np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    begins = np.cumsum(sizes)
    places, at = np.empty(begins[-1], np.uint32), 0
    for some in steps:
        np.take(rank, some, out=places[at : at + len(some)])
        at += len(some)
    words = list(place)
    return [words[i] for i in by], places, begins


def pack(places: np.ndarray) -> bytes:
    """Small numbers in few bytes: 7 bits a byte from the low end, the high bit set on all but the last."""
    if not len(places):
        return b""
    x = places.astype(np.uint32)
    n = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(n.max())):
        has = n > k
        out[at[:-1][has] + k] = ((x[has] >> (7 * k)) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        has = first + k <= last
        out[has] |= (raw[first[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def unpacked_words(data: bytes) -> list[bytes]:
    """The words of a blob: their number, their sizes, then themselves."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)  # no byte of a word is looked at: the sizes come first
    n = int(unpack(data[: last[0] + 1])[0])
    head = int(last[n]) + 1
    at = np.concatenate([[0], np.cumsum(unpack(data[:head])[1:])]) + head
    return [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte plane by byte plane, compressed."""
    raw = np.ascontiguousarray(numbers.astype(np.uint32, copy=False).view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True)


def from_planes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.uint32).ravel()


def gathered(flat: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[at[p] : at[p + 1]] for each of places, one after another, and where each begins (one more entry for the end)."""
    size = np.diff(at)[places]
    ends = np.cumsum(size)
    begins = np.append(0, ends)
    return flat[np.repeat(at[:-1][places] - begins[:-1], size) + np.arange(begins[-1])], begins


#: From some rows' doc_ids, their ids one after another, where each row's begin and the token-byte table: the columns of the result.
Finish = Callable[[pa.Array, np.ndarray, np.ndarray, pa.BinaryArray], list]


def encoded(docs: DataFrame, finish: Finish, schema: str, path: str | None = None) -> DataFrame:
    """One row for each row of docs: what finish makes of some rows' doc_ids, their ids one after another, where each row's begin, and the token-byte table."""
    name = "byte_bpe_50k.tiktoken"
    rows = docs.select("doc_id", "text")
    buckets = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 65536)
    names = ["bucket", "chunk", "data", "more"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for key, part in chunks(batch):
                key, number = key + number.to_bytes(4, "little"), number + 1
                distinct, places, begins = numbered(part)
                found = [w.encode() for w in distinct]
                of = np.fromiter((zlib.crc32(w) for w in found), np.int64, len(found)) % buckets
                by = np.argsort(of, kind="stable")
                edge = np.searchsorted(of[by], np.arange(buckets + 1))
                # The chunk's own row: the bucket of each word, to find its ids again, and its rows.
                table = pa.table({"doc_id": part.column(0), "words": pa.array(np.diff(begins))})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
                head = sink.getvalue().to_pybytes()
                to, blobs, more = [int.from_bytes(key[:4], "little") % buckets], [planes(of)], [len(head).to_bytes(8, "little") + head + planes(places)]
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    own = [found[i] for i in by[edge[k] : edge[k + 1]].tolist()]
                    to.append(k)
                    blobs.append(zlib.compress(pack(np.array([len(own), *map(len, own)])) + b"".join(own), 1))
                    more.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([key] * len(to), pa.binary()), pa.array(blobs, pa.binary()), pa.array(more, pa.binary())], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All words of a bucket are in one partition, so the ids of each are found once (again only if there are more than KEPT)."""
        known: dict[bytes, tuple[int, ...]] = {}
        one = codec(path or tokenizer_path(name))[0]._encode_single_piece
        for batch in batches:
            out = []
            for own, data in zip(batch.column("more").is_valid().to_pylist(), batch.column("data").to_pylist(), strict=True):
                if not own:
                    found = unpacked_words(zlib.decompress(data))
                    if len(known) > KEPT:
                        known.clear()
                    for w in found:
                        if w not in known:
                            known[w] = tuple(one(w))
                    got = [known[w] for w in found]
                    data = zlib.compress(np.fromiter(map(len, got), np.uint32, len(got)).tobytes() + np.fromiter((i for g in got for i in g), np.uint32).tobytes(), 1)
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("chunk"), pa.array(out, pa.binary()), batch.column("more")], names)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a chunk, STEP words at a time; what they took goes back before the next chunk."""
        yield from assembled(pa.Table.from_batches(batches))
        X.hand_back()

    def assembled(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        table = codec(path or tokenizer_path(name))[1]
        mine = chunk.filter(chunk.column("more").is_valid())
        if mine.num_rows != 1:
            raise ValueError("a chunk was read twice with different rows")
        own = mine.column("more")[0].as_py()
        cut = 8 + int.from_bytes(own[:8], "little")
        rows, places, of = pa.ipc.open_stream(own[8:cut]).read_all(), from_planes(own[cut:]), from_planes(mine.column("data")[0].as_py())
        by = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[by], np.arange(buckets + 1))
        rest = chunk.filter(chunk.column("more").is_null())
        size, ids = np.zeros(len(of), np.int64), []
        for k, blob in sorted(zip(rest.column("bucket").to_pylist(), rest.column("data").to_pylist(), strict=True)):
            got = np.frombuffer(zlib.decompress(blob), np.uint32)
            n = edge[k + 1] - edge[k]
            size[by[edge[k] : edge[k + 1]]] = got[:n]
            ids.append(got[n:])
        # Word ids lie in the order of buckets; where each word's begin.
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        first = np.empty(len(of), np.int64)
        first[by] = np.cumsum(size[by]) - size[by]
        begins = np.append(0, np.cumsum(rows.column("words").to_numpy()))
        for a, b in X.steps(begins, STEP):
            words = places[begins[a] : begins[b]]
            n = size[words]
            ends = np.append(0, np.cumsum(n))
            some = flat[np.repeat(first[words] - ends[:-1], n) + np.arange(ends[-1])].astype(np.int64)
            doc_ids = rows.column("doc_id").slice(a, b - a).combine_chunks()
            yield pa.RecordBatch.from_arrays(finish(doc_ids, some, ends[begins[a : b + 1] - begins[a]], table), [f.split()[0] for f in schema.split(", ")])

    dealt = rows.mapInArrow(X.frugal(words), "bucket int, chunk binary, data binary, more binary").repartitionById(buckets, "bucket")
    return dealt.mapInArrow(X.frugal(encode), "bucket int, chunk binary, data binary, more binary").groupBy("chunk").applyInArrow(assemble, schema)


@lru_cache(2)
def spelled_ids(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id below n as text with a space behind it, one after another, and where each begins (one more entry for the end)."""
    text = np.frombuffer(b"".join(b"%d " % i for i in range(n)), np.uint8)
    return text, np.append(0, np.flatnonzero(text == 32) + 1)


def lists(ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int32)))


def decoded_digests(ids: np.ndarray, begins: np.ndarray, table: pa.BinaryArray) -> pa.Array:
    """SHA-256 of the bytes that each row's ids decode to."""
    data, at = token_bytes(ids, table)
    at = at[begins].tolist()
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every row. Null and empty texts have no ids; texts of any length are encoded whole; repeated rows and null doc_ids give a row each; an
    empty table gives none; other columns are left out, whatever their names."""
    return encoded(docs, lambda doc_ids, ids, begins, _: [doc_ids, lists(ids, begins)], "doc_id long, ids array<int>", path)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes that ids stand for, of every row; null ids give no bytes, and neither does an id that is null or not in the table."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = codec(path or tokenizer_path("byte_bpe_50k.tiktoken"))[1]
        given = batch.column(1)
        size = pa.compute.fill_null(pa.compute.list_value_length(given), 0).to_numpy(zero_copy_only=False)
        data, at = token_bytes(pa.compute.fill_null(given.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64), table)
        at = at[np.append(0, np.cumsum(size))].tolist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "data"])

    return X.map_arrow(tokens.select("doc_id", "ids"), work, "doc_id long, data binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as text and of the bytes that they decode to, for every row; the cases are those of encode()."""

    def finish(doc_ids, ids, begins, table):
        shown, where = gathered(*spelled_ids(len(table)), ids)  # a row's last space doesn't count
        where = where[begins].tolist()
        spelled = [hashlib.sha256(shown[a : max(a, b - 1)]).hexdigest() for a, b in zip(where, where[1:], strict=False)]
        return [doc_ids, pa.array(np.diff(begins)), pa.array(spelled, pa.string()), decoded_digests(ids, begins, table)]

    return encoded(docs, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the bytes that they decode to, for every row; the cases are those of encode()."""

    def finish(doc_ids, ids, begins, table):
        return [doc_ids, pa.array(np.diff(begins)), lists(ids, begins), decoded_digests(ids, begins, table)]

    return encoded(docs, finish, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", path)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' digests; the cases are those of encode()."""
    return digests(X.documents(spark, sf_dir))
