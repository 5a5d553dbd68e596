"""Operator 2: n-gram Jaccard join by grouped prefixes.

Words are shingled. A shingle that only one set of the corpus holds is in no intersection, and the fewer sets hold one the earlier it comes in the global order
of shingles. How many sets hold each is counted exactly by a shuffle of packed hashes: a task's documents are a chunk, which sends each bucket of
hashes one row, and gets back the shingles that are held elsewhere too. A set whose shared shingles are too few to make it similar to any other is done.

Two similar sets share a shingle of their prefixes. Sets with the same prefix and size are one group; only a group's leader is posted under the prefix. Pairs of groups under a
posting pass filters by size, by the shingle's place in both prefixes and by parity bits; what is left is verified on all shingles of the members.

The first round takes pairs of groups alone, each with its likeliest neighbour, and the members of each group with its leader. The groups of postings that still have several
components are then expanded, and pairs of members in different components pass the same filters: one for each two components first, in the last round all of
them. A pair is taken from the posting of its first shared shingle, as far as the shingles before it tell. As both ends of a link are in one
component then, links are counted among the sets of each component, in chunks of bounded size, without a row for each link."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X
from quarry.llm.components import components
from quarry.llm.line_dedup import discard, release, save, scratch

WORDS = 5
#: Similarity as a fraction: links have DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Bytes and rows of a chunk (a longer document is a chunk of its own); a row's place in it has 16 bits, a shingle's hash 48.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 60_000
PLACE_BITS = 16
#: Bytes of text that are shingled at once, unless one document has more.
STEP = 2 << 20
#: A shingle that so many sets of a chunk hold sends only their number; who they are stays with the chunk.
OFTEN = 16
#: Postings of so many groups are compared at once, those of more in blocks of BLOCK; one of more than MANY is dealt out to several tasks.
FEW, BLOCK, MANY = 32, 512, 20_000
#: Parity bits of a set; shingles in front of its own that a posting's entry holds; entries behind it that one is compared with in the first round.
BITS, BEFORE, NEXT = 512, 4, 8
#: The last round, which asks all pairs that are left; those between the first and it ask one pair for each two components.
ROUNDS = 2
#: A component with more members, or more shingles in all, is compared in chunks of about so many; any two chunks meet in one key.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Cells of the tables that count shared shingles at once.
CELLS = 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row: runs of WORDS words, or all words of a row with fewer."""
    low = X.LOWER[data]
    start, end, before = X.words(low, offsets)
    words = X.span_hashes(low, start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.diff(before)
    n = len(words) - WORDS + 1
    rows, hashes = [], []
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(WORDS):
            h = h * X.BASE + words[k : k + n]
        whole = row[:n] == row[WORDS - 1 :]
        rows.append(row[:n][whole])
        hashes.append(X.mix(h[whole]))
    for r in np.flatnonzero((count > 0) & (count < WORDS)):
        h = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for w in words[before[r] : before[r + 1]]:
                h = h * X.MIX_B + w
        rows.append(np.array([r]))
        hashes.append(X.mix(np.array([h], np.uint64)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-n * NUM // DEN) + 1


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))


def runs(batches: Iterator[pa.RecordBatch], key: str = "h") -> Iterator[pa.RecordBatch]:
    """The rows of a partition sorted by key, dealt anew so that all rows of a key are in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        elif held and keys[0] != held[0].column(key)[0].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch]
        elif cut:
            yield batch.slice(0, cut)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# Packed tables of shingles.


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, byte plane by byte plane, compressed; the first column is ascending and stored as differences."""
    first = columns[0].astype(np.uint64)
    first[1:] -= columns[0][:-1].astype(np.uint64)
    parts = [np.array([len(first)], np.uint32).tobytes()]
    for c in (first, *columns[1:]):
        planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T
        parts += [np.uint8(c.itemsize).tobytes(), np.ascontiguousarray(planes).tobytes()]
    raw = b"".join(parts)
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[4:], decompressed_size=int(np.frombuffer(data[:4], np.uint32)[0]), codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw[:4], np.uint32)[0]), 4, []
    while at < len(raw):
        size = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * size, at + 1).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{size}"))
        at += 1 + n * size
    if out:
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def keys16(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128-bit keys as rows of two numbers."""
    return np.stack([a, b], 1)


def binary16(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def void16(column: pa.Array) -> np.ndarray:
    """Keys that sort and compare like their bytes."""
    return X.flat(column)[0].view("V16")


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i] : at[i + 1]], modulo 2 ** 64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def chunks(batch: pa.RecordBatch, number: Iterator[int]) -> Iterator[tuple[bytes, dict]]:
    """Key and content of each chunk of a batch of (doc_id, text, t).

    The key follows from the task's number, the chunk's in it and its content, so equal chunks have different keys and a task that runs again finds the same."""
    offsets = X.flat(batch.column(1))[1]
    for a, b in X.steps(offsets, CHUNK_BYTES):
        for a, b in ((x, min(x + CHUNK_ROWS, b)) for x in range(a, b, CHUNK_ROWS)):  # noqa: B020, PLW2901
            part = batch.slice(a, b - a)
            data, where = X.flat(part.column(1))
            found = []
            for x, y in X.steps(where, STEP):
                row, h = shingle_sets(data[where[x] : where[y]], where[x : y + 1] - where[x])
                found.append(((row + x).astype(np.int32), h))
            row, h = (np.concatenate(c) for c in zip(*found, strict=True))
            at = np.searchsorted(row, np.arange(b - a + 1))
            n = np.diff(at)
            ids = keys16(X.mix(summed(X.mix(h + X.BASE), at) + n.astype(np.uint64)), summed(X.mix(h ^ X.MIX_B), at))
            key = hashlib.blake2b(repr((TaskContext.get().partitionId(), next(number), part.column(0).to_pylist())).encode(), digest_size=16)
            key.update(ids.tobytes())
            # Of equal sets in a chunk one speaks for all; rows without an id or without words have none.
            able = np.flatnonzero((n > 0) & part.column(0).is_valid().to_numpy(zero_copy_only=False))
            _, first = np.unique(ids[able].view("V16").ravel(), return_index=True)
            speaks = np.zeros(b - a, bool)
            speaks[able[first]] = True
            yield key.digest(), {"doc_id": part.column(0), "t": part.column(2), "n": n, "ids": ids, "speaks": speaks, "row": row, "h": h}


def counted_shingles(docs: DataFrame) -> DataFrame:
    """chunk, own, data: of each chunk its rows (own, packed) and, for each bucket, its shingles that more sets of the corpus hold.

    A bucket's shingles are in one task: of a chunk's row those that OFTEN sets of it hold at least are sent once, so a shingle that all documents hold sends few numbers
    for each chunk. The buckets are as many as spark.sql.shuffle.partitions, which bounds a task's memory as it does for any other shuffle."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = np.uint64(PLACE_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = iter(range(1 << 62))
        for batch in batches:
            for key, c in chunks(batch, number):
                use = c["speaks"][c["row"]]
                words = np.sort((c["h"][use] >> shift << shift) | c["row"][use].astype(np.uint64))  # hash, then place in the chunk
                v, place = words >> shift, (words & np.uint64((1 << PLACE_BITS) - 1)).astype(np.uint16)
                edge = bounds(v)
                count = np.diff(edge)
                often = np.repeat(count >= OFTEN, count)
                ov, oc = v[edge[:-1]][count >= OFTEN], count[count >= OFTEN].astype(np.uint32)
                own = packed(v[often], place[often])
                v, place = v[~often], place[~often]
                # A bucket is a range of hashes.
                cuts = np.array([-(-(i << 48) // buckets) for i in range(1, buckets)], np.uint64)
                at, o_at = ([0, *np.searchsorted(x, cuts).tolist(), len(x)] for x in (v, ov))
                table = pa.table({"doc_id": c["doc_id"], "t": c["t"], "n": pa.array(c["n"]), "id": binary16(c["ids"]), "speaks": pa.array(c["speaks"])})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
                to, blobs, other = [int.from_bytes(key[:4], "little") % buckets], [own], [sink.getvalue().to_pybytes()]
                for k in range(buckets):
                    if at[k] < at[k + 1] or o_at[k] < o_at[k + 1]:
                        to.append(k)
                        blobs.append(packed(v[at[k] : at[k + 1]], place[at[k] : at[k + 1]]))
                        other.append(packed(ov[o_at[k] : o_at[k + 1]], oc[o_at[k] : o_at[k + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([key] * len(to), pa.binary()), pa.array([True] + [False] * (len(to) - 1)), pa.array(blobs, pa.binary()), pa.array(other, pa.binary())], ["bucket", "chunk", "own", "data", "more"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "own", "data", "more"]
        held: list[tuple[bytes, list[np.ndarray], list[np.ndarray]]] = []
        for batch in batches:
            own = batch.column("own")
            if pa.compute.any(own).as_py():
                yield batch.filter(own).select(names)
            rest = batch.filter(pa.compute.invert(own))
            held += [(c, unpacked(d), unpacked(o)) for c, d, o in zip(rest.column("chunk").to_pylist(), rest.column("data").to_pylist(), rest.column("more").to_pylist(), strict=True)]
        if not held:
            return
        light = np.sort(np.concatenate([d[0] for _, d, _ in held]))
        heavy = np.concatenate([o[0] for _, _, o in held])
        times = np.concatenate([o[1] for _, _, o in held]).astype(np.int64)
        by = np.argsort(heavy, kind="stable")
        heavy, times = heavy[by], np.concatenate([[0], np.cumsum(times[by])])

        def holders(v: np.ndarray) -> np.ndarray:
            return np.searchsorted(light, v, "right") - np.searchsorted(light, v) + times[np.searchsorted(heavy, v, "right")] - times[np.searchsorted(heavy, v)]

        for chunk, (v, place), (ov, _) in held:
            n = holders(v)
            use = n > 1
            rank = np.ceil(np.log2(np.maximum(n[use], 1))).astype(np.uint8)
            more = packed(ov, np.ceil(np.log2(np.maximum(holders(ov), 1))).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary()), pa.array([False]), pa.array([packed(v[use], place[use], rank)], pa.binary()), pa.array([more], pa.binary())], names)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    dealt = rows.mapInArrow(X.frugal(deal), "bucket int, chunk binary, own boolean, data binary, more binary")
    return dealt.repartitionById(buckets, "bucket").mapInArrow(X.frugal(count), "chunk binary, own boolean, data binary, more binary")


def parities(place: np.ndarray, v: np.ndarray, live: np.ndarray) -> Iterator[bytes]:
    """Parity bits of each live row; place: the row of each of the shingles v, ascending."""
    rows = np.flatnonzero(live)
    for i in range(0, len(rows), 4096):
        some = rows[i : i + 4096]
        a, b = np.searchsorted(place, [some[0], some[-1] + 1])
        use = live[place[a:b]]
        at = np.searchsorted(some, place[a:b][use]) * BITS + (v[a:b][use] & np.uint64(BITS - 1)).astype(np.int64)
        bits = np.packbits((np.bincount(at, minlength=len(some) * BITS) & 1).astype(np.uint8)).reshape(len(some), BITS // 8)
        yield from (x.tobytes() for x in bits)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), n, id (128 bits that stand for the set), chunk of every row; for one row of each set in a chunk that may link with another set also
    u (its shingles that no other set holds, which come first), k (how many others are in its prefix), g (its group's key), odd and shared: all others in the global order.

    odd: BITS bits, each 1 if an odd number of shared's shingles fall on it. Two sets' shared shingles differ in at least as many as these differ in bits."""

    def assemble(table: pa.Table) -> pa.Table:
        X.hand_back()  # what the chunk before took
        own = table.filter(table.column("own"))
        rest = table.filter(pa.compute.invert(table.column("own")))
        if own.num_rows != 1:
            raise ValueError("a chunk was read twice with different rows")
        rows = pa.ipc.open_stream(own.column("more")[0].as_py()).read_all()
        v, place, rank = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
        o, o_rank = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for data, more in zip(rest.column("data").to_pylist(), rest.column("more").to_pylist(), strict=True):
            for to, x in zip((v, place, rank), unpacked(data), strict=True):
                to.append(x)
            for to, x in zip((o, o_rank), unpacked(more), strict=True):
                to.append(x)
        ov, oplace = unpacked(own.column("data")[0].as_py())
        o, o_rank = np.concatenate(o), np.concatenate(o_rank)
        by = np.argsort(o)
        v, place = np.concatenate([*v, ov]), np.concatenate([*place, oplace]).astype(np.int64)
        rank = np.concatenate([*rank, o_rank[by][np.searchsorted(o[by], ov)] if len(ov) else np.zeros(0, np.uint8)])
        n = rows.column("n").to_numpy()
        by = np.lexsort((v, rank, place))
        v, place = v[by], place[by]
        at = np.searchsorted(place, np.arange(len(n) + 1))
        u = n - np.diff(at)
        k = prefix_size(n) - u
        live = rows.column("speaks").to_numpy(zero_copy_only=False) & (k > 0) & (np.diff(at) > 0)
        inside = np.arange(len(v)) - at[place] < k[place]
        mixed = [summed(np.where(inside, X.mix(v + s), 0).astype(np.uint64), at) + X.mix(n.astype(np.uint64) * X.MIX_A + s) for s in (X.BASE, X.MIX_B)]
        g = keys16(*mixed).tobytes()
        lists = [v[at[i] : at[i + 1]].tobytes() if live[i] else None for i in range(len(n))]
        mask = ~live
        odd = dict(zip(np.flatnonzero(live).tolist(), parities(place, v, live), strict=True))
        return pa.Table.from_arrays(
            [rows.column("doc_id"), rows.column("t"), rows.column("n"), rows.column("id"), pa.array([own.column("chunk")[0].as_py()] * len(n), pa.binary()), pa.array(u, mask=mask), pa.array(k, mask=mask), pa.array([g[16 * i : 16 * i + 16] if x else None for i, x in enumerate(live)], pa.binary()), pa.array([odd.get(i) for i in range(len(n))], pa.binary()), pa.array(lists, pa.binary())],
            ["doc_id", "t", "n", "id", "chunk", "u", "k", "g", "odd", "shared"],
        )

    return counted_shingles(docs).groupBy("chunk").applyInArrow(assemble, "doc_id long, t long, n long, id binary, chunk binary, u long, k long, g binary, odd binary, shared binary")


# Postings of groups and their pairs.


def postings(leaders: DataFrame) -> DataFrame:
    """h, lead, several of every group: each shingle of its prefix, and whether the group (id, k, shared, size) has several members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.flat(batch.column("shared"))
            row, place = prefixes(batch, offsets)
            v = data.view(np.uint64)[offsets[row] // 8 + place]
            several = batch.column("size").to_numpy() > 1
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), batch.column("id").take(pa.array(row)), pa.array(several[row])], ["h", "lead", "several"])

    return leaders.select("id", "k", "shared", "size").mapInArrow(X.frugal(run), "h long, lead binary, several boolean")


def prefixes(batch: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row, and place in shared, of every shingle of the prefixes of a batch."""
    k = np.minimum(batch.column("k").to_numpy(), np.diff(offsets) // 8)
    row = np.repeat(np.arange(len(k)), k)
    return row, np.arange(len(row)) - (np.cumsum(k) - k)[row]


def entries(wanted: DataFrame, members: DataFrame, more: list[str]) -> DataFrame:
    """h, id, n, u, odd, at, before and more of members (lead, id, n, u, k, odd, shared, more) under the shingles h of their group that wanted (h, lead) names.

    at: the shingle's place in the prefix; before: the BEFORE shingles in front of it (0: none). These wide rows are made of what is wanted alone."""
    both = members.select("lead", "id", "n", "u", "k", "odd", "shared", *more).join(wanted.groupBy("lead").agg(F.collect_set("h").alias("hs")), "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, u = (batch.column(c).to_numpy() for c in ("n", "u"))
            data, offsets = X.flat(batch.column("shared"))
            v, first = data.view(np.uint64), offsets[:-1] // 8
            row, place = prefixes(batch, offsets)
            lists = batch.column("hs")
            asked = lists.flatten().to_numpy().view(np.uint64)
            of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
            # 48 bits of the shingle with 16 of the row are one number for each pair; other rows' pairs that look the same are sorted out by the row.
            key = lambda r, h: X.mix(h * X.BASE + r.astype(np.uint64))
            use = np.isin(key(row, v[first[row] + place]), key(of, asked))
            row, place = row[use], place[use]
            at = first[row] + place
            before = np.stack([np.where(place >= d, v[np.maximum(at - d, 0)], 0) for d in range(1, BEFORE + 1)], 1).astype(np.uint64)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BEFORE), len(row), [None, pa.py_buffer(np.ascontiguousarray(before).tobytes())]).cast(pa.binary())
            rows = pa.array(row)
            columns = [pa.array(v[at].astype(np.int64)), batch.column("id").take(rows), pa.array(n[row]), pa.array(u[row]), batch.column("odd").take(rows), pa.array(u[row] + place), raw]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(rows) for c in more)], ["h", "id", "n", "u", "odd", "at", "before", *more])

    return both.mapInArrow(X.frugal(run), "h long, id binary, n long, u long, odd binary, at long, before binary" + "".join(f", {c} binary" for c in more))


def may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m may link if the shingle at these places is the first that they share: no more than what follows can be shared.

    Any two that link pass at the first one. It implies the filter by size."""
    return np.minimum(n - at, m - to) * (NUM + DEN) >= NUM * (n + m)


def likeness(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Upper bound of the similarity, in ten-thousandths, of sets of sizes n and m that differ in so many shingles at least; 0 if it isn't enough."""
    share = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return np.where(share * DEN >= NUM * (n + m - share), 10_000 * share // np.maximum(n + m - share, 1), 0)


class Posting:
    """Entries sorted by shingle, then size, as columns."""

    def __init__(self, batch: pa.RecordBatch):
        self.n, self.at, self.u = (batch.column(c).to_numpy() for c in ("n", "at", "u"))
        self.odd = np.frombuffer(X.flat(batch.column("odd"))[0], np.uint64).reshape(-1, BITS // 64)
        self.before = np.frombuffer(X.flat(batch.column("before"))[0], np.uint64).reshape(-1, BEFORE)

    def bound(self, x: np.ndarray, y: np.ndarray, once: bool = True) -> np.ndarray:
        """likeness() of each pair, 0 also for pairs that can't link here or, if each is to be found once, that share an earlier shingle: that one's posting has them."""
        q = np.zeros(len(x), np.int64)
        use = np.flatnonzero(may_link(self.n[x], self.at[x], self.n[y], self.at[y]))
        for i in range(0, len(use), 1 << 18):
            part = use[i : i + (1 << 18)]
            a, b = x[part], y[part]
            differ = self.u[a] + self.u[b] + np.bitwise_count(self.odd[a] ^ self.odd[b]).sum(1, dtype=np.int64)
            got = likeness(self.n[a], self.n[b], differ)
            some = np.flatnonzero(got)
            for d in range(BEFORE if once else 0):
                own = self.before[a[some], d]
                met = (own != 0) & (own[:, None] == self.before[b[some]]).any(1) if len(some) else np.zeros(0, bool)
                some = some[~met]
            q[part[some]] = got[some]
        return q


def set_pairs(given: DataFrame, labelled: bool, one: bool = False) -> DataFrame:
    """a, b, q: pairs of id of entries (h, id, n, u, odd, at, before and, if labelled, label) under one shingle that may link, with the bound of their likeness.

    Labelled: all pairs with different labels, a > b, or of each two labels in a batch the likeliest one. Otherwise of each a its likeliest b among the next NEXT in the order of sizes, of all its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "key"):
            keys = batch.column("key").to_numpy()
            own = Posting(batch)
            _, ids = np.unique(void16(batch.column("id")), return_inverse=True)
            label = np.unique(void16(batch.column("label")), return_inverse=True)[1] if labelled else ids
            edge = bounds(keys)
            count = np.repeat(np.diff(edge), np.diff(edge))
            found = []
            best, to = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for d in range(1, FEW if labelled else NEXT + 1):
                x = np.flatnonzero(keys[d:] == keys[:-d])
                x = x[count[x] <= FEW] if labelled else x
                x = x[label[x] != label[x + d]]
                q = own.bound(x, x + d, labelled)
                if labelled:
                    found.append((x[q > 0], x[q > 0] + d, q[q > 0]))
                else:
                    more = q > best[x]
                    best[x[more]], to[x[more]] = q[more], x[more] + d
            if labelled:
                for a, b in zip(edge, edge[1:], strict=False):
                    if b - a > FEW:
                        found += _different(np.arange(a, b), own, label)
            else:
                x = np.flatnonzero(best)
                found.append((x, to[x], best[x]))
            x, y, q = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(x):
                continue
            size = int(ids.max()) + 1
            if labelled:
                x, y = np.where(ids[x] > ids[y], x, y), np.where(ids[x] > ids[y], y, x)
            by = np.argsort(-q, kind="stable")
            x, y, q = x[by], y[by], q[by]
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            _, first = np.unique((low * size + high if one else ids[x] * size + ids[y]) if labelled else ids[x], return_index=True)
            x, y, q = x[first], y[first], q[first]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(x)), batch.column("id").take(pa.array(y)), pa.array(q)], ["a", "b", "q"])

    found = dealt(given, labelled).repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(X.frugal(run), "a binary, b binary, q long")
    if labelled:
        return found.groupBy("a", "b").agg(F.max("q").alias("q"))
    return found.groupBy("a").agg(F.max(F.struct("q", "b")).alias("v")).select("a", "v.b", "v.q")


def _different(rows: np.ndarray, own: Posting, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a posting sorted by size with different labels that may link, block by block."""
    for i in range(0, len(rows), BLOCK):
        block = rows[i : i + BLOCK]
        for k in range(i, len(rows), BLOCK):
            some = rows[k : k + BLOCK]
            if own.n[block[-1]] * DEN < own.n[some[0]] * NUM:
                break
            x, y = np.nonzero(label[block, None] != label[None, some])
            x, y = block[x], some[y]
            if k == i:
                x, y = x[x < y], y[x < y]
            q = own.bound(x, y)
            yield x[q > 0], y[q > 0], q[q > 0]


def dealt(entries: DataFrame, pairwise: bool) -> DataFrame:
    """entries with a column key: h, or for a posting of more than MANY entries a part of it. Pairwise: each entry goes into as many parts as
    there are, so that any two meet in one."""
    large = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > MANY).select("h", F.ceil(F.col("c") / MANY).cast("int").alias("parts"))
    both = entries.join(large, "h", "left").withColumn("s", F.expr("CASE WHEN parts IS NOT NULL THEN pmod(xxhash64(id), parts) END"))
    if pairwise:
        both = both.withColumn("o", F.explode(F.expr("CASE WHEN parts IS NULL THEN array(0L) ELSE sequence(0L, parts - 1L) END")))
        return both.withColumn("key", F.expr("CASE WHEN parts IS NULL THEN h ELSE xxhash64(h, least(s, o), greatest(s, o)) END"))
    return both.withColumn("key", F.expr("CASE WHEN parts IS NULL THEN h ELSE xxhash64(h, s) END"))


# Members: verification and links.


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """a, b of the pairs of members whose shingle sets are similar enough. What isn't in shared no other set holds."""
    one = pairs.select("a", "b").join(members.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("shared").alias("x")), "a")
    both = one.join(members.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("shared").alias("y")), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            inter = np.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array((inter > 0) & (DEN * inter >= NUM * (n + m - inter))))

    return both.mapInArrow(X.frugal(run), "a binary, b binary")


def shared_shingles(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """How many shingles each two of the sets share, as a matrix; exact, as float32 holds whole numbers up to 2 ** 24."""
    by = np.argsort(h, kind="stable")
    row, edge = row[by], bounds(h[by])
    count = np.diff(edge)
    row, count = row[np.repeat(count > 1, count)], count[count > 1]
    place = np.repeat(np.arange(len(count)), count)
    out = np.zeros((rows, rows), np.float32)
    width = max(CELLS // rows, 1)
    for at in range(0, len(count), width):
        x, y = np.searchsorted(place, [at, at + width])
        table = np.zeros((rows, min(width, len(count) - at)), np.float32)
        table[row[x:y], place[x:y] - at] = 1
        out += table @ table.T
    return out.astype(np.int64)


def links_within(nodes: DataFrame, members: DataFrame, pairs: bool) -> DataFrame:
    """Of every link inside the components nodes (id, label, parts: chunks of its component): a, b, a > b; or without pairs id, n: how many a set has,
    one row for each set and pair of chunks."""
    at = nodes.withColumn("s", F.expr("pmod(xxhash64(id), parts)")).withColumn("o", F.explode(F.expr("sequence(0L, parts - 1L)")))
    at = at.select("id", F.expr("xxhash64(label, least(s, o), greatest(s, o))").alias("key"), "s", (F.col("s") == F.col("o")).alias("own"))
    met = at.join(members.select("id", "n", "shared"), "id").select("key", "id", "s", "own", "n", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "key"):
            keys, s, own, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "s", "own", "n"))
            ids = batch.column("id")
            order = np.unique(void16(ids), return_inverse=True)[1]
            data, offsets = X.flat(batch.column("shared"))
            v, first = data.view(np.uint64), offsets // 8
            edge = bounds(keys)
            for x, y in zip(edge, edge[1:], strict=False):
                if y - x < 2:
                    continue
                inter = shared_shingles(np.repeat(np.arange(y - x), np.diff(first[x : y + 1])), v[first[x] : first[y]], y - x)
                ok = (inter > 0) & (DEN * inter >= NUM * (n[x:y, None] + n[None, x:y] - inter))
                # The two chunks of a key meet there; a chunk's own pairs have a key of their own.
                ok &= own[x:y, None] & own[None, x:y] | (s[x:y, None] != s[None, x:y])
                np.fill_diagonal(ok, False)
                if pairs:
                    i, j = np.nonzero(ok & (order[x:y, None] > order[None, x:y]))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x + i)), ids.take(pa.array(x + j))], ["a", "b"])
                else:
                    yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), pa.array(ok.sum(1).astype(np.int64))], ["id", "n"])

    return met.repartition("key").sortWithinPartitions("key").mapInArrow(X.frugal(run), "a binary, b binary" if pairs else "id binary, n long")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (set_rows), the distinct sets that may link (id, label, rep: their smallest doc_id, component, size: the sets in it, parts: its chunks), and those sets' shingles."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    rows = save(set_rows(docs), f"{folder}/rows")
    release(spark)
    own = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("k").isNotNull(), F.col("chunk"))).alias("owner")).where("owner IS NOT NULL")
    live = rows.where("k IS NOT NULL").select(F.col("id").alias("of"), "chunk", "n", "u", "k", "g", "odd", "shared")
    members = save(live.join(own, (F.col("of") == F.col("id")) & (F.col("chunk") == F.col("owner"))).select("id", "rep", "n", "u", "k", "g", "odd", "shared"), f"{folder}/members")
    groups = save(members.groupBy("g").agg(F.min("id").alias("lead")).join(members.select("id", "g"), "g").select("id", "lead"), f"{folder}/groups")
    leaders = members.join(groups.groupBy("lead").agg(F.count(F.lit(1)).alias("size")), F.col("id") == F.col("lead"))
    posted = postings(leaders)
    # Postings of one set alone are no use.
    used = posted.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bool_or("several").alias("s")).where("c > 1 OR s").select("h")
    posted = save(posted.join(used, "h", "left_semi").select("h", "lead"), f"{folder}/postings")
    release(spark)
    near = set_pairs(entries(posted, leaders, []), False).select("a", "b")
    asked = near.unionAll(groups.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    done: list[DataFrame] = []
    links: list[DataFrame] = []
    k, last = 0, False
    while True:
        done.append(save(asked, f"{folder}/asked-{k}"))
        links.append(save(verified(done[-1], members), f"{folder}/links-{k}"))
        labels = components(reduce(DataFrame.unionAll, links), f"{folder}/cc-{k}").select(F.col("node").alias("id"), "label")
        release(spark)
        if last:
            break
        # Only postings with several components are left; their groups are expanded, as members may be in different ones.
        of = save(groups.join(labels, "id", "left").select("id", "lead", F.coalesce("label", "id").alias("label")), f"{folder}/of-{k}")
        ends = of.groupBy("lead").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        several = posted.join(ends, "lead").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h")
        given = members.join(of, "id").select("lead", "id", "n", "u", "k", "odd", "shared", "label")
        k += 1
        last = k == ROUNDS
        left = set_pairs(entries(posted.join(several, "h", "left_semi"), given, ["label"]), True, not last).join(reduce(DataFrame.unionAll, done), ["a", "b"], "left_anti")
        if last:
            asked = left.select("a", "b")
        else:  # one for each two components
            x, y = (of.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
            asked = left.join(x, "a").join(y, "b").groupBy(F.least("la", "lb"), F.greatest("la", "lb")).agg(F.max_by(F.struct("a", "b"), F.struct("q", "a", "b")).alias("p")).select("p.a", "p.b")
    known = members.join(labels, "id", "left").select("id", "rep", "n", F.coalesce("label", "id").alias("label"))
    chunks_of = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    least = known.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("size"), chunks_of.alias("parts")).where("size > 1")
    known = save(known.join(least, "label").select("id", "label", "rep", "component", "size", "parts"), f"{folder}/known")
    discard(spark, f"{folder}/groups", f"{folder}/postings", *(f"{folder}/{name}-{i}" for name in ("asked", "links", "cc", "of") for i in range(k + 1)))
    return rows, known, members


def labelled_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, t, id (null without words), n_shingles, component_id of every row."""
    first = rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("first"))
    of = first.join(known.select("id", "component"), "id", "left").select(F.col("id").alias("of"), F.coalesce("component", "first").alias("component"))
    found = rows.select("doc_id", "t", "n", F.expr("CASE WHEN n > 0 THEN id END").alias("id")).join(of, F.col("id") == F.col("of"), "left")
    return found.select("doc_id", "t", "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles, n_links, component_id of every row; t: xxhash64 of the text (repeated ids may have several).

    n_links counts the other distinct sets that the row's set links with: classes with the same set count none. component_id is the smallest doc_id reachable. Rows
    without words link with nothing. Repeated rows have the same set. A null id links nothing with anything: such a row's component is that of its set, null if no other row has it."""
    rows, known, members = grouped(docs)
    degree = links_within(known.where("size > 2").select("id", "label", "parts"), members, False).groupBy("id").agg(F.sum("n").alias("n_links"))
    # Two members that are a component are linked.
    some = degree.unionAll(known.where("size = 2").select("id", F.lit(1).cast("long").alias("n_links"))).withColumnRenamed("id", "of")
    found = labelled_rows(rows, known)
    return found.join(some, F.col("id") == F.col("of"), "left").select("doc_id", "t", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")


def link_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b of every link between two distinct sets, and the membership beside them: doc_id, t, id of every row with words."""
    rows, known, members = grouped(docs)
    return links_within(known.select("id", "label", "parts"), members, True), rows.where("n > 0").select("doc_id", "t", "id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of the smallest doc_id of each component, with their columns; a repeated row stays once. Rows with a null id, and those without words, all stay."""
    rows, known, _ = grouped(docs)
    hidden, of, is_text = X.fresh(docs, 3)
    keep = labelled_rows(rows, known).where("component_id = doc_id").select(F.col("doc_id").alias(of), F.col("t").alias(is_text)).distinct()
    given = docs.where("doc_id IS NOT NULL").withColumn(hidden, F.xxhash64("text"))
    kept = given.join(keep, (F.col("doc_id") == F.col(of)) & (F.col(hidden) == F.col(is_text)), "left_semi").dropDuplicates(["doc_id", hidden]).drop(hidden)
    return kept.unionAll(docs.where("doc_id IS NULL"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' classes; the cases are those of classes()."""
    return classes(X.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")
