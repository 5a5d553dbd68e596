"""Operator 4: suffix-array dedup of repeated byte strings.

Suffix arrays are built by linear grouping: suffixes are kept in groups of equal Lyndon prefixes; the groups are processed from the highest down, each
splitting the groups of its suffixes' previous smaller suffixes; then one pass emits every group's order, without recursive renaming.

One array of a whole corpus is neither possible in one task nor needed. Every string of LENGTH bytes has an anchor, its k-gram with the least hash, which depends on the
string alone; strings whose anchor occurs once in the corpus occur once. The surroundings of the other anchors, equal ones collapsed with their number, are brought
together by anchor, and the suffix arrays of what stands right of the anchors, and of what stands left of them read backwards, give the classes of
equal strings at every offset: strings are equal if their left parts and their right parts are in one class each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textops as X
from quarry.llm.jaccard_join import bounds, runs
from quarry.llm.line_dedup import release, save, scratch

LENGTH = 200
#: Bytes of an anchor.
GRAM = 32
#: Largest distance from a string's begin to its anchor.
REACH = LENGTH - GRAM
#: Bytes that are one symbol of a suffix array.
SYMBOL = 16
#: An anchor with more distinct surroundings is dealt out by the bytes that PART neighbouring offsets have in common.
MANY = 20_000
PART = 24
#: Surroundings whose arrays are built together, unless one anchor has more.
BATCH = 20_000


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol is 0 and smaller than all others."""
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable")
    values = np.asarray(text)[order]
    first = np.append(True, values[1:] != values[:-1])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group_of = np.empty(n, np.int64)
    group_of[order] = starts
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    sa, place, group = order.tolist(), place_of.tolist(), group_of.tolist()
    size = np.bincount(starts, minlength=n).tolist()
    before = [-1] * n  # previous suffix of a smaller group
    high = n - 1
    while high >= 0:
        low = group[sa[high]]
        if low == high:
            s = sa[high]
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            before[s] = p
            if p >= 0:  # p's group: p goes to its upper end, a group of its own
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                q, at = sa[last], place[p]
                sa[at], place[q] = q, at
                sa[last], place[p] = p, last
                group[p] = last
                size[last] = 1
            high = low - 1
            continue
        members = sorted(sa[low : high + 1])
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            if p >= 0 and group[p] == low:
                p = before[p]  # of the same group and further left, so known
            before[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            by_count: dict[int, list[int]] = {}
            for p, c in count.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                some = by_count[c]
                for p in some:
                    g = group[p]
                    size[g] -= 1
                    last = g + size[g]
                    q, at = sa[last], place[p]
                    sa[at], place[q] = q, at
                    sa[last], place[p] = p, last
                fresh = [group[p] + size[group[p]] for p in some]
                for g in set(fresh):
                    size[g] = 0
                for p, g in zip(some, fresh, strict=True):
                    group[p] = g
                    size[g] += 1
        high = low - 1
    following = list(range(n))
    done = [False] * n
    sa[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            sa[following[g]] = j
            following[g] += 1
            done[j] = True
            j = before[j]
    return sa


def row_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows, from the suffix array of all of them, and how many bytes each has in common with the one before it in that order."""
    n, width = rows.shape
    symbols = -(-width // SYMBOL)
    padded = np.zeros((n, symbols * SYMBOL), np.uint8)
    padded[:, :width] = rows
    halves = padded.reshape(-1, SYMBOL).view(">u8").astype(np.uint64)
    by = np.lexsort((halves[:, 1], halves[:, 0]))
    ordered = halves[by]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) + 1
    text = np.ones((n, symbols + 1), np.int64)  # each row ends with 1, all end with 0
    text[:, :symbols] = rank.reshape(n, symbols)
    sa = np.array(suffix_array([*text.ravel().tolist(), 0]))
    starts = sa[sa < n * (symbols + 1)]
    order = starts[starts % (symbols + 1) == 0] // (symbols + 1)
    same = np.zeros(n, np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    same[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, same


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its row, its place, its hash, and the begins of the first and the last string (one LENGTH long) that it is the anchor of."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none
    up, down = X.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = X.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    span = 1
    while 2 * span <= REACH + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = REACH + 1 - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    ok = np.flatnonzero(np.arange(n) + LENGTH <= offsets[row + 1])
    if not len(ok):
        return none, none, none, none, none
    edge = np.append(True, (at[ok[1:]] != at[ok[:-1]]) | (row[ok[1:]] != row[ok[:-1]]))
    first = ok[edge]
    last = ok[np.append(np.flatnonzero(edge)[1:] - 1, len(ok) - 1)]
    return row[first], at[first], h[at[first]].astype(np.int64), first, last


def each(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    data, offsets = X.flat(batch.column(text))
    for a, b in X.steps(offsets):
        own, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, own, where, anchors(own, where)


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, t, at: of each document (text hash t) the anchors whose hash occurs more than once in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, _, where, (row, at, h, _, _) in each(batch, 2):
                # What occurs twice here is known to be repeated. One row of it goes where its hash is counted, the others anywhere.
                _, first, of, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known, told = count[of] > 1, np.zeros(len(h), bool)
                told[first] = True
                key = np.where(told, h, X.mix((at + where[0]).astype(np.uint64) + X.BASE * ids[a + row].astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ids[a + row]), pa.array(t[a + row]), pa.array((at - where[row]).astype(np.int32)), pa.array(known)], ["h", "doc_id", "t", "at", "known"]
                )

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition sorted by h; the last row of a batch waits for the next, with whether it is known to be repeated."""
        held: pa.RecordBatch | None = None
        before = False
        for batch in batches:
            both = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            h = both.column(0).to_numpy(zero_copy_only=False)
            same = h[1:] == h[:-1]
            use = np.append(same, False) | np.append(False, same) | both.column(4).to_numpy(zero_copy_only=False)
            use[0] |= before
            held, before = both.slice(len(h) - 1), bool(use[-1])
            out = both.slice(0, len(h) - 1).filter(pa.array(use[:-1]))
            if out.num_rows:
                yield out.select(["doc_id", "t", "at"])
        if held is not None and before:
            yield held.select(["doc_id", "t", "at"])

    return docs.mapInArrow(run, "h long, doc_id long, t long, at int, known boolean").repartition("h").sortWithinPartitions("h").mapInArrow(several, "doc_id long, t long, at int")


def surroundings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, t, begin, h, left, ctx: of each repeated anchor all strings that it is the anchor of, as one run of bytes from begin on with
    the anchor at left."""
    wanted = found.groupBy("doc_id", "t").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            wants = batch.column(3)
            for a, data, where, (row, at, h, first, last) in each(batch, 2):
                n = len(where) - 1
                part = wants.slice(a, n)
                lens = pa.compute.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
                keys = np.sort(np.repeat(np.arange(n), lens) << 40 | (part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
                own = row << 40 | (at - where[row])
                k = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                use = np.flatnonzero(keys[k] == own) if len(keys) else np.zeros(0, np.int64)
                raw = data.tobytes()
                for i in range(0, len(use), 20_000):
                    u = use[i : i + 20_000]
                    ctx = pa.array([raw[x:y] for x, y in zip(first[u].tolist(), (last[u] + LENGTH).tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a + row[u]]), pa.array(t[a + row[u]]), pa.array((first[u] - where[row[u]]).astype(np.int32)), pa.array(h[u]), pa.array((at[u] - first[u]).astype(np.int32)), ctx],
                        ["doc_id", "t", "begin", "h", "left", "ctx"],
                    )

    both = docs.join(wanted, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "at")
    return both.mapInArrow(run, "doc_id long, t long, begin int, h long, left int, ctx binary")


def repeated_parts(left: np.ndarray, ctx: list[bytes], several: np.ndarray, part: np.ndarray) -> list[list[int]]:
    """For each of the surroundings, of which equal ones were collapsed: begin and end of every run of strings that occur more than once.

    several: it stands for more than one place; part: only offsets of this part count, -1 for all."""
    n = len(ctx)
    size = np.array([len(c) for c in ctx])
    least, most = LENGTH - (size - left), left.copy()  # offsets of its strings: distance from the begin to the anchor
    cut = part >= 0
    least = np.where(cut, np.maximum(least, part * PART), least)
    most = np.where(cut, np.minimum(most, part * PART + PART - 1), most)
    again = np.zeros((n, REACH + 1), bool)
    offset = np.arange(REACH + 1)
    inside = (offset >= least[:, None]) & (offset <= most[:, None])
    again[several] = inside[several]
    if n > 1:
        right_rows, left_rows = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH), np.uint8)
        for i, (c, k) in enumerate(zip(ctx, left.tolist(), strict=True)):
            whole = np.frombuffer(c, np.uint8)
            right_rows[i, : len(c) - k] = whole[k:]
            left_rows[i, :k] = whole[:k][::-1]
        right_order, right_same = row_order(right_rows)
        left_order, left_same = row_order(left_rows)
        right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
        for o in range(REACH + 1):
            right_class[right_order] = np.cumsum(right_same < LENGTH - o)
            use = np.flatnonzero(inside[:, o])
            shared = np.bincount(right_class[use], minlength=n + 1) if len(use) else None
            if shared is None or not (shared > 1).any():
                continue
            use = use[shared[right_class[use]] > 1]
            left_class[left_order] = np.cumsum(left_same < o) if o else 0
            key = (right_class[use] * (n + 1) + left_class[use]) * 64 + np.maximum(part[use], -1) + 1
            _, where, count = np.unique(key, return_inverse=True, return_counts=True)
            again[use[count[where] > 1], o] = True
    out = []
    for i in range(n):
        at = np.flatnonzero(again[i])
        if not len(at):
            out.append([])
            continue
        gap = np.flatnonzero(np.diff(at) > 1)
        lows, highs = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)]
        out.append([int(v) for low, high in zip(lows, highs, strict=True) for v in (left[i] - high, left[i] - low + LENGTH)])
    return out


def found_parts(distinct: DataFrame) -> DataFrame:
    """h, x1, x2, parts of the surroundings (h, x1, x2, left, ctx, c) that hold a repeated string."""
    large = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("h", F.lit(True).alias("large"))
    both = distinct.join(large, "h", "left")
    low = F.expr(f"({LENGTH} - (octet_length(ctx) - left)) DIV {PART}")
    both = both.withColumn("part", F.explode(F.when(F.col("large"), F.sequence(low, F.expr(f"left DIV {PART}").cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))))
    core = F.expr(f"substring(ctx, CAST(left - part * {PART} + 1 AS INT), {LENGTH - PART + 1})")
    both = both.withColumn("key", F.when(F.col("part") < 0, F.col("h")).otherwise(F.xxhash64("h", "part", core)))
    dealt = both.select("key", "h", "x1", "x2", "left", "ctx", (F.col("c") > 1).alias("several"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, "key"):
            edge = bounds(batch.column("key").to_numpy(zero_copy_only=False))
            at = 0
            while at < len(edge) - 1:
                to = max(at + 1, int(np.searchsorted(edge, edge[at] + BATCH, "right")) - 1)
                some = batch.slice(edge[at], edge[to] - edge[at])
                at = to
                parts = repeated_parts(
                    some.column("left").to_numpy(zero_copy_only=False).astype(np.int64), some.column("ctx").to_pylist(), some.column("several").to_numpy(zero_copy_only=False).astype(bool), some.column("part").to_numpy(zero_copy_only=False)
                )
                got = np.array([bool(p) for p in parts])
                out = pa.RecordBatch.from_arrays([some.column("h"), some.column("x1"), some.column("x2"), pa.array(parts, pa.list_(pa.int32()))], ["h", "x1", "x2", "parts"])
                yield out.filter(pa.array(got))

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "h long, x1 long, x2 long, parts array<int>")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, t, spans (struct begin, end; may overlap) of every document with bytes that a repeated string covers."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND octet_length(text) > 0").select("doc_id", F.xxhash64("text").alias("t"), "text")
    anchored = save(repeated_anchors(rows), f"{folder}/anchors")
    release(spark)
    around = save(surroundings(rows, anchored), f"{folder}/surroundings")
    release(spark)
    around = around.withColumns({"x1": F.xxhash64("left", "ctx"), "x2": F.xxhash64(F.lit("x"), "ctx", "left")})
    distinct = around.groupBy("h", "x1", "x2").agg(F.count(F.lit(1)).alias("c"), F.first("left").alias("left"), F.first("ctx").alias("ctx"))
    distinct = save(distinct, f"{folder}/distinct")
    release(spark)
    parts = save(found_parts(distinct), f"{folder}/parts")
    release(spark)
    spans = around.select("h", "x1", "x2", "doc_id", "t", "begin").join(parts, ["h", "x1", "x2"])
    spans = spans.select("doc_id", "t", F.explode(F.expr("transform(sequence(0, size(parts) - 2, 2), i -> struct(begin + parts[i] AS begin, begin + parts[i + 1] AS end))")).alias("s"))
    return spans.groupBy("doc_id", "t").agg(F.collect_list("s").alias("spans"))


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every row.

    Null and empty texts, texts of less than LENGTH bytes and rows with a null id lose nothing and take no part. Equal rows are one document, so they aren't repeats
    of each other; rows with one id and different texts are different documents. kept is binary: what is left need not be valid UTF-8."""
    spans = repeated_spans(docs).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("spans.begin").alias("_b"), F.col("spans.end").alias("_e"))
    both = docs.select("doc_id", "text").join(spans, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left").select("doc_id", "text", "_b", "_e")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = X.flat(batch.column(1))
        begins, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        kept, removed, count = [], [], []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            if begins[i]:
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, begins[i], 1)
                np.add.at(change, ends[i], -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                count.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                own = own[~gone]
            else:
                removed.append(0)
                count.append(0)
            kept.append(own.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return X.map_arrow(both, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' removed bytes and the SHA-256 of what is kept; the cases are those of kept_texts()."""
    out = kept_texts(X.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
