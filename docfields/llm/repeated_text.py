"""Byte strings that stand more than once in the texts of forms, from an enhanced suffix array of sampled places."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import RangeHash, fixed_hashes, mix, slices, text_bytes, window_min

LENGTH = 400
LARGEST_GROUP = 20_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Places (text, position, first and last offset, gram hash, hull hash) that stand for all windows of ``length``.

    The anchor of a window is the start of its smallest half-length gram (by hash, the leftmost of equals), so equal
    windows have their anchor at the same offset. Consecutive windows with the same anchor form one row: they start
    ``first`` to ``last`` bytes before it. The gram is what they all share, the hull all that they cover.
    """
    gram = length // 2
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    hashes = fixed_hashes(data, gram)
    bits = np.uint64(n.bit_length())
    ranked = (hashes >> bits) << bits | np.arange(len(hashes), dtype=np.uint64)
    anchor = (window_min(ranked, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)] - np.arange(len(anchor))
    whole = left >= length
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | ~whole[:-1])) & whole
    start = np.flatnonzero(new)
    ended = np.concatenate((new[1:] | ~whole[1:], [True])) & whole
    end = np.flatnonzero(ended)
    at = anchor[start]
    text = np.searchsorted(offsets, start, side="right") - 1
    hull = mix(RangeHash(data).of(start, end + length) ^ (at - start).astype(np.uint64))
    return text, at - offsets[text], at - end, at - start, hashes[at], hull


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            text, at, first, last, gram, hull = anchors(*text_bytes(batch.column("_text")), length)
            row = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(row), batch.column("_hash").take(row), pa.array(gram.view(np.int64)),
                 pa.array(hull.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at, first, last))],
                names=["_id", "_hash", "gram", "hull", "at", "first", "last"])

    return rows.mapInArrow(make, f"_id {dict(rows.dtypes)['_id']}, _hash bigint, gram bigint, hull bigint, at int, first int, last int")


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for the shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "_text"):
            held = [pack((t or "").encode()) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_hash"), pa.array(held, pa.binary())],
                                             names=["_id", "_hash", "packed"])

    return rows.mapInArrow(make, f"_id {dict(rows.dtypes)['_id']}, _hash bigint, packed binary")


def _same_entry(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_hash"] == b["_hash"])


def _contexts(packed: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The bytes around one place of each hull: all that its windows cover, left and right of the anchor."""
    # Bounded by the number of anchors in one text.
    wanted = places.groupBy("_id", "_hash").agg(F.collect_list(F.struct("gram", "hull", "n", "at", "first", "last")).alias("places"))
    both = packed.join(wanted, _same_entry(packed, wanted)).select("packed", "places")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["gram", "hull", "n", "first", "last"]
        for batch in batches:
            for raw, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpack(raw)
                columns = [pa.array([p[c] for p in found], pa.int64() if c in ("gram", "hull", "n") else pa.int32()) for c in names]
                columns += [pa.array([text[p["at"] - p["last"]: p["at"]] for p in found], pa.binary()),
                            pa.array([text[p["at"]: p["at"] - p["first"] + length] for p in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "before", "after"])

    return both.mapInArrow(make, "gram bigint, hull bigint, n bigint, first int, last int, before binary, after binary")


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def scan_group(after: list[bytes], before: list[bytes], first: list[int], last: list[int], length: int) -> list[tuple[int, int] | None]:
    """For each suffix of one group, sorted by ``after``: the smallest and the largest offset of a window around its
    anchor that stands around another one too; None if there is none.

    The suffixes are leaves of the tree of common-prefix intervals, which one scan with a stack walks bottom-up. In
    an interval of depth d any two suffixes from different children share d bytes to the right, so what decides is
    how far they agree to the left: the members are kept in the order of their reversed left sides, and the smaller
    child is merged into the larger. Only neighbours in that order need to be compared.
    """
    m = len(after)
    mirrored = [b[::-1] for b in before]
    order = sorted(range(m), key=mirrored.__getitem__)
    rank = [0] * m
    for r, i in enumerate(order):
        rank[i] = r
    found: list[tuple[int, int] | None] = [None] * m

    def note(i: int, low: int, high: int) -> None:
        low, high = max(low, first[i]), min(high, last[i])
        if low <= high:
            held = found[i]
            found[i] = (min(low, held[0]), max(high, held[1])) if held else (low, high)

    def merge(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            at = bisect_left(a, r)
            for near in a[max(at - 1, 0): at + 1]:
                same = common_prefix(mirrored[order[r]], mirrored[order[near]])
                if same + depth >= length:
                    note(order[r], length - depth, same)
                    note(order[near], length - depth, same)
            a.insert(at, r)
        return a

    stack: list[tuple[int, list[int]]] = []
    held = [rank[0]]
    for i in range(1, m + 1):
        depth = common_prefix(after[i - 1], after[i]) if i < m else -1
        while stack and stack[-1][0] > depth:
            d, members = stack.pop()
            held = merge(members, held, d)
        if i == m:
            break
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, merge(stack[-1][1], held, depth))
        else:
            stack.append((depth, held))
        held = [rank[i]]
    return found


def _scanned(rows: DataFrame, length: int) -> DataFrame:
    """Rows (gram, hull, low, high): the repeated offsets of each hull, found within its bucket."""
    columns = ["bucket", "gram", "hull", "own", "first", "last", "before", "after"]

    def work(held: list[tuple]) -> list[tuple]:
        if len(held) < 2:
            return []
        found = scan_group([h[7] for h in held], [h[6] for h in held], [h[4] for h in held], [h[5] for h in held], length)
        return [(h[1], h[2], *f) for h, f in zip(held, found, strict=True) if f]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += work(held)
                    held = []
                # Repeated rows of one entry give the same hull twice; it is one place to compare with.
                if not held or held[-1][3] != row[3]:
                    held.append(row)
            yield _ranges(out)
        yield _ranges(work(held))

    dealt = rows.select(columns).repartition("bucket").sortWithinPartitions("bucket", "after", "own")
    return dealt.mapInArrow(make, "gram bigint, hull bigint, low int, high int")


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["gram", "hull", "low", "high"])


def _offsets(contexts: DataFrame, length: int, largest: int) -> DataFrame:
    """Repeated offsets of all hulls that share their gram with another hull.

    A group of at most ``largest`` hulls is scanned in one task. A larger group is split by offset: the windows of
    the lower and of the upper half of the offsets have a longer string in common, by which they are dealt out
    anew, and hulls that are now equal are one. Once a half is one offset, all of a group is equal, so this ends.
    """
    done = None
    level = contexts.select("*", F.col("gram").alias("bucket"), F.col("hull").alias("own"), F.lit(0).alias("low"),
                            F.lit(length - length // 2).alias("high"))
    while True:
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
        large = materialize(sizes.where(F.col("size") > largest))
        none = large.isEmpty()
        small = level if none else level.join(large, "bucket", "left_anti")
        part = _scanned(small, length)
        done = part if done is None else done.unionAll(part)
        if none:
            return done
        halves = F.explode(F.array(F.struct(F.col("low").alias("a"), F.expr("(low + high) div 2").cast("int").alias("b")),
                                   F.struct(F.expr("(low + high) div 2 + 1").cast("int").alias("a"), F.col("high").alias("b"))))
        split = level.join(large.select("bucket"), "bucket").select("*", halves.alias("h")).where("h.a <= h.b AND h.a <= last AND h.b >= first")
        near, far = F.greatest("h.a", "first"), F.least("h.b", "last")
        core = F.concat(F.expr("substring(before, length(before) - h.a + 1, h.a)"), F.expr(f"substring(after, 1, {length} - h.b)"))
        split = split.select(
            "gram", "hull", "n", near.cast("int").alias("first"), far.cast("int").alias("last"), "before", "after",
            F.xxhash64("bucket", "h.a", core).alias("bucket"), F.col("h.a").alias("low"), F.col("h.b").alias("high"))
        split = split.select(
            "gram", "hull", "n", "first", "last", "bucket", "low", "high",
            F.expr("substring(before, length(before) - last + 1, last)").alias("before"),
            F.expr(f"substring(after, 1, {length} - first)").alias("after"))
        split = materialize(split.withColumn("own", F.xxhash64("first", "last", "before", "after")))
        equal = split.groupBy("bucket", "own").agg(F.sum("n").alias("total"), F.min(F.struct("gram", "hull")).alias("one"))
        both = materialize(split.join(equal, ["bucket", "own"]))
        done = done.unionAll(both.where("total > 1").select("gram", "hull", F.col("first").alias("low"), F.col("last").alias("high")))
        # One hull stands for equal ones; if it was cut to the same string twice, it is still one.
        level = both.where(F.struct("gram", "hull") == F.col("one")).withColumn("n", F.col("total")).select(level.columns)
        level = level.dropDuplicates(["bucket", "own"])


def repeated_spans(entries: DataFrame, key: str = "entry_id", text: str = "full_text", length: int = LENGTH,
                   largest_group: int = LARGEST_GROUP) -> DataFrame:
    """One row (key, n_bytes, n_removed, spans, kept) per form entry: the byte ranges to remove, and what is left.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in the same entry or
    in another one; overlapping occurrences count, and no string reaches over the end of a text. Strings are judged
    on the input. ``spans`` are the maximal removed ranges; ``kept`` is binary, as a range may end inside a character.

    Sampled places (anchors) stand for all windows; those whose gram stands only once are dropped by a count. Hulls
    that are equal are repeated as a whole. The others meet in the group of their gram: a suffix array with the tree
    of its common-prefix intervals.

    Null and empty texts have no bytes and nothing removed. Each input row counts as a text of its own, so a repeated
    row makes its text repeated. Null keys stay; extra columns are ignored. No rows give no rows.
    """
    rows = entries.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"), F.col(text).alias("_text"))
    found = materialize(_anchor_rows(rows, length))
    often = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("hull").alias("a"), F.max("hull").alias("b"))
    # Stored, so that the join reads two shuffled tables and can split a gram that is very frequent.
    often = materialize(often.where("n > 1").select("gram", (F.col("a") < F.col("b")).alias("varied")))
    shared = materialize(found.join(often, "gram"))
    place = F.struct("_id", "_hash", "at", "first", "last")
    hulls = materialize(shared.groupBy("gram", "hull", "varied").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")))
    packed = _packed(rows)
    contexts = materialize(_contexts(packed, hulls.where("varied").select("gram", "hull", "n", "place.*"), length))
    scanned = _offsets(contexts, length, largest_group).groupBy("gram", "hull").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = hulls.where("n > 1").select("gram", "hull", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    single = hulls.where("n = 1 AND varied").select("gram", "hull")
    decided = materialize(whole.unionAll(scanned.join(single, ["gram", "hull"]).select("gram", "hull", "low", "high")))
    spans = shared.join(decided, ["gram", "hull"]).select(
        "_id", "_hash", F.struct((F.col("at") - F.coalesce("high", "last")).alias("start"),
                                 (F.col("at") - F.coalesce("low", "first") + length).alias("end")).alias("span"))
    # Bounded by the number of anchors in one text.
    spans = spans.groupBy("_id", "_hash").agg(F.collect_set("span").alias("spans"))
    both = packed.join(spans, _same_entry(packed, spans), "left").select(packed["_id"], "packed", "spans")
    return _cut(both).withColumnRenamed("_id", key)


def _cut(rows: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, joined, kept = [], [], [], []
            for raw, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, runs = unpack(raw), []
                for s in sorted(spans or (), key=lambda s: s["start"]):
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                ends = [0, *(r["end"] for r in runs)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, [*(r["start"] for r in runs), len(text)], strict=True)))
                sizes.append(len(text))
                removed.append(sum(r["end"] - r["start"] for r in runs))
                joined.append(runs)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(joined, span),
                 pa.array(kept, pa.binary())], names=["_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(make, f"_id {dict(rows.dtypes)['_id']}, n_bytes bigint, n_removed bigint, "
                                 "spans array<struct<start:bigint,end:bigint>>, kept binary")
