"""SimHash near-duplicates of form texts, found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import add_columns, append, slices
from docfields.llm.graph import components


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, A-Z lower-cased; fewer words are one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bit is 1 where over half of the hashes have a 1; 0 for no hashes. As a signed bigint."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at: at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def with_fingerprint(entries: DataFrame, text: str = "full_text", width: int = 3) -> DataFrame:
    """Append ``fingerprint`` (bigint, the 64 bits) to every row; a text without words has fingerprint 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = [majority_bits(shingle_hashes((t or "").encode(), width)) for t in batch.column(text).to_pylist()]
            yield append(batch, {"fingerprint": pa.array(made, pa.int64())})

    return add_columns(entries, "fingerprint bigint", make)


class BKTree:
    """Fingerprints; the children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            below = node[1].get(d)
            if below is None:
                node[1][d] = (value, {})
                return
            node = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Stored values at most ``radius`` away; only edges within the radius of the distance are followed."""
        todo = [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield at
            todo += [child for key, child in children.items() if d - radius <= key <= d + radius]


def _linked(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the values: at most one pair for each value."""
    tree, head = BKTree(), {}

    def top(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for value in values:
        head[value] = value
        for near in tree.within(value, radius):
            a, b = top(near), top(value)
            if a != b:
                head[max(a, b)] = min(a, b)
                yield value, near
        tree.add(value)


def fingerprint_links(fingerprints: DataFrame, radius: int = 2, blocks: int = 7) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most ``radius`` bits apart, without all pairs.

    Two such fingerprints agree on all but ``radius`` of the bit blocks. So every fingerprint goes to one shard for
    each choice of ``blocks - radius`` blocks, namely that of its bits there, and each shard has a BK-tree. A shard
    holds fingerprints that differ in ``radius`` blocks only: with 7 blocks at most 2**19 of them, however many rows
    there are. A tree of all fingerprints has no such bound, which is why trees are not broadcast but stand where
    their shard is. A shard returns a spanning forest of its links.
    """
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    masks = []
    for free in combinations(range(blocks), radius):
        mask = (1 << 64) - 1
        for i in free:
            mask &= ~(((1 << int(edges[i + 1] - edges[i])) - 1) << int(edges[i]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shards = F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits"))
        for i, m in enumerate(masks)]))
    spread = fingerprints.select("fingerprint").distinct().select("fingerprint", shards.alias("s"))
    spread = spread.select("s.table", "s.bits", "fingerprint").repartition("table", "bits")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple | None, list[int]] = (None, [])

        def out(values: list[int]) -> list[tuple[int, int]]:
            return list(_linked(values, radius)) if len(values) > 1 else []

        for batch in batches:
            table, bits, fp = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((table[1:] != table[:-1]) | (bits[1:] != bits[:-1])) + 1
            cuts = [0, *new.tolist(), len(fp)]
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if b - a == 1 and 0 < a and b < len(fp):
                    if held[1]:
                        found += out(held[1])
                        held = (None, [])
                    continue
                key = (table[a], bits[a])
                if key != held[0]:
                    found += out(held[1])
                    held = (key, [])
                held[1].extend(fp[a:b].tolist())
            yield _pairs(found)
        yield _pairs(out(held[1]))

    return spread.sortWithinPartitions("table", "bits", "fingerprint").mapInArrow(walk, "a bigint, b bigint").distinct()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = ([x[i] for x in found] for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicate_entries(entries: DataFrame, key: str = "entry_id", text: str = "full_text", width: int = 3,
                           radius: int = 2) -> DataFrame:
    """Classes of form entries with nearly the same text: one row (key, fingerprint, component_id) per input row.

    A fingerprint bit is the majority of that bit over the XXH64 of all ``width``-word shingles, repeats included.
    Entries link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest key that
    links reach, the entry itself included.

    Null or empty texts and texts of white space have fingerprint 0 and link like any other. A null key stays, and
    never is a component_id unless the whole component has none. Repeated rows stay repeated. Extra columns are
    ignored, whatever their names. No rows give no rows.
    """
    rows = entries.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = materialize(with_fingerprint(rows, "_text", width).select("_key", "fingerprint"))
    first = materialize(rows.groupBy("fingerprint").agg(F.min("_key").alias("low")))
    roots = components(fingerprint_links(first, radius)).withColumnRenamed("node", "fingerprint")
    roots = materialize(first.join(roots, "fingerprint", "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(roots.join(lows, "root").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select(F.col("_key").alias(key), "fingerprint", "component_id")


def representatives(entries: DataFrame, key: str = "entry_id", text: str = "full_text") -> DataFrame:
    """One entry of each class stays, that with the smallest key; all columns are kept.

    Entries without a key stay: nothing tells them apart. Rows that repeat the key of a representative stay too.
    """
    classes = near_duplicate_entries(entries.where(F.col(key).isNotNull()), key, text)
    gone = classes.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return entries.join(gone, entries[key] == F.col("_gone"), "left_anti")
