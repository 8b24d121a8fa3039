"""Passages of benchmark items inside form texts, by binary search in suffix arrays of the texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import LOWER, RangeHash, add_columns, append, hashes_of, ragged, runs, slices, text_bytes

BLOCK_BYTES = 16 << 20
# Word characters after lower-casing: digits, letters and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
COLUMNS = ("n_words bigint, n_hit bigint, hit_spans array<struct<start:bigint,end:bigint>>, item_ids array<bigint>, "
           "longest_match struct<item_id:bigint,item_word:bigint,entry_word:bigint,n_words:bigint>")
NEW = ["n_words", "n_hit", "hit_spans", "item_ids", "longest_match"]


@dataclass
class Words:
    """The words of many texts as 64-bit hashes, one text after the other."""

    hashes: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        data = LOWER[data]
        starts, ends = runs(_WORD[data], offsets)
        return Words(hashes_of(data, starts, ends), np.searchsorted(starts, offsets))

    def left(self) -> np.ndarray:
        """For each word the number of words from it to the end of its text."""
        sizes = np.diff(self.offsets)
        return np.repeat(self.offsets[1:], sizes) - np.arange(len(self.hashes))


def suffix_array(words: Words, depth: int) -> np.ndarray:
    """Positions ordered by the words from there to the end of the text, at least to ``depth`` words (by doubling)."""
    n = len(words.hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    left = words.left()
    _, rank = np.unique(words.hashes, return_inverse=True)
    rank, done = rank.astype(np.uint64) + np.uint64(1), 1
    while done < depth:
        then = np.zeros(n, np.uint64)
        then[:-done or None] = np.where(left[: n - done] > done, rank[done:], 0) if done < n else 0
        keys = rank << np.uint64(32) | then
        order = np.argsort(keys)
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        done *= 2
        if new.all():
            break
    return np.argsort(rank)


@dataclass
class Block:
    """A bounded part of the benchmark: its words and its distinct windows."""

    words: Words
    item_ids: np.ndarray
    has_id: np.ndarray
    start: np.ndarray
    length: np.ndarray
    items_of: np.ndarray
    items_at: np.ndarray

    @staticmethod
    def of(ids: list[int | None], texts: list[str | None], width: int) -> Block:
        words = Words.of(*text_bytes(pa.array(texts, pa.string())))
        sizes = np.diff(words.offsets)
        counts = np.where(sizes > width, sizes - width + 1, np.minimum(sizes, 1))
        start = ragged(words.offsets[:-1], counts)
        item = np.repeat(np.arange(len(sizes)), counts)
        length = np.minimum(sizes, width)[item]
        same = RangeHash(words.hashes).of(start, start + length)
        _, first, window = np.unique(same, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack((window, item)), axis=1)
        at = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        has_id = np.array([i is not None for i in ids], bool)
        return Block(words, np.array([i or 0 for i in ids], np.int64), has_id, start[first], length[first], pairs[1], at)


def search(text: Words, order: np.ndarray, block: Block, upper: bool) -> np.ndarray:
    """For each window the first place in the suffix array whose suffix is not below it (or, ``upper``, is above all
    that begin with it). All windows are searched at once; suffixes are compared word by word."""
    left = text.left()
    low, high = np.zeros(len(block.start), np.int64), np.full(len(block.start), len(order), np.int64)
    while (todo := np.flatnonzero(low < high)).size:
        mid = (low[todo] + high[todo]) // 2
        at, window = order[mid], todo
        below = np.full(len(todo), upper)
        open_ = np.arange(len(todo))
        depth = 0
        while open_.size:
            ended = left[at[open_]] <= depth
            below[open_[ended]] = True
            open_ = open_[~ended]
            a, b = text.hashes[at[open_] + depth], block.words.hashes[block.start[window[open_]] + depth]
            below[open_[a != b]] = (a < b)[a != b]
            depth += 1
            open_ = open_[(a == b) & (block.length[window[open_]] > depth)]
        low[todo] = np.where(below, mid + 1, low[todo])
        high[todo] = np.where(below, high[todo], mid)
    return low


def _scan(text: Words, block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit words, and the (text, window, position) of all occurrences of windows."""
    order = suffix_array(text, width)
    low, high = search(text, order, block, False), search(text, order, block, True)
    window = np.repeat(np.arange(len(low)), high - low)
    position = order[ragged(low, high - low)]
    return window, position, np.searchsorted(text.offsets, position, side="right") - 1


def _longest(text: Words, block: Block, window: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Number of words that stay equal from each occurrence on."""
    start, size = block.start[window], block.length[window].copy()
    left, rest = text.left()[position], block.words.left()[start]
    going = np.arange(len(window))
    while (going := going[(size[going] < left[going]) & (size[going] < rest[going])]).size:
        at = size[going]
        going = going[text.hashes[position[going] + at] == block.words.hashes[start[going] + at]]
        size[going] += 1
    return size


def _with_block(entries: DataFrame, block: Block, text: str, width: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words.of(*text_bytes(batch.column(text)))
            window, position, row = _scan(words, block, width)
            size = _longest(words, block, window, position)
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edge, position, 1)
            np.add.at(edge, position + block.length[window], -1)
            starts, ends = runs(np.cumsum(edge)[:-1] > 0, words.offsets)
            span_row = np.searchsorted(words.offsets, starts, side="right") - 1
            pairs = np.unique(np.stack((row, window)), axis=1)
            counts = np.diff(block.items_at)[pairs[1]]
            items = np.unique(np.stack((np.repeat(pairs[0], counts), block.items_of[ragged(block.items_at[pairs[1]], counts)])), axis=1)
            items = items[:, block.has_id[items[1]]]
            # Of the longest matches in a text the first one in it.
            best = np.lexsort((position, -size, row))
            best = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))] if len(best) else best
            of_row = dict(zip(row[best].tolist(), best.tolist(), strict=True))
            cuts = [np.searchsorted(x, np.arange(batch.num_rows + 1)) for x in (span_row, items[0])]
            spans_out, items_out, longest_out, n_hit = [], [], [], []
            block_item = np.searchsorted(block.words.offsets, block.start, side="right") - 1
            for i in range(batch.num_rows):
                a, b = cuts[0][i], cuts[0][i + 1]
                spans = list(zip((starts[a:b] - words.offsets[i]).tolist(), (ends[a:b] - words.offsets[i]).tolist(), strict=True))
                ids = set(block.item_ids[items[1][cuts[1][i]: cuts[1][i + 1]]].tolist())
                match = None
                if i in of_row:
                    k = of_row[i]
                    w = window[k]
                    match = {"item_id": int(block.item_ids[block_item[w]]) if block.has_id[block_item[w]] else None,
                             "item_word": int(block.start[w] - block.words.offsets[block_item[w]]),
                             "entry_word": int(position[k] - words.offsets[i]), "n_words": int(size[k])}
                spans_out.append([{"start": s, "end": e} for s, e in spans])
                n_hit.append(sum(e - s for s, e in spans))
                items_out.append(sorted(ids))
                longest_out.append(match)
            made = {"n_words": pa.array(np.diff(words.offsets)), "n_hit": pa.array(n_hit, pa.int64()),
                    "hit_spans": pa.array(spans_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "item_ids": pa.array(items_out, pa.list_(pa.int64())),
                    "longest_match": pa.array(longest_out, pa.struct([(n, pa.int64()) for n in ("item_id", "item_word", "entry_word", "n_words")]))}
            yield append(batch, made)

    return add_columns(entries, COLUMNS, make)


def _with_word_counts(entries: DataFrame, text: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield append(batch, {"n_words": pa.array(np.diff(Words.of(*text_bytes(batch.column(text))).offsets))})

    return add_columns(entries, "n_words bigint", make)


def with_benchmark_matches(entries: DataFrame, items: DataFrame, text: str = "full_text", item_key: str = "item_id",
                           item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append to each form entry what it shares with the benchmark ``items``: ``n_words``, ``n_hit``, ``hit_spans``
    (word ranges), ``item_ids`` (sorted) and ``longest_match`` (the longest verbatim match and where it is). That match
    holds a whole window and is extended from the first place of the window in its block of the items only: a longer
    match with a later item that has the same window, or one shorter than a window of its item, is not given there.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased, of the whole text, compared by
    64-bit hashes. A window is ``width`` consecutive words of an item; a shorter item with words is one window. A
    word of an entry is hit if an occurrence of a window covers it.

    Each task cuts its entries into shards of a few MB, builds the suffix array of each shard and searches all
    windows in it at once. The items come in blocks of about ``block_bytes`` of text, measured before, whose windows
    go to every task. No row is shuffled. Beyond one block the entries are stored once and each block's finds (rows with a
    hit) are stored before the next block is fetched, then joined to the entries by row.

    Null or empty texts have no words and no hits. A null item text has no windows; an item without key marks words
    but is not listed; items that share a key are one item. No items, no hits. Every input row gives one row,
    repeated rows too; columns named like the new ones are replaced, all others stay.
    """
    rows = items.select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        # Too large for one block: deal the items out, each block is fetched by itself.
        rows = rows.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    def block(part: DataFrame) -> Block:
        held = part.select("id", "t").toArrow()
        return Block.of(held.column("id").to_pylist(), held.column("t").to_pylist(), width)

    if blocks == 1:
        return _with_block(entries, block(rows), text, width)
    # One block after the other: what it finds is stored, then it is dropped, so the driver holds one.
    names = [n for n in entries.columns if n not in NEW]
    numbered = materialize(entries.select(*[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)]).withColumn(
        "_row", F.monotonically_increasing_id()))
    texts = numbered.select("_row", F.col(f"_{names.index(text)}").alias("_text"))
    found = None
    for b in range(blocks):
        one = _with_block(texts, block(rows.where(F.col("b") == b)), "_text", width).where("n_hit > 0")
        one = materialize(one.select("_row", "hit_spans", "item_ids", "longest_match"))
        found = one if found is None else found.unionAll(one)
    merged = _merged(found)
    empty = [F.col(n) if n == "longest_match" else F.coalesce(n, F.lit(0).cast("bigint") if n == "n_hit" else F.array().cast(merged.schema[n].dataType)).alias(n)
             for n in NEW[1:]]
    counted = _with_word_counts(numbered, f"_{names.index(text)}")
    return counted.join(merged, "_row", "left").select(
        *[F.col(f"_{i}").alias(n) for i, n in enumerate(names)], "n_words", *empty)


def _merged(found: DataFrame) -> DataFrame:
    """What several blocks found in each row as one: a row has as many parts as there are blocks, at most."""
    match = F.col("longest_match")
    both = found.groupBy("_row").agg(
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.min_by(match, F.when(match.isNotNull(), F.struct(-match["n_words"], match["entry_word"], match))).alias("longest_match"))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def extend(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        meets = (F.size(done) > 0) & (span["start"] <= last["end"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    spans = F.aggregate("_spans", start, extend)
    size = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return both.withColumn("hit_spans", spans).select("_row", size.alias("n_hit"), "hit_spans", "item_ids", "longest_match")


def benchmark_matches(entries: DataFrame, items: DataFrame, key: str = "entry_id", text: str = "full_text",
                      **options) -> DataFrame:
    """The columns of ``with_benchmark_matches`` by entry key, and ``contaminated`` (any word is hit)."""
    rows = entries.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = with_benchmark_matches(rows, items, "_text", **options)
    return found.select(F.col("_key").alias(key), "n_words", "n_hit", "hit_spans", "item_ids", "longest_match",
                        (F.col("n_hit") > 0).alias("contaminated"))


def uncontaminated(entries: DataFrame, items: DataFrame, text: str = "full_text", **options) -> DataFrame:
    """The entries that share no window with any item, with their columns as they are."""
    names = entries.columns
    inner = entries.select(*[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)])
    found = with_benchmark_matches(inner, items, f"_{names.index(text)}", **options)
    return found.where("n_hit = 0").select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
