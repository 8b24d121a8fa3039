"""Runs of lines that stand in several form texts, found by exact grouping of window hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import RangeHash, append, hashes_of, mix, ragged, runs, slices, text_bytes, window_min

LONG_WORDS = 20
_INK = np.ones(256, bool)
_INK[[0x20, *range(0x09, 0x0E)]] = False


def line_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts (without the line feeds), and the offsets of each text's lines.

    An empty text has no line; a line feed at the end of a text starts one more line, an empty one.
    """
    feeds = np.flatnonzero(data == 10)
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.sort(np.concatenate((feeds + 1, filled)))
    tail = offsets[1:][np.diff(offsets) > 0]
    ends = np.sort(np.concatenate((feeds, tail)))
    # A text that ends in a line feed has an empty last line; it starts where the next text starts.
    row = np.concatenate((np.searchsorted(offsets, feeds, side="right") - 1, np.flatnonzero(np.diff(offsets) > 0)))
    return starts, ends, np.searchsorted(np.sort(row), np.arange(len(offsets)))


def winnow(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``width`` lines: its start, its number of lines, and the line whose hash is smallest (the
    leftmost of equals). A text of fewer lines is one window."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    starts = ragged(offsets[:-1], counts)
    length = np.minimum(sizes, width)[np.repeat(np.arange(len(sizes)), counts)]
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    ranked = (mix(hashes) >> bits) << bits | np.arange(len(hashes), dtype=np.uint64)
    mark = np.zeros(len(starts), np.int64)
    full = length == width
    mark[full] = (window_min(ranked, width)[starts[full]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for i in np.flatnonzero(~full).tolist():
        mark[i] = starts[i] + int(np.argmin(ranked[starts[i]: starts[i] + length[i]]))
    return starts, length, mark


def long_windows(data: np.ndarray, offsets: np.ndarray, lines: np.ndarray, starts: np.ndarray, width: int,
                 long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of fewer than ``width`` lines with ``long_words`` or more words. Runs of a whole
    text are left out, as ``winnow`` has them."""
    first = runs(_INK[data], offsets)[0]
    before = np.searchsorted(first, np.concatenate((starts, [len(data)])))
    sizes = np.diff(lines)
    left = np.repeat(lines[1:], sizes) - np.arange(len(starts))
    total = np.repeat(sizes, sizes)
    at, length = [], []
    for n in range(1, width):
        found = np.flatnonzero(left >= n)
        found = found[(before[found + n] - before[found] >= long_words) & (total[found] > n)]
        at.append(found)
        length.append(np.full(len(found), n))
    return np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*length, np.zeros(0, np.int64)]).astype(np.int64)


def _marked(entries: DataFrame, width: int, long_words: int) -> DataFrame:
    """Rows (entry, smallest line, run of lines around it) of all windows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = text_bytes(batch.column("_text"))
            starts, ends, lines = line_ranges(data, offsets)
            hashes = hashes_of(data, starts, ends)
            at, size, mark = winnow(hashes, lines, width)
            more, length = long_windows(data, offsets, lines, starts, width, long_words)
            # A short run is found by itself: its first line stands for it, in short texts, too.
            mark = np.where(size < width, at, mark)
            at, size, mark = (np.concatenate(x) for x in ((at, more), (size, length), (mark, more)))
            run = RangeHash(hashes).of(at, at + size)
            row = np.searchsorted(lines, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(row)), batch.column("_hash").take(pa.array(row)),
                 pa.array(hashes[mark].view(np.int64)), pa.array(run.view(np.int64)),
                 pa.array((at - lines[row]).astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["_id", "_hash", "mark", "run", "start", "size"])

    return entries.mapInArrow(make, f"_id {dict(entries.dtypes)['_id']}, _hash bigint, mark bigint, run bigint, start int, size int")


def repeated_runs(entries: DataFrame, key: str = "entry_id", text: str = "full_text", width: int = 3,
                  long_words: int = LONG_WORDS) -> DataFrame:
    """Runs of ``width`` lines, or of fewer with ``long_words`` words, that stand earlier too: rows (_id, _hash, start,
    size), by entry and first line.

    Windows are grouped by the hash of their run of lines, and by its smallest line hash, which follows from the run:
    plain grouping in place of winnowing, as nothing is thinned out or extended. The first occurrence of each run (by
    key, then text hash, then line) keeps
    it. First places are a minimum per run, combined before the shuffle; the comparison with them is
    a join, which can be split if one run is very frequent.
    """
    rows = entries.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"), F.col(text).alias("_text"))
    marked = _marked(rows, width, long_words)
    place = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_hash", "start")
    first = marked.groupBy("mark", "run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Stored, so that the join reads two shuffled tables and can split a run that is very frequent.
    first = materialize(first.select("mark", "run", "first"))
    both = marked.join(first, ["mark", "run"])
    return both.where(place > F.col("first")).select("_id", "_hash", "start", "size")


def deduplicated_lines(entries: DataFrame, key: str = "entry_id", text: str = "full_text", width: int = 3,
                       long_words: int = LONG_WORDS) -> DataFrame:
    """The form entries with their columns, ``text`` without the repeated lines, and ``n_removed_lines`` appended.

    A line is deleted if it lies in a run of ``width`` (or more) lines that stands verbatim earlier: in an entry with
    a smaller key (null keys last), or further up in the same entry. The first occurrence of each run stays. Fewer than
    ``width`` lines are such a run, too, if they hold ``long_words`` or more words (runs of bytes other than ASCII
    white space). A text of fewer than ``width`` lines is one run as a whole; if it has fewer words, only equal whole
    texts are its copies. Lines are split at line feeds and compared exactly as they are, by 64-bit hashes.

    Null texts stay null, empty ones empty. Rows that repeat both key and text are one entry: all keep the same
    lines. A text all of whose lines are deleted becomes empty. Extra columns stay, whatever their names; a column
    ``n_removed_lines`` is replaced. No rows give no rows.
    """
    names = [n for n in entries.columns if n != "n_removed_lines"]
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    rows = entries.select(*[F.col(f"`{n}`").alias(at[n]) for n in names]).withColumn(
        "_h", F.xxhash64(F.coalesce(at[text], F.lit(""))))
    found = repeated_runs(rows, at[key], at[text], width, long_words)
    # One list of runs per entry: it is bounded by the entry's own number of lines.
    gone = found.groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "size")).alias("_runs"))
    both = rows.join(gone, F.col(at[key]).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    kept = _without_lines(both.drop("_id", "_hash", "_h"), at[text])
    return kept.select(*[F.col(at[n]).alias(n) for n in names], "n_removed_lines")


def _without_lines(entries: DataFrame, text: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, removed = [], []
            for row, cut in zip(batch.column(text).to_pylist(), batch.column("_runs").to_pylist(), strict=True):
                gone = {i for c in cut or () for i in range(c["start"], c["start"] + c["size"])}
                texts.append("\n".join(x for i, x in enumerate(row.split("\n")) if i not in gone) if gone else row)
                removed.append(len(gone))
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_runs", text)}
            yield append(pa.RecordBatch.from_pydict(columns), {text: pa.array(texts, pa.string()), "n_removed_lines": pa.array(removed, pa.int64())})

    order = [n for n in entries.columns if n not in ("_runs", text)]
    types = dict(entries.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in order) + f", `{text}` string, n_removed_lines bigint"
    return entries.mapInArrow(make, schema)
