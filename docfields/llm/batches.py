"""Arrow batches as numpy arrays: texts as one byte array, words and hashes by array arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

SLICE_BYTES = 1 << 20
_SHORT = 64
# Range hashes are polynomials modulo this prime; modulo a power of two, some different texts would always collide.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE, *_OF_BYTES = np.random.default_rng(20240607).integers(1 << 32, PRIME, 257, dtype=np.uint64).tolist()
_VALUES = np.array(_OF_BYTES, np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; a null text is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    x -= _P * (x >= _P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from products of halves."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _low(31), b >> np.uint64(31), b & _low(31)
    middle = a_low * b_high + a_high * b_low
    return _reduced(((a_high * b_high) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _low(30)) << np.uint64(31)) + a_low * b_low)


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base, np.ones(1, np.uint64))
    if len(held) < n:
        size = max(n, SLICE_BYTES + 2)
        while len(held) < size:
            held = np.concatenate((held, times(held, np.uint64(pow(base, len(held), PRIME)))))
        _powers[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """64-bit hashes of any ranges of one sequence, from prefix sums of a polynomial modulo a prime."""

    def __init__(self, values: np.ndarray):
        """``values``: bytes, or uint64 hashes of larger units."""
        values = _VALUES[values] if values.dtype == np.uint8 else _reduced(values)
        terms = times(values, _power(_BASE, len(values)))
        # Sums of halves do not overflow; the upper one counts 2**32 times, which turns bits 29 and up to the lower end.
        high = np.cumsum(terms >> np.uint64(32), dtype=np.uint64)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        self.sums[1:] = _reduced((high >> np.uint64(29)) + ((high & _low(29)) << np.uint64(32)) + _reduced(np.cumsum(terms & _low(32), dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end): equal ranges have equal hashes wherever they stand."""
        if len(start) == 0:
            return np.zeros(0, np.uint64)
        return _spread(self.sums[end] + _P - self.sums[start], _power(pow(_BASE, -1, PRIME), len(self.sums))[start], (end - start).astype(np.uint64))


def _spread(sums: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(times(_reduced(sums), shift) + length * np.uint64(0x9E3779B97F4A7C15))


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words or lines [start, end) of a byte array that do not overlap: equal bytes, equal hashes.

    Eight bytes at a time for all of them together; of what is longer than ``_SHORT`` bytes each is hashed by itself.
    """
    size = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,), writeable=False)
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D))
    left = np.flatnonzero((size > 0) & (size <= _SHORT))
    at, rest, held = start[left], size[left], h[left]
    while len(left):
        # The last bytes of a word: what follows them is masked out.
        spare = np.maximum(8 - rest, 0).astype(np.uint64) * np.uint64(8)
        held = mix((held ^ (eights[at] << spare >> spare)) * np.uint64(0xD6E8FEB86659FD93))
        h[left] = held
        more = rest > 8
        left, at, rest, held = left[more], at[more] + 8, rest[more] - 8, held[more]
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        text = memoryview(data)
        h[long] = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` positions; runs end at text boundaries."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(n + 1, bool)
    first[1:n] = False
    first[offsets] = True
    before = np.concatenate(([False], member[:-1])) & ~first[:n]
    after = np.concatenate((member[1:], [False])) & ~first[1:]
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in linear time: prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1: n])


def fields_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def add_columns(df: DataFrame, ddl: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` with the columns of ``ddl`` appended by ``make``; a column of the same name is replaced."""
    new = fields_of(ddl)
    kept = df.drop(*new.names)
    return kept.mapInArrow(make, StructType([*kept.schema.fields, *new.fields]))


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)


def fixed_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` units of a sequence, by start."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums = RangeHash(data).sums
    shift = _power(pow(_BASE, -1, PRIME), len(sums) - width)
    return _spread(sums[width:] + _P - sums[:-width], shift, np.array([width], np.uint64))
