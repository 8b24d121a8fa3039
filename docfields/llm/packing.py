"""Token sequences of form texts packed into as few training sequences as possible, by vector best fit."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docfields.functions.materialize import materialize
from docfields.llm.batches import LOWER, fields_of, ragged, slices, text_bytes

CAPACITY = 2048
_CACHED_CHUNKS = 800_000
_SLICE_BYTES = 4 << 20
_TOGETHER = 2_000
_GROUP_ROWS = 1 << 18

# Kinds of bytes: white space, letters, digits, apostrophe, other ASCII, parts of longer characters.
_SPACE, _LETTER, _DIGIT, _APOSTROPHE, _OTHER, _HIGH = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[128:] = _HIGH
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _APOSTROPHE
_CUT = np.zeros((6, 6), bool)
_CUT[[_LETTER, _DIGIT], _OTHER] = _CUT[[_LETTER, _DIGIT], _APOSTROPHE] = _CUT[_OTHER, [_LETTER, _DIGIT]] = True
_CUT[_LETTER, _DIGIT] = _CUT[_DIGIT, _LETTER] = _CUT[_DIGIT, _DIGIT] = True
_CUT[_SPACE] = _CUT[:, _SPACE] = True
_CUT_OF_PAIR = _CUT.ravel()

# The steps before BPE of tokenizers whose texts may be cut into chunks as above.
_CHUNKED = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without special tokens added.

    Where the tokenizer drops white space and keeps letters, single digits and other characters apart, a text is cut
    into chunks at places where it starts a new token whatever stands around it, so each distinct chunk is encoded once.
    Both sides of a cut are ASCII, so no character is composed over it. New chunks are encoded some at a time, parted by
    a special token. Texts with a special token in them, and all texts of other tokenizers, are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        parting = [(i, t.content) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        before = steps.get("pre_tokenizer") or {}
        cut = next(iter(before.get("pretokenizers", [])), {})
        self.parting_id, self.parting = parting[-1] if parting else (0, "")
        self.chunked = bool(parting) and ((steps.get("normalizer") or {}).get("normalizers"), (cut.get("pattern") or {}).get("Regex")) == _CHUNKED
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.used = 0

    def _learn(self, chunks: list[str]) -> None:
        joined = [self.parting.join([*chunks[i: i + _TOGETHER], ""]) for i in range(0, len(chunks), _TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.parting_id)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = ids[ids != self.parting_id]
        n, used = len(self.known), self.used
        for name, rows, at in (("flat", flat, used), ("start", np.cumsum(sizes) - sizes + used, n), ("size", sizes, n)):
            held = getattr(self, name)
            if at + len(rows) > len(held):
                held = np.concatenate((held, np.zeros(at + len(rows), np.int32)))
            held[at: at + len(rows)] = rows
            setattr(self, name, held)
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the offsets of each text; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.full(len(texts), not self.chunked)
        for token in self.special if self.chunked else []:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        own = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts) if whole.any() else texts
        ids, offsets = self._by_chunks(own)
        if not whole.any():
            return ids, offsets
        found = np.split(ids, offsets[1:-1])
        for i in np.flatnonzero(whole).tolist():
            found[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(found), np.concatenate(([0], np.cumsum([len(f) for f in found])))

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        # Capitals are small letters unless the next character could be composed with them.
        plain = np.append(data[1:] < 128, True)
        data = np.where(plain, LOWER[data], data)
        kind = _KIND[data]
        first = np.ones(len(data), bool)
        first[1:] = _CUT_OF_PAIR[kind[:-1] * np.uint8(6) + kind[1:]]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        ink = kind != _SPACE
        at = np.flatnonzero(first & ink)
        # Chunks stand one after the other once white space is gone.
        bounds = np.append((np.cumsum(ink) - 1)[at], int(ink.sum())).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[ink])]).dictionary_encode()
        words = chunks.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > _CACHED_CHUNKS:
            self.clear()
            new = words
        if new:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[chunks.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size[place].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[ragged(self.start[place].astype(np.int64), sizes)], ends[np.searchsorted(at, offsets)]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(entries: DataFrame, tokenizer: str, end_id: int = 0, longest: int = CAPACITY, key: str = "entry_id",
                 text: str = "full_text") -> DataFrame:
    """The tokens of each form entry as pieces: (key, piece int, start bigint, length bigint, token_ids binary).

    An entry's tokens are the ids of its whole text by the tokenizers file ``tokenizer`` and then ``end_id``. Only more
    than ``longest`` tokens are cut, into pieces of that length; the last may be shorter. ``piece`` counts from 0,
    ``start`` is the number of the entry's tokens before it; ``token_ids`` are little-endian unsigned 32-bit numbers.

    Null and empty texts are one piece, the end alone. Every row has its pieces, repeated ones and null keys, too; no rows
    give none. Other columns, whatever their names, are left out.
    """
    rows = entries.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = fields_of("_id bigint, piece int, start bigint, length bigint, token_ids binary")
    schema["_id"].dataType = rows.schema["_id"].dataType

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", _SLICE_BYTES):
            ids, offsets = _encoder(tokenizer).encode(batch.column("_text"))
            sizes = np.diff(offsets) + 1
            ends = np.cumsum(sizes)
            tokens = np.full(int(ends[-1]), end_id, "<u4")
            tokens[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = ids
            count = -(-sizes // longest)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = ragged(np.zeros(len(sizes), np.int64), count)
            start = piece * longest
            length = np.minimum(sizes[row] - start, longest)
            # Pieces follow one another without a gap, so they are ranges of one buffer.
            bounds = np.append((ends - sizes)[row] + start, ends[-1]) * 4
            held = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(tokens)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 held.cast(pa.binary())], names=["_id", "piece", "start", "length", "token_ids"])

    return rows.mapInArrow(make, schema).withColumnRenamed("_id", key)


class BestFit:
    """Bins for pieces in falling order of length; all bins with the same room left are held as one.

    A bin has room for tokens, entries and attention cost (the sum of squared lengths). A piece goes to a bin with room for
    it in all three: by rule ``norm`` to the one whose weighted room left afterwards is smallest, by rule ``dot`` to the
    one whose room has the largest weighted product with what the piece needs. Both are taken as shares of an empty bin.
    Equal pieces choose alike until the bins of one room are used up, so what this holds depends on the number of
    different lengths, not of pieces.
    """

    def __init__(self, room: tuple[int, int, int], rule: str, weights: tuple[float, float, float]):
        if rule not in ("norm", "dot"):
            raise ValueError(f"unknown rule {rule}")
        self.full, self.rule = np.array(room, np.int64), rule
        self.weights = np.array(weights) / self.full.astype(float) ** 2
        self.left = np.zeros((64, 3), np.int64)
        self.some = np.zeros(64, bool)
        self.at: dict[tuple[int, ...], int] = {}
        self.bins: list[deque[tuple[int, int]]] = []
        self.n_bins = 0
        # Of each run of equal pieces: length, first rank, first bin, offset in it, pieces a bin.
        self.runs: list[tuple[int, int, int, int, int]] = []

    def _put(self, left: np.ndarray, first: int, n: int) -> None:
        key = tuple(left.tolist())
        if key not in self.at:
            if len(self.bins) == len(self.left):
                used = np.flatnonzero(self.some).tolist()
                self.bins = [self.bins[i] for i in used]
                self.left = np.concatenate((self.left[used], np.zeros((len(used) + 64, 3), np.int64)))
                self.some = np.arange(len(self.left)) < len(used)
                self.at = {tuple(self.left[i].tolist()): i for i in range(len(used))}
            self.at[key] = len(self.bins)
            self.left[len(self.bins)] = left
            self.bins.append(deque())
        self.bins[self.at[key]].append((first, n))
        self.some[self.at[key]] = True

    def add(self, length: int, n: int) -> None:
        """Place the ``n`` pieces of this length."""
        need, rank = np.array([length, 1, length * length], np.int64), 0
        if (need > self.full).any():
            raise ValueError(f"a piece of {length} tokens does not fit into an empty sequence")
        while rank < n:
            some = np.flatnonzero((self.left >= need).all(axis=1) & self.some)
            if len(some):
                if self.rule == "norm":
                    score = ((self.left[some] - need) ** 2.0 @ self.weights)
                else:
                    score = -(self.left[some] @ (need * self.weights))
                best = int(some[np.argmin(score)])
                left = self.left[best].copy()
                first, held = self.bins[best].popleft()
            else:
                best, left, first, held = -1, self.full, self.n_bins, n
            # The bin just used is the best again by norm, and for a new bin nothing else has room.
            each = int((left // need).min()) if self.rule == "norm" or best < 0 else 1
            used = min(held, (n - rank) // each)
            last = (n - rank) % each if used < held else 0
            taken = used + (last > 0)
            if best < 0:
                self.n_bins += taken
            else:
                if taken < held:
                    self.bins[best].appendleft((first + taken, held - taken))
                self.some[best] = bool(self.bins[best])
            for at, bins, pieces in ((first, used, each), (first + used, 1, last)):
                if bins and pieces:
                    self.runs.append((length, rank, at, int(self.full[0] - left[0]), pieces))
                    self._put(left - need * pieces, at, bins)
                    rank += bins * pieces


def packed(pieces: DataFrame, capacity: int = CAPACITY, entries_per_sequence: int | None = None, attention_cost: int | None = None,
           rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.001, 0.001), length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (bigint) appended: which sequence each goes to, and where in it.

    No sequence has more than ``capacity`` tokens, ``entries_per_sequence`` pieces or ``attention_cost`` (sum of squared
    lengths); the last two do not bind unless given. Pieces go in falling order of length to the best bin (see
    ``BestFit``). Only the number of pieces of each length is gathered, at most ``capacity`` numbers; bins are chosen for
    all equal pieces at once, and each piece finds its bin by its rank among those of its length. Ranks are counted in
    salted groups, so one length may hold most of the pieces. Offsets are without gaps from 0; sequence numbers too.

    A null length, or one below 1, takes no room: both columns are null. A piece that is too long for an empty sequence
    raises. Equal rows are pieces of their own. Columns of the two names are replaced, all others stay; no rows give none.
    """
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    rows = pieces.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], F.col(f"`{length}`").cast("bigint").alias("_n"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    placed = rows.where("_n >= 1")
    counts = {r["_n"]: r["count"] for r in placed.groupBy("_n").count().orderBy(F.desc("_n")).limit(capacity + 1).collect()}
    fit = BestFit((capacity, entries_per_sequence or capacity, attention_cost or capacity * capacity), rule, weights)
    for n in sorted(counts, reverse=True):
        fit.add(n, counts[n])
    plan = np.array(fit.runs, np.int64).reshape(-1, 5)
    bits = np.int64(44)
    starts = np.left_shift(capacity - plan[:, 0], bits) + plan[:, 1]

    salts = 1 + max(counts.values(), default=0) // _GROUP_ROWS
    salted = placed.withColumn("_salt", F.pmod(F.shiftright("_row", 33), F.lit(salts)))
    before = Window.partitionBy("_n").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("_n", "_salt").count().select("_n", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_n", "_salt").orderBy("_row")) - 1)
    ranked = ranked.join(sizes, ["_n", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*[f"_c{i}" for i in range(len(names))], "_n", "_rank")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("_n", "_rank"))
            run = plan[np.searchsorted(starts, np.left_shift(capacity - n, bits) + rank, side="right") - 1]
            bin_, place = np.divmod(rank - run[:, 1], run[:, 4])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(run[:, 2] + bin_), pa.array(run[:, 3] + place * n)], names=schema.names)

    schema = StructType([*ranked.schema.fields[:-2], *fields_of("sequence_id bigint, offset bigint").fields])
    found = ranked.mapInArrow(make, schema)
    nowhere = [F.lit(None).cast("bigint").alias(n) for n in ("sequence_id", "offset")]
    rest = rows.where("_n is null or _n < 1").select(*[f"_c{i}" for i in range(len(names))], *nowhere)
    return found.unionByName(rest).select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], "sequence_id", "offset")
