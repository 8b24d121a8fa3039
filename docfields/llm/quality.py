"""Quality of form texts: random-indexing word vectors, pooled for each text, and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import add_columns, append, hashes_of, mix, slices, text_bytes

BUCKETS = 1 << 14
DIMENSIONS = 32
NEIGHBOURS = 2
PARTS = 64
SALTS = 64
MAX_LABELLED = 20_000
# 0: white space and control, 1: word characters (all beyond ASCII too), 2: marks. A word is a run of one class.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:0x21] = _CLASS[0x7F] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_IDS = np.arange(BUCKETS, dtype=np.uint64)
# The index vector of a bucket: two entries of +1 or -1.
_INDEX = [((mix(_IDS * np.uint64(2) + np.uint64(k)) % np.uint64(DIMENSIONS)).astype(np.int64),
           1.0 - 2.0 * (mix(_IDS * np.uint64(2) + np.uint64(k)) >> np.uint64(63)).astype(np.float64)) for k in (0, 1)]


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of all texts, and the offsets of each text's words."""
    kind = _CLASS[data]
    n = len(data)
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = kind[1:] != kind[:-1]
        new[offsets] = True
    at = np.flatnonzero(new)
    starts, ends = at[:-1], at[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    return (hashes_of(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors for each bucket, over one task's texts."""
    total = np.zeros(BUCKETS * DIMENSIONS)
    for batch in slices(batches, "_text"):
        words, offsets = word_buckets(*text_bytes(batch.column("_text")))
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(words))
        for step in range(1, NEIGHBOURS + 1):
            at = np.flatnonzero(left > step)
            a, b = words[at], words[at + step]
            for own, other in ((a, b), (b, a)):
                for place, sign in _INDEX:
                    total += np.bincount(own * DIMENSIONS + place[other], sign[other], BUCKETS * DIMENSIONS)
    blocks = total.astype(np.int64).reshape(PARTS, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(PARTS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["part", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal (part, salt), over rows in that order; one is held at a time."""
    key, held = None, np.zeros(0, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held.tobytes()], pa.binary())],
                                          names=["part", "salt", "sums"])

    for batch in batches:
        for *now, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if key is not None:
                    yield row()
                key, held = now, np.zeros(len(sums) // 8, np.int64)
            held += np.frombuffer(sums, np.int64)
    if key is not None:
        yield row()


def word_vectors(entries: DataFrame, text: str = "full_text") -> np.ndarray:
    """Random-indexing vectors of all words of all texts, of length 1, as a table of fixed size (4 MB).

    The vector of a word is the sum of the index vectors of its neighbours (two to each side) over the whole corpus.
    Words share ``BUCKETS`` rows by hash, so the table does not grow with the corpus. Sums are of whole numbers and
    do not depend on the order of the rows.
    """
    schema = "part int, salt int, sums binary"
    sums = entries.select(F.col(text).alias("_text")).mapInArrow(_contexts, "part int, sums binary")
    sums = sums.select("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "sums")
    # Two levels: the sums of all tasks would be one pile for each part, which grows with the number of tasks.
    salted = sums.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_add, schema)
    whole = salted.select("part", F.lit(0).alias("salt"), "sums").repartition("part").sortWithinPartitions("part").mapInArrow(_add, schema)
    parts = whole.select("part", "sums").collect()
    table = np.zeros((PARTS, BUCKETS // PARTS * DIMENSIONS), np.int64)
    for part, held in parts:
        table[part] = np.frombuffer(held, np.int64)
    table = table.reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    return (table / np.maximum(np.sqrt((table**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled_rows(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each text, how unevenly its words are spread over buckets, the share
    of words that repeat the one before, and the logarithm of the number of words; zeros for a text without words."""
    words, offsets = word_buckets(*text_bytes(texts))
    sizes = np.diff(offsets)
    rows = np.zeros((len(sizes), 2 * DIMENSIONS + 3), np.float32)
    again = np.concatenate(([0], np.cumsum(np.concatenate((words[1:] == words[:-1], [False]))))) if len(words) else words
    rows[:, -1] = np.log1p(sizes)
    for i in np.flatnonzero(sizes).tolist():
        ids, counts = np.unique(words[offsets[i]: offsets[i + 1]], return_counts=True)
        share = counts / sizes[i]
        held = vectors[ids].astype(np.float64)
        mean = share @ held
        rows[i, :DIMENSIONS] = mean
        rows[i, DIMENSIONS:-3] = np.sqrt(np.maximum(share @ held**2 - mean**2, 0))
        rows[i, -3] = (share**2).sum()
        rows[i, -2] = (again[offsets[i + 1] - 1] - again[offsets[i]]) / sizes[i]
    return rows


def with_pooled_vector(entries: DataFrame, vectors: np.ndarray, text: str = "full_text") -> DataFrame:
    """Append ``pooled`` (array<float>), the pooled vector of each text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = pooled_rows(batch.column(text), vectors)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1])
            yield append(batch, {"pooled": flat.cast(pa.list_(pa.float32()))})

    return add_columns(entries, "pooled array<float>", make)


@dataclass
class Network:
    """Two layers; ``temperature`` divides the output so that probabilities match observed shares."""

    centre: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, units: int = 32, rounds: int = 60, seed: int = 11) -> Network:
    """Fit with Adam on four fifths of the rows, then the temperature on the rest by its likelihood."""
    rng = np.random.default_rng(seed)
    scale = np.maximum(x.std(axis=0), 1e-4)
    net = Network(x.mean(axis=0), scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)), np.zeros(units),
                  rng.normal(0, 1 / np.sqrt(units), units), 0.0)
    rest = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    fx, fy = (x[~rest] - net.centre) / scale, y[~rest]
    weights = [net.hidden, net.hidden_bias, net.out, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(fy))
        for at in range(0, len(fy), 128):
            bx, by = fx[order[at: at + 128]], fy[order[at: at + 128]]
            h = np.tanh(bx @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -40, 40))) - by) / len(by)
            back = np.outer(error, weights[2]) * (1 - h**2)
            slopes = [bx.T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ error + 1e-4 * weights[2], error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                weights[i] -= 0.003 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.hidden, net.hidden_bias, net.out, net.out_bias = weights[0], weights[1], weights[2], float(weights[3][0])
    if rest.any():
        z, t = net.logits(x[rest]), y[rest]
        loss = {c: np.logaddexp(0, np.where(t > 0, -z, z) / c).mean() for c in np.geomspace(0.25, 8, 61)}
        net.temperature = float(min(loss, key=loss.get))
    return net


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the key as text, modulo 4, is 2. A null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


def fit(pooled: DataFrame, labels: DataFrame, key: str, label_key: str, label: str, limit: int = MAX_LABELLED) -> Network | None:
    """The network fitted to at most ``limit`` labelled rows outside the held-out quarter, chosen by a hash."""
    learnt = labels.where(f"`{label}` IN (0, 1)").select(F.col(label_key).alias("_k"), F.col(label).cast("int").alias("y"))
    known = pooled.where(~held_out(F.col(key))).select(F.col(key).alias("_k"), "pooled").join(learnt, "_k")
    chosen = known.orderBy(F.xxhash64("_k", F.lit(5)), "_k", "y", "pooled").limit(limit).select("pooled", "y").toArrow()
    if chosen.num_rows == 0:
        return None
    x = np.array(chosen.column("pooled").combine_chunks().flatten(), np.float64).reshape(chosen.num_rows, -1)
    return train(x, np.array(chosen.column("y"), np.float64))


def quality_scores(entries: DataFrame, labels: DataFrame, key: str = "entry_id", text: str = "full_text",
                   label_key: str = "entry_id", label: str = "quality", threshold: float = 0.7,
                   max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row (key, held_out, score, predicted) per form entry: how likely its text is of good quality.

    Word vectors are sums over all words of all entries. Each whole text is pooled to the mean and the deviation of
    its word vectors; a network with one hidden layer gives the score, calibrated by a temperature. It is fitted to
    at most ``max_labelled`` labelled rows (by a hash of the key), never to held-out ones, and sees only the text.
    ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts pool to zeros and get the score of that. A null key has no label; labels that are null or
    neither 0 nor 1 are ignored, several labels of one entry all count. Without any usable label every score is 0.5.
    Repeated rows stay; extra columns are ignored. No rows give no rows.
    """
    rows = entries.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    pooled = materialize(with_pooled_vector(rows, word_vectors(rows, "_text"), "_text").drop("_text"))
    scored = _scored(pooled, fit(pooled, labels, "_key", label_key, label, max_labelled))
    return scored.select(F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(pooled: DataFrame, net: Network | None) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("pooled").flatten(), np.float64).reshape(batch.num_rows, -1)
            score = net.probability(x) if net else np.full(batch.num_rows, 0.5)
            yield append(batch.select([n for n in batch.schema.names if n != "pooled"]), {"score": pa.array(score)})

    kept = pooled.drop("pooled")
    return pooled.select(*kept.columns, "pooled").mapInArrow(make, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", score double")


def good_entries(entries: DataFrame, labels: DataFrame, key: str = "entry_id", text: str = "full_text",
                 label_key: str = "entry_id", label: str = "quality", threshold: float = 0.7,
                 max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The entries whose score reaches ``threshold``, with their columns; scores as in ``quality_scores``."""
    vectors = word_vectors(entries, text)
    names = entries.columns
    inner = entries.select(*[F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(names)])
    k, t = f"_{names.index(key)}", f"_{names.index(text)}"
    net = fit(with_pooled_vector(inner.select(k, t), vectors, t), labels, k, label_key, label, max_labelled)
    return _kept(inner, vectors, net, t, threshold).select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def _kept(entries: DataFrame, vectors: np.ndarray, net: Network | None, text: str, threshold: float) -> DataFrame:
    """Pooling, score and filter in one pass over the texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = pooled_rows(batch.column(text), vectors).astype(np.float64)
            score = net.probability(x) if net else np.full(batch.num_rows, 0.5)
            yield batch.filter(pa.array(score >= threshold))

    return entries.mapInArrow(make, entries.schema)
