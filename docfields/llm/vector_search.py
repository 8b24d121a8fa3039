"""Exact nearest vectors by inner product, by aggregation of sorted lists without random access.

Forms have no vectors of their own, so this works on any table of (key, array of numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize

SCALE = 256
SHARD_ROWS = 16_384
QUERY_BLOCK = 16_384
TOGETHER = 64
_LONG = (1 << 63) - 1


class SortedLists:
    """Vectors of one length as one list per dimension, each in the order of its component."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray):
        """``vectors``: whole numbers, as floats, integers or Python integers."""
        self.keys, self.vectors = keys, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def _kind(self, queries: np.ndarray) -> type:
        """Numbers in which all sums of products are exact."""
        d = self.vectors.shape[1]
        largest = max(1, d) * max(1, *(int(max(abs(x.max(initial=0)), abs(x.min(initial=0)))) for x in (self.vectors, queries)))
        largest *= max(1, min(int(abs(x).max(initial=0)) for x in (self.vectors, queries)))
        for bits, kind in ((24, np.float32), (53, np.float64), (62, np.int64)):
            if largest < 1 << bits:
                return kind
        return object

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, least: list[int | None]) -> list[tuple[np.ndarray, list[int]]]:
        """For each query the keys and scores of its k best vectors but that of its own key, ties to smaller keys; only
        scores of at least ``least`` are needed.

        The lists are read from both ends in rounds of doubling depth, for some queries together: the upper end serves
        the queries with a positive weight in a list, the lower end those with a negative one. After a round each vector
        has for each query a lower bound (its products read so far, and the worst of each list it was not met in) and an
        upper bound (the last product read there). A vector whose upper bound is below the k-th best lower bound is out.
        A query is done when all vectors still in were met in all of its lists, so that their bounds are their
        scores; the others read on. No vector is looked up outside the order of the lists.
        """
        kind = self._kind(queries)
        if kind is object:
            whole = np.frompyfunc(int, 1, 1)  # large integers do not multiply with floats
            scores = whole(self.vectors) @ whole(queries.T) if self.vectors.shape[1] else np.zeros((len(self.keys), len(queries)), object)
            inside = self.keys[:, None] != own[None, :]
            return [self._best(np.flatnonzero(inside[:, i]), scores[:, i], k) for i in range(len(queries))]
        n, d = self.vectors.shape
        never = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        values = self.values.astype(kind)
        up, down = np.maximum(queries, 0).T.astype(kind), np.minimum(queries, 0).T.astype(kind)
        low = np.zeros((n, len(queries)), kind)
        low += up.T @ values[0] + down.T @ values[-1] if n else 0
        unmet_up, unmet_down = np.ones((n, d), kind), np.ones((n, d), kind)
        limit = np.array([never if x is None else x for x in least], kind)
        alive = self.keys[:, None] != own[None, :]
        # Which queries the columns of the arrays stand for; those that are done leave.
        asked = np.arange(len(queries))
        found: list[tuple[np.ndarray, list[int]]] = [(self.keys[:0], [])] * len(queries)
        read, depth = 0, min(n, max(4 * k, n // 16))
        while len(asked):
            worst_up, worst_down = up * values[0][:, None] if n else up, down * values[-1][:, None] if n else down
            for j in range(d if n else 0):
                if up[j].any():
                    at = self.order[n - depth: n - read, j]
                    low[at] += values[n - depth: n - read, j, None] * up[j] - worst_up[j]
                    unmet_up[at, j] = 0
                if down[j].any():
                    at = self.order[read: depth, j]
                    low[at] += values[read: depth, j, None] * down[j] - worst_down[j]
                    unmet_down[at, j] = 0
            read = depth
            high = low
            if read < n:
                high = low + unmet_up @ (up * values[n - depth][:, None] - worst_up)
                high += unmet_down @ (down * values[depth - 1][:, None] - worst_down)
                if n > k + 1:
                    # The k-th best lower bound, the query's own vector left out.
                    bounds = np.where(alive, low, never)
                    limit = np.maximum(limit, np.partition(bounds, n - k, axis=0)[n - k])
            alive &= high >= limit
            done = (~alive | (high == low)).all(axis=0)
            for i in np.flatnonzero(done).tolist():
                found[asked[i]] = self._best(np.flatnonzero(alive[:, i]), low[:, i], k)
            if done.any():
                rest = ~done
                asked, limit = asked[rest], limit[rest]
                up, down, low, alive = (x[:, rest] for x in (up, down, low, alive))
            depth = min(n, 2 * depth)
        return found

    def _best(self, left: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        own = scores[left]
        if len(left) > k:
            least = np.sort(own)[len(left) - k]
            better, equal = np.flatnonzero(own > least), np.flatnonzero(own == least)
            # Ties beyond the k-th go to the smaller keys.
            equal = equal[np.argsort(self.keys[left[equal]], kind="stable")[: k - len(better)]]
            left = left[np.concatenate((better, equal))]
        return self.keys[left], [int(s) for s in scores[left]]


def _finite(vector: Column) -> Column:
    """The components as doubles; null if the vector is null or holds a null or a component that is not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, numbers)


def classes(x: np.ndarray, scale: int) -> np.ndarray:
    """The class of each row: 0 if its scaled numbers are below 2**23 in size, 1 below 2**28, else 2."""
    size = np.abs(x).max(axis=1, initial=0)
    return (size >= (1 << 23) / scale).astype(np.int8) + (size >= (1 << 28) / scale)


def whole_rows(x: np.ndarray, scale: int, kind: int) -> np.ndarray:
    """The rows of one class as whole numbers; floats are exact below 2**28, integers of any size beyond."""
    if kind < 2:
        return np.floor(x * scale)
    # From 2**53 on every float is a whole number, so nothing is lost before the product.
    each = [int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = each
    return out.reshape(x.shape)


Block = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def _by_class(keys: np.ndarray, lists: pa.ListArray, scale: int) -> Block:
    """Keys and whole numbers of vectors, by length and class."""
    out: Block = {}
    sizes = lists.value_lengths().to_numpy()
    flat, starts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = flat[starts[at][:, None] + np.arange(size)]
        kinds = classes(rows, scale)
        for kind in np.unique(kinds).tolist():
            some = kinds == kind
            out[size, kind] = keys[at[some]], whole_rows(rows[some], scale, kind)
    return out


def _sortable(n: int) -> str | None:
    """Text in the order of the numbers, for those beyond 64 bits; null for others."""
    if -_LONG - 1 <= n <= _LONG:
        return None
    digits = str(abs(n))
    if n > 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _search(candidates: DataFrame, queries: Block, k: int, scale: int) -> DataFrame:
    """The best of each task, for one block of queries."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}

        def work(size: int, keys: np.ndarray, vectors: np.ndarray) -> None:
            lists = SortedLists(keys, vectors)
            for (length, _), (ids, block) in queries.items():
                for start in range(0, len(ids) if length == size else 0, TOGETHER):
                    part = ids[start: start + TOGETHER]
                    before = [best.get(i, []) for i in part.tolist()]
                    least = [-b[-1][0] if len(b) >= k else None for b in before]
                    for i, held, (found, scores) in zip(part.tolist(), before, lists.top(block[start: start + TOGETHER], part, k, least), strict=True):
                        best[i] = sorted([*held, *((-s, key) for s, key in zip(scores, found.tolist(), strict=True))])[:k]

        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes = {size for size, _ in queries}
        for batch in batches:
            for (size, kind), rows in _by_class(batch.column(0).to_numpy(), batch.column(1), scale).items():
                if size in sizes:
                    waiting.setdefault((size, kind), []).append(rows)
                    if sum(len(x[0]) for x in waiting[size, kind]) >= SHARD_ROWS:
                        work(size, *(np.concatenate(x) for x in zip(*waiting.pop((size, kind)), strict=True)))
        for (size, _), parts in waiting.items():
            work(size, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        rows = [(i, key, -s) for i, found in best.items() for s, key in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([min(max(r[2], -_LONG - 1), _LONG) for r in rows], pa.int64()), pa.array([_sortable(r[2]) for r in rows], pa.string())],
            names=["query_id", "key", "score", "beyond"])

    return candidates.mapInArrow(make, "query_id bigint, key bigint, score bigint, beyond string")


def nearest_vectors(vectors: DataFrame, is_query: Column, key: str = "key", vector: str = "vector", k: int = 5,
                    scale: int = SCALE, block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best partners of each query: rows (query_id, rank, key, score), rank from 1, ties to smaller keys.

    Queries are the rows for which ``is_query`` holds; partners are all rows with another key. The score is the inner
    product of floor(scale * component), a whole number without rounding for components of any size; ranks follow it,
    and a score beyond 64 bits is shown as the nearest 64-bit number. Queries go to the tasks in blocks of about
    ``block`` rows, one after the other: a block's results are stored before the next one is fetched, so the driver
    holds one. Each task cuts its rows into shards of sorted lists (see ``SortedLists``; numbers beyond 64 bits are
    multiplied in full) and keeps the best k of each query, which also bound its next shards.

    Vectors that are null, or hold a null or a component that is not finite, take no part, nor do rows without key;
    vectors of another length are no partners, and empty vectors score 0. Of repeated rows each is a partner; a repeated
    query is one query, that with the smallest vector if they differ. Fewer than k partners: all of them. No rows give no
    rows; extra columns are ignored.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("_k"), _finite(F.col(vector)).alias("_v"), is_query.alias("_q"))
    rows = rows.where("_k IS NOT NULL AND _v IS NOT NULL")
    asked = rows.where("_q").groupBy("_k").agg(F.min("_v").alias("_v"))
    blocks = max(1, -(-asked.count() // block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "key")
    # Of scores shown alike those above 64 bits come first, those below last; "1" alone stands between them.
    shown = F.coalesce("beyond", F.lit("1"))
    found = None
    for b in range(blocks):
        held = (asked.where(F.pmod(F.xxhash64("_k"), F.lit(blocks)) == b) if blocks > 1 else asked).toArrow()
        queries = _by_class(held.column("_k").to_numpy(), held.column("_v").combine_chunks(), scale) if held.num_rows else {}
        one = _search(rows.select("_k", "_v"), queries, k, scale).withColumn("beyond", shown)
        one = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        one = materialize(one) if blocks > 1 else one
        found = one if found is None else found.unionAll(one)
    return found.select("query_id", "rank", F.col("key").alias(key), "score")
