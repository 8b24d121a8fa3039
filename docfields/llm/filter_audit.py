"""How the filters of a cleaning step overlap: what each of them removes, in every order of application."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize

_BLANK = r"[ \t\n\x0B\f\r]+"
_COUNTS = ("n", "good", "toxic")


def text_filters(text: str = "full_text") -> dict[str, Column]:
    """Failure conditions of form texts: A under 100 words, B under 80 % distinct words, C over 10 % capitals (A-Z) of
    all code points, D a character of ``#$%&*|``. Words are runs of characters other than ASCII white space; a null
    text is empty."""
    full = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(full, _BLANK, -1), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(full, "[^A-Z]+", "")) * 100 > F.length(full) * 10,
        "D": full.rlike("[#$%&*|]"),
    }


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, end): of the k! orders by rank, those in [start, end) remove a record of this mask at this step.

    The rank of an order is its Lehmer code: every place counts the smaller filters still to come, times the factorial
    of the places behind it. All orders that begin with the same filters are one interval of ranks, so a record goes at
    step s exactly in the intervals of the prefixes whose first s - 1 filters it passes and whose last one it fails.
    """
    found = []

    def extend(mask: int, rest: tuple[int, ...], step: int, start: int) -> None:
        size = factorial(k - step)
        for smaller, one in enumerate(rest):
            at = start + smaller * size
            if mask >> one & 1:
                found.append((mask, step, at, at + size))
            else:
                extend(mask, rest[:smaller] + rest[smaller + 1:], step + 1, at)

    for mask in range(1, 1 << k):
        extend(mask, tuple(range(k)), 1, 0)
    return found


def orders(letters: str) -> list[tuple[int, str]]:
    """(rank, order) of all orders of the letters, by Lehmer code."""
    found = []
    for rank in range(factorial(len(letters))):
        rest, order, left = list(letters), "", rank
        for place in range(len(letters) - 1, -1, -1):
            at, left = divmod(left, factorial(place))
            order += rest.pop(at)
        found.append((rank, order))
    return found


def failure_masks(entries: DataFrame, judged: DataFrame, filters: dict[str, Column], key: str, text: str, part: str) -> DataFrame:
    """Counts of entries by part and mask of failed filters: (part, mask, n, good, toxic); the last bit marks copies.

    The texts are read once; what goes on is a key, a digest, a mask and a part. The first entry of each text is a
    minimum per digest, combined before the shuffle, and is met again by digest and key, so a text with very many copies
    is not one group.
    """
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(filters.values())]
    rows = materialize(entries.select(
        F.col(key).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask")))
    first = rows.groupBy("digest").agg(F.min("_id").alias("_id")).where("_id is not null").withColumn("first", F.lit(True))
    known = judged.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        F.max(F.col("good") == F.lit(True)).alias("good"), F.max(F.col("toxic") == F.lit(True)).alias("toxic"))
    both = rows.join(first, ["_id", "digest"], "left").join(known, "_id", "left")
    copy = F.col("_id").isNotNull() & F.col("first").isNull()
    return both.groupBy("part", (F.col("mask") + F.when(copy, F.lit(1 << len(filters))).otherwise(F.lit(0))).alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("good", F.lit(False))).alias("good"),
        F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"))


def order_totals(spark: SparkSession, masks: DataFrame, letters: str) -> DataFrame:
    """The audit of counts (part, mask, n, good, toxic), where bit i of a mask is a failure of filter ``letters[i]``.

    Each mask adds its counts at the starts of its rank intervals and takes them off at their ends; the sum over all
    ranks up to one is what an order removes at a step. The intervals depend on the number of filters only.
    """
    k = len(letters)
    n_orders = factorial(k)
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fails_{i}") for i in range(k)]
    only = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only_{i}") for i in range(k)]
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"), *failing, *only)

    intervals = spark.createDataFrame(removal_intervals(k), "mask int, step int, start int, end int")
    met = masks.join(F.broadcast(intervals), "mask")
    ends = [met.select("part", "step", F.col(at).alias("rank"), *[(F.col(c) * sign).alias(c) for c in _COUNTS])
            for at, sign in (("start", 1), ("end", -1))]
    zeros = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    zeros = zeros.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1))).alias("rank"),
                         *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])
    steps = zeros.unionAll(ends[0]).unionAll(ends[1].where(F.col("rank") < n_orders)).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in _COUNTS])
    up_to = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("part", "step", "rank", *[F.sum(c).over(up_to).alias(c) for c in _COUNTS])

    names = spark.createDataFrame(orders(letters), "rank int, filter_order string")
    steps = steps.join(F.broadcast(names), "rank").join(parts, "part")
    at = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("_at", at)
    earlier = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(earlier)).alias("kept"), F.col("n").alias("removed"),
        (F.element_at(F.array(*[f"fails_{i}" for i in range(k)]), F.col("_at")) - F.col("n")).alias("redundant"),
        F.element_at(F.array(*[f"only_{i}" for i in range(k)]), F.col("_at")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "_at")).alias("shapley"))


def filter_interactions(entries: DataFrame, judged: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E",
                        key: str = "entry_id", text: str = "full_text", part: str = "template_id") -> DataFrame:
    """What each filter of form entries removes in every order of the filters, per form template.

    ``filters`` maps letters to failure conditions over the entries' columns (default ``text_filters``; a null condition
    is no failure); ``copies`` is the letter of one more, which fails an entry if any smaller key has the same text,
    whatever its part and whether that one is removed or not. ``judged`` (key, good boolean, toxic boolean) knows some
    of the entries. One row per part, order (all permutations of the letters) and step (from 1; its filter is the order's
    letter there), with counts (bigint) within the part: ``kept`` after this step, ``removed`` by it, ``redundant``
    (fails the filter but went earlier), ``unique_fails`` (fails this filter only), ``good_lost`` and ``toxic_lost``
    (removed here and judged so), ``shapley`` (removed by the filter, summed over all orders, at whatever step).

    Null and empty texts are the same, empty. A null key has no smaller one, so it is no copy, and is not judged; rows
    that repeat key and text are not copies of each other. An entry judged twice is good (toxic) if it is so once. Null
    parts are the empty string; parts are text. Other columns, whatever their names, do not matter; no entries give no
    rows. At most 7 filters, as orders are written out.
    """
    filters = text_filters(text) if filters is None else filters
    letters = "".join(filters) + copies
    if list(letters) != sorted(set(letters)) or len(letters) != len(filters) + 1 or len(letters) > 7:
        raise ValueError("filters need distinct letters in order, the last one for copies, 7 at most")
    masks = failure_masks(entries, judged, filters, key, text, part)
    return order_totals(entries.sparkSession, materialize(masks), letters)
