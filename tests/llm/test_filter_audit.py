"""The audit of filters against applying them in every order, entry by entry."""

import random
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from docfields.llm import filter_audit as a
from docfields.llm import queries

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {letter for letter, f in zip("ABCD", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text))), strict=True) if f}


def brute(rows, judged, fails=failed, letters="ABCDE"):
    """Rows of the audit of (id, part, text) rows."""
    first = {}
    for key, _, text in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    parts = {}
    for key, part, text in rows:
        copy = {letters[-1]} if key is not None and first[text or ""] < key else set()
        parts.setdefault("" if part is None else str(part), []).append((fails(text or "") | copy, judged.get(key, (False, False))))
    out = []
    for part, own in parts.items():
        removed_by = dict.fromkeys(letters, 0)
        found = []
        for order in permutations(letters):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [e for e in left if letter in e[0]]
                left = [e for e in left if letter not in e[0]]
                removed_by[letter] += len(gone)
                found.append([part, "".join(order), step, len(left), len(gone), sum(letter in e[0] for e in own) - len(gone),
                              sum(e[0] == {letter} for e in own), sum(e[1][0] for e in gone), sum(e[1][1] for e in gone), letter])
        out += [(*f[:-1], removed_by[f[-1]]) for f in found]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \n\t\x0b", "ONE TWO", "é" * 30 + "A" * 3, "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, "x|y"]
    for _ in range(150):
        n = rng.choice([5, 99, 100, 101, 300])
        words = [rng.choice(["the", "Owner", "CITY", "", "ñ"]) + str(rng.randrange(rng.choice([40, 10_000]))) for _ in range(n)]
        texts.append(rng.choice([" ", "\n", "\x0b", "  "]).join(words) + rng.choice(["", "", "#", "$5", " a&b"]))
    out = [(i, rng.choice([1, 2, None]), t) for i, t in enumerate(texts)]
    out += [(200 + i, rng.choice([1, 3]), rng.choice(texts)) for i in range(80)]
    good = " ".join(f"word{i}" for i in range(120))
    out += [(300, 1, good), (301, 1, good), (302, 2, good)]
    return [*out, (5, 1, texts[5]), (5, 2, texts[9]), (None, 1, texts[20]), (None, 2, None), (-1, 9, texts[30])]


def run(spark, rows, judged, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "entry_id bigint, template_id int, full_text string, mask int, digest string")
    marks = spark.createDataFrame([(k, *v) for k, v in judged.items()], "entry_id bigint, good boolean, toxic boolean")
    got = a.filter_interactions(df.repartition(4), marks.unionAll(marks), **options)
    assert got.columns == list(NAMES) and {t for n, t in got.dtypes[3:]} == {"bigint"} and dict(got.dtypes)["step"] == "int"
    return sorted(tuple(r) for r in got.collect())


def test_equals_every_order(spark, rows):
    rng = random.Random(4)
    judged = {k: (rng.random() < 0.5, rng.random() < 0.3) for k, _, _ in rows if k is not None and rng.random() < 0.6}
    want = brute(rows, judged)
    assert {w[0] for w in want} == {"", "1", "2", "3", "9"} and len(want) == 5 * 600
    assert run(spark, rows, judged | {None: (True, True), 10_000: (True, True)}) == want
    assert sum(w[7] for w in want) > 0 and any(w[6] for w in want if w[1][w[2] - 1] == "E")


def test_other_filters(spark, rows):
    got = run(spark, rows, {}, filters={"P": F.col("full_text").contains("1"), "Q": F.lit(None).cast("boolean")}, copies="R")
    assert got == brute(rows, {}, lambda t: {"P"} if "1" in t else set(), "PQR")
    with pytest.raises(ValueError):
        run(spark, rows, {}, filters={"B": F.lit(True), "A": F.lit(True)})


def test_no_entries(spark):
    assert run(spark, [], {1: (True, False)}) == []


def test_intervals_cover_every_order_once():
    for k in (1, 3, 5):
        names = dict(a.orders("ABCDE"[:k]))
        assert list(names.values()) == ["".join(p) for p in permutations("ABCDE"[:k])]
        steps = {}
        for mask, step, start, end in a.removal_intervals(k):
            for rank in range(start, end):
                assert (mask, rank) not in steps
                steps[mask, rank] = step
        assert steps == {(m, r): next(s for s, c in enumerate(o, 1) if m >> "ABCDE".index(c) & 1)
                         for m in range(1, 1 << k) for r, o in names.items()}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.op12_filter_interaction_audit(spark, sf)
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLES['op12_filter_interaction_audit']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 1000
