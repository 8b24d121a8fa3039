"""Line deduplication against a comparison of all windows of lines."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docfields.llm import repeated_lines
from docfields.llm.batches import text_bytes


def brute(rows, width, long_words=repeated_lines.LONG_WORDS):
    """(key, kept text, removed lines) by a scan in the order of keys: runs of ``width`` lines, whole shorter texts, and
    runs of fewer lines with ``long_words`` words."""
    seen, out = {}, []
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = text.split("\n") if text else []
        k = min(width, len(lines))
        gone = set()
        sizes = [n for n in range(1, k) if lines] + [k] * bool(lines)
        for n, s in ((n, s) for n in sizes for s in range(len(lines) - n + 1)):
            run = tuple(lines[s:s + n])
            if n < k and sum(len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in run) < long_words:
                continue
            if run in seen:
                gone |= set(range(s, s + n))
            seen.setdefault(run, (key, s))
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
        out += [(key, kept, len(gone))] * rows.count((key, text))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["a", "b", "form", "ñ", ""]) for _ in range(rng.randrange(4)))
    shared = [line() + str(i) for i in range(12)]
    rows = []
    for i in range(80):
        own = [line() + (str(rng.random()) if rng.random() < 0.7 else "") for _ in range(rng.randrange(14))]
        a = rng.randrange(12)
        own[rng.randrange(len(own) + 1):0] = shared[a:a + rng.randrange(7)]
        rows.append((i, "\n".join(own)))
    rows += [(80, rows[5][1]), (81, None), (82, ""), (83, "\n"), (84, "\n"), (85, "one"), (86, "one"), (87, "x\n" * 400),
             (5, rows[5][1]), (88, "two\nlines"), (89, "two\nlines"), (90, "lines\nlines\nlines\nlines\nlines")]
    return rows


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_lines_match_brute_force(spark, pages, width):
    df = spark.createDataFrame([(k, "c", t, 1.0) for k, t in pages], "entry_id bigint, start string, full_text string, _id double")
    got = repeated_lines.deduplicated_lines(df.repartition(4), width=width)
    assert got.columns == [*df.columns, "n_removed_lines"]
    assert sorted(((r.entry_id, r.full_text, r.n_removed_lines) for r in got.collect()), key=str) == brute(pages, width)


def test_null_keys_and_empty_table(spark, entries, corpus):
    got = repeated_lines.deduplicated_lines(entries)
    known = [c for c in corpus if c[0] != 3 and c[0] is not None]
    assert got.count() == len(corpus)
    found = [(r.entry_id, r.full_text, r.n_removed_lines) for r in got.collect()]
    assert sorted((f for f in found if f[0] is not None and f[0] > 3), key=str) == sorted(
        (f for f in brute([c for c in corpus if c[0] is not None], 3) if f[0] > 3), key=str) and len(known) > 90
    # An entry without key comes after all others, so its copy of entry 62 loses what is there.
    assert {f[1] for f in found if f[0] is None} == {"a row without key", ""}
    assert repeated_lines.deduplicated_lines(entries.limit(0)).count() == 0


def test_every_window_has_one_fingerprint_inside():
    data, offsets = text_bytes(pa.array(["a\nb\nc\nd", "", None, "x", "\n\n"]))
    starts, ends, lines = repeated_lines.line_ranges(data, offsets)
    assert np.diff(lines).tolist() == [4, 0, 0, 1, 3]
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"a", b"b", b"c", b"d", b"x", b"", b"", b""]
    at, size, mark = repeated_lines.winnow(np.array([9, 3, 7, 3, 5, 1, 1, 1], np.uint64), lines, 3)
    assert at.tolist() == [0, 1, 4, 5] and size.tolist() == [3, 3, 1, 3]
    assert ((mark >= at) & (mark < at + size)).all()


def test_long_lines_are_runs_of_their_own(spark):
    long, other = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    half = [" ".join(f"h{j}{i}" for i in range(12)) for j in range(2)]
    short = " ".join(f"s{i}" for i in range(19))
    rows = [(1, f"x\n{long}\ny\n{short}\nz"), (2, f"p\nq\n{long}\nr"), (3, long), (4, f"k\n{short}\nl\nm"), (5, short),
            (6, "\n".join(half)), (7, "\n".join(["c", "d", *half, "e"])), (8, half[0]), (9, f"n\n{other}"), (10, other), (11, f"{other}\nt")]
    df = spark.createDataFrame(rows, "entry_id bigint, full_text string").repartition(3)
    got = {r.entry_id: (r.full_text, r.n_removed_lines) for r in repeated_lines.deduplicated_lines(df).collect()}
    kept = {1: 0, 4: 0, 5: 0, 6: 0, 8: 0, 9: 0}
    assert {k: got[k] for k in kept} == {k: (dict(rows)[k], 0) for k in kept}
    assert got[2] == ("p\nq\nr", 1) and got[3] == ("", 1) and got[7] == ("c\nd\ne", 2)
    assert got[10] == ("", 1) and got[11] == ("t", 1)
