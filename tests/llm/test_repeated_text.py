"""Repeated byte strings against a table of all windows."""

import random

import pytest

from docfields.llm import repeated_text


def brute(rows, length):
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p:p + length], []).append((i, p))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i] |= set(range(p, p + length))
    out = []
    for (key, _), t, g in zip(rows, texts, gone):
        spans = sum(p in g and p - 1 not in g for p in range(len(t)))
        out.append((key, len(t), len(g), spans, bytes(c for p, c in enumerate(t) if p not in g)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abñ ") for _ in range(n))
    shared = noise(300)
    rows = [(i, noise(rng.randrange(260))) for i in range(25)]
    for i in range(25, 60):
        a, n = rng.randrange(260), rng.randrange(15, 200)
        piece = list(shared[a:a + n])
        for _ in range(rng.choice([0, 0, 1, 3])):
            piece[rng.randrange(len(piece))] = rng.choice("xyz")
        rows.append((i, noise(rng.randrange(60)) + "".join(piece) + noise(rng.randrange(60))))
    rows += [(60 + i, rows[30][1]) for i in range(4)]
    rows += [(70, "ab " * 100), (71, "a" * 150), (72, None), (73, ""), (None, shared), (None, None), (74, rows[26][1] * 2),
             (5, rows[5][1]), (5, rows[5][1]), (5, "other" + shared[20:90])]
    return rows


@pytest.mark.parametrize("length,largest", [(40, 20_000), (40, 3), (24, 2), (61, 5)])
def test_spans_match_brute_force(spark, texts, length, largest):
    df = spark.createDataFrame([(k, 1, t, b"x") for k, t in texts], "entry_id bigint, gram int, full_text string, _id binary").repartition(3)
    got = repeated_text.repeated_spans(df, length=length, largest_group=largest).collect()
    assert sorted(((r.entry_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute(texts, length)


def test_production_length(spark, entries, corpus):
    got = repeated_text.repeated_spans(entries).collect()
    want = brute(corpus, 400)
    assert sorted(((r.entry_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == want
    assert sum(w[2] > 0 for w in want) > 10
    assert repeated_text.repeated_spans(entries.limit(0)).count() == 0


def test_scan_of_one_group_matches_all_pairs():
    rng = random.Random(8)
    for _ in range(300):
        length, m = 12, rng.randrange(2, 9)
        rows = sorted({("gram" + "".join(rng.choice("ab") for _ in range(rng.randrange(2, 9))), "".join(rng.choice("ab") for _ in range(rng.randrange(7)))) for _ in range(m)})
        after, before = [r[0].encode() for r in rows], [r[1].encode() for r in rows]
        first, last = [length - len(a) for a in after], [len(b) for b in before]
        got = repeated_text.scan_group(after, before, first, last, length)
        for i in range(len(rows)):
            ok = [a for a in range(first[i], last[i] + 1) if any(
                j != i and last[j] >= a >= first[j] and before[i][len(before[i]) - a:] == before[j][len(before[j]) - a:]
                and after[i][:length - a] == after[j][:length - a] for j in range(len(rows)))]
            assert got[i] == ((min(ok), max(ok)) if ok else None)
