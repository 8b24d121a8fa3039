"""Benchmark matches against a scan of all windows."""

import re

import pytest

from docfields.llm import contamination
from docfields.llm.batches import slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width=10):
    out = []
    for key, text in rows:
        doc, hit, found, longest = words(text), set(), set(), 0
        for item, item_text in items:
            w = words(item_text)
            k = min(width, len(w))
            for s in range(len(w) - k + 1) if w else ():
                for p in range(len(doc) - k + 1):
                    if doc[p:p + k] == w[s:s + k]:
                        hit |= set(range(p, p + k))
                        found |= {item} - {None}
                        n = k
                        while p + n < len(doc) and s + n < len(w) and doc[p + n] == w[s + n]:
                            n += 1
                        longest = max(longest, n)
        out.append((key, len(doc), len(hit), sorted(found), longest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark, corpus):
    plain = [t for _, t in corpus if t and len(t) > 200]
    cut = lambda t, a, b: "Q: " + " ".join(t.split()[a:b]).upper() + "?"
    rows = [(1, cut(plain[2], 5, 30)), (2, cut(plain[5], 0, 10)), (10, cut(plain[2], 8, 40)), (11, "unseen words only here"),
            (12, "one"), (13, ""), (14, None), (15, "..."), (None, cut(plain[7], 3, 18)), (2, cut(plain[9], 1, 12)),
            (20, cut(corpus[60][1], 25, 80)), (21, "word " * 15), (22, "word " * 9), (23, "form owner")]
    return rows, spark.createDataFrame([(i, t, "y") for i, t in rows], "item_id bigint, text string, n_words string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_hits_match_brute_force(spark, entries, corpus, items, block_bytes):
    rows, table = items
    got = contamination.benchmark_matches(entries, table, block_bytes=block_bytes).collect()
    found = [(r.entry_id, r.n_words, r.n_hit, list(r.item_ids), r.longest_match.n_words if r.longest_match else 0) for r in got]
    assert sorted(found, key=str) == brute(corpus, rows)
    texts = dict(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.hit_spans) == r.n_hit and r.contaminated == (r.n_hit > 0)
        m, own = r.longest_match, [t for k, t in corpus if k == r.entry_id]
        if m and m.item_id not in (None, 2) and len(own) == 1:
            n = m.n_words
            assert words(own[0])[m.entry_word:m.entry_word + n] == words(texts[m.item_id])[m.item_word:m.item_word + n]


def test_slices_hold_bounded_texts(entries):
    batch = entries.toArrow().combine_chunks().to_batches()[0]
    cut = list(slices(iter([batch]), "full_text", 500))
    assert sum(c.num_rows for c in cut) == batch.num_rows and len(cut) > 20
    assert all(c.num_rows == 1 or sum(len((t or "").encode()) for t in c.column("full_text").to_pylist()) <= 500 for c in cut)


def test_removal_keeps_the_columns(spark, entries, corpus, items):
    kept = contamination.uncontaminated(entries, items[1])
    assert kept.columns == entries.columns
    clean = sum(r[2] == 0 for r in brute(corpus, items[0]))
    assert 0 < kept.count() == clean < len(corpus)


def test_no_items_and_no_entries(spark, entries, items):
    assert contamination.benchmark_matches(entries, items[1].limit(0)).where("n_hit > 0").count() == 0
    assert contamination.benchmark_matches(entries.limit(0), items[1]).count() == 0
