"""Collocations against a count of all phrases."""

import random
import re
from collections import Counter

import pytest

from docfields.llm import collocations as c


def brute(rows, least, best, contained=80, no_group="none"):
    """(group, rank, phrase, a, l, r, n, score) of (group, text) rows."""
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts, words = {}, Counter()
    for group, text in rows:
        group = no_group if group is None else str(group)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[group] += len(own)
            for i in range(len(own)):
                for k in range(1, min(4, len(own) - i) + 1):
                    counts.setdefault(group, Counter())[tuple(own[i:i + k])] += 1
    out = []
    for group, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= contained * f[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((group, rank, phrase.decode(), -a, left, right, words[group], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = ["Owner", "name", "of", "the", "permit", "CITY", "hall", "ñandú", "é", "x\x01", "x", "\x00", "a\x1fb", "|", "日本"]
    passage = "business name and trade style of the owner"
    out = []
    for i in range(400):
        words = [rng.choice(base[: rng.choice([4, 15])]) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            words[rng.randrange(len(words) + 1):0] = passage.split()
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?"]) for w in words)
        out.append((rng.choice([1, 1, 1, 2, 3, None]), text))
    return [*out, (1, None), (1, ""), (None, " . \n"), (4, "the"), (1, "Word " * 20000), (9, "one of a kind"), *[(5, passage)] * 50]


def run(spark, rows, **options):
    data = [(i % 7, g, t, "x", 1) for i, (g, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "entry_id bigint, template_id bigint, full_text string, phrase string, n int").repartition(5)
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


@pytest.mark.parametrize("budget", [c.BUDGET, 500, 20, 1])
def test_equals_brute_force_for_any_memory_budget(spark, rows, budget):
    want = brute(rows, 10, 2000)
    assert len(want) > 100 and {w[0] for w in want} >= {"1", "2", "3", "5", "none"}
    assert run(spark, rows, least=10, budget=budget) == want


def test_best_limit_and_share_of_longer_phrases(spark, rows):
    assert run(spark, rows, least=5, best=7, contained=50) == brute(rows, 5, 7, 50)
    assert run(spark, rows, least=1, best=50, budget=300) == brute(rows, 1, 50)


def test_every_word_starts_a_suffix(rows):
    texts = [c.pa.array([t for _, t in rows]), c.pa.array([str(g) for g, _ in rows])]
    s = c.Suffixes(*texts)
    at = s.extended([])[0]
    words = [w for _, t in rows for w in re.findall(r"[^\x20\x09-\x0D.,;:!?]+", t or "")]
    assert s.phrase(at, 1).to_pylist() == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]


def test_empty_table_and_unfit_texts(spark, rows):
    assert run(spark, [], least=2) == []
    assert run(spark, [(1, None), (1, ""), (2, "..")], least=1) == []
    assert run(spark, [(1, "a b")] * 3, least=4) == []
    got = run(spark, [(None, "A a a a")], least=2, no_group="und")
    assert got == brute([(None, "A a a a")], 2, 2000, no_group="und") and got[0][0] == "und"


def test_columns(spark, rows):
    df = spark.createDataFrame([(1, "a b")] * 4, "lang int, words string")
    got = c.collocations(df, least=3, text="words", group="lang")
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert dict(got.dtypes)["lang"] == "string" and {dict(got.dtypes)[x] for x in ("rank", "a", "l", "r", "n", "score")} == {"bigint"}
    assert [tuple(r) for r in got.collect()] == [("1", 1, "a b", 4, 4, 4, 8, 1000000)]
