"""Fixtures of the text operators: small corpora with nulls, empty, long and repeated texts."""

from __future__ import annotations

import random

import pytest

WORDS = ["the", "form", "Owner", "name", "city", "barangay", "permit", "date", "of", "and", "ñandú", "éaux", "x1", "(a)",
         "THE", "no.", "—", "street", "trading", "store", "signed", "by", "for", "with", "status", "tax", "payer"]


@pytest.fixture(scope="session")
def corpus():
    """(id, text) rows: prose, exact and near copies, shared passages, short, empty, null and white-space texts."""
    rng = random.Random(7)

    def prose(n: int) -> str:
        words = [rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randrange(50))]) for _ in range(n)]
        return " ".join(w + ("\n" if rng.random() < 0.12 else "") for w in words)

    rows = [(i, prose(rng.choice([3, 20, 60, 150, 400]))) for i in range(60)]
    passage = prose(90)
    for i in range(60, 75):
        rows.append((i, prose(30) + " " + passage + " " + prose(rng.randrange(60))))
    for i in range(75, 85):
        words = rows[3 if len(rows[3][1]) > 400 else 61][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(i, rows[62][1]) for i in range(85, 92)]
    rows += [(92, ""), (93, None), (94, " \n\t "), (95, "one"), (96, "one"), (97, "word " * 3000), (98, "\n\n\n")]
    rows += [(None, "a row without key"), (None, rows[62][1]), (3, rows[3][1]), (3, "another text of key three")]
    return rows


@pytest.fixture(scope="session")
def entries(spark, corpus):
    """The corpus as form entries, with extra columns whose names clash with those the operators use inside."""
    data = [(k, t, i, "x", i % 3, float(i)) for i, (k, t) in enumerate(corpus)]
    return spark.createDataFrame(
        data, "entry_id bigint, full_text string, fingerprint int, low string, root int, text_hash double").repartition(3)
