"""Range hashes: exact arithmetic modulo the prime, and texts that collide modulo powers of two."""

import random

import numpy as np

from docfields.llm import batches as b
from docfields.llm import contamination, repeated_lines


def thue_morse(n, pair):
    return "".join(pair[bin(i).count("1") & 1] for i in range(n))


WORDS = thue_morse(1024, "ab"), thue_morse(1024, "ba")


def test_products_and_sums_are_exact():
    rng = random.Random(1)
    x, y = ([rng.randrange(b.PRIME) for _ in range(500)] + [0, 1, b.PRIME - 1] for _ in range(2))
    assert b.times(np.array(x, np.uint64), np.array(y, np.uint64)).tolist() == [i * j % b.PRIME for i, j in zip(x, y)]
    data = np.array([rng.randrange(256) for _ in range(3000)], np.uint8)
    sums, total = b.RangeHash(data).sums.tolist(), 0
    for i, v in enumerate(data.tolist()):
        assert sums[i] == total
        total = (total + int(b._VALUES[v]) * pow(b._BASE, i, b.PRIME)) % b.PRIME
    assert b.RangeHash(np.array([2**64 - 1, b.PRIME, 0], np.uint64)).sums[1] == (2**64 - 1) % b.PRIME


def test_equal_ranges_have_equal_hashes():
    text = np.frombuffer(b"the owner of the store, the owner of the stare", np.uint8)
    h = b.RangeHash(text)
    at = np.array([0, 24, 0, 24])
    a, c, d, e = h.of(at, at + np.array([22, 22, 19, 19])).tolist()
    assert d == e and a != c
    assert (b.fixed_hashes(text, 7) == h.of(np.arange(len(text) - 6), np.arange(len(text) - 6) + 7)).all()


def test_hashes_of_words_and_lines():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(4000)]
    words += [b"a" * n for n in range(300)] + [b"\x00" * n for n in range(100)]
    for gap in (b"", b" ", b"zz"):
        data = np.frombuffer(gap + gap.join(words), np.uint8)
        size = np.array([len(w) for w in words])
        end = np.cumsum(size + len(gap))
        got = b.hashes_of(data, end - size, end).tolist()
        by_word = dict(zip(words, got))
        assert all(by_word[w] == h for w, h in zip(words, got)) and len(set(by_word.values())) == len(by_word)
        if gap:
            assert by_word == before
        before = by_word
    assert len(b.hashes_of(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_texts_that_collide_modulo_powers_of_two():
    for n in (1024, 2048, 4096):
        x, y = (np.frombuffer(thue_morse(n, p).encode(), np.uint8) for p in ("ab", "ba"))
        assert b.RangeHash(x).of(np.array([0]), np.array([n])) != b.RangeHash(y).of(np.array([0]), np.array([n]))
    # The same of sequences of two hashes, as words and lines are.
    x, y = (np.array([3 if c == "a" else 10**18 for c in w], np.uint64) for w in WORDS)
    assert b.RangeHash(x).of(np.array([0]), np.array([1024])) != b.RangeHash(y).of(np.array([0]), np.array([1024]))


def test_operators_keep_such_texts_apart(spark):
    entries = spark.createDataFrame([(i, f"x\n{w}\ny") for i, w in enumerate(WORDS)], "entry_id bigint, full_text string")
    items = spark.createDataFrame([(1, WORDS[0])], "item_id bigint, text string")
    got = {r.entry_id: r.contaminated for r in contamination.benchmark_matches(entries, items).collect()}
    assert got == {0: True, 1: False}
    assert [r.n_removed_lines for r in repeated_lines.deduplicated_lines(entries).collect()] == [0, 0]
