"""Encoding and decoding against the sentencepiece library, token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import models

from docfields.llm import pieces, word_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def table():
    return pieces.read_pieces(MODEL)


def random_texts(table, n):
    rng = random.Random(5)
    words = [p.replace("▁", " ") for p, _, kind in table if kind == 1]
    for _ in range(n):
        yield rng.choice([
            lambda: "".join(rng.choice(words) for _ in range(rng.randrange(12))),
            lambda: "".join(rng.choice("abcdeghinorstu  \n\t.é▁ñ日本\U0001f600\x00<0x0A>") for _ in range(rng.randrange(40))),
            lambda: " " * rng.randrange(80) + rng.choice(["", "a", "\n", "日"]) + " " * rng.randrange(40),
            lambda: "".join(rng.choice("eratonish") for _ in range(rng.randrange(60))),
        ])()


def test_ids_are_those_of_the_library(table, library):
    texts = [*random_texts(table, 4000), "a" * 5000, " " * 5000]
    encoder, decoder = pieces.Encoder(table), pieces.Decoder(table)
    ids, offsets = encoder.batch(texts)
    for i, text in enumerate(texts):
        got = ids[offsets[i]:offsets[i + 1]]
        assert got.tolist() == library.encode(text), text
        assert decoder.text(got) == library.decode(got.tolist())


def test_broken_id_lists_decode_as_in_the_library(table, library):
    rng, decoder = random.Random(2), pieces.Decoder(table)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(9))]
        assert decoder.text(np.array(ids, np.int64)) == library.decode(ids), ids


def test_remembered_words_are_bounded(table, library, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHED_CHUNKS", 3)
    monkeypatch.setattr(pieces, "_CACHED_PAIRS", 3)
    encoder = pieces.Encoder(table)
    for text in ["one two three four five", "five six", "", "seven eight nine ten"]:
        ids, _ = encoder.batch([text, None, text])
        assert ids.tolist() == library.encode(text) * 2


def test_every_row_is_encoded_and_decoded(spark, entries, corpus, library):
    rows = pieces.encoded_entries(entries, MODEL).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((k, library.encode(t or ""), digest(t or "")) for k, t in corpus), key=str)
    assert sorted(((r[0], list(r[1]), digest(r[2])) for r in rows), key=str) == want
    kept = pieces.with_token_ids(entries, MODEL)
    assert kept.columns == [*entries.columns, "token_ids"]
    assert pieces.encoded_entries(entries.limit(0), MODEL).count() == 0


def test_token_counts_are_those_of_the_library(spark, entries, corpus, table):
    vocabulary = word_pieces.word_piece_vocabulary([p for p, _, kind in table if kind == 1])
    ids = {p: i for i, p in enumerate(["[UNK]", *vocabulary])}
    library = models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=10**6)
    import re
    matcher, rng = word_pieces.LongestMatch(vocabulary), random.Random(4)
    for _ in range(5000):
        word = "".join(rng.choice("abeinorst☃日é.ñ") for _ in range(rng.randrange(1, 14)))
        tokens = [t.value for t in library.tokenize(word)]
        assert matcher.count(word) == (0 if tokens == ["[UNK]"] else len(tokens)), word
    want = []
    for key, text in corpus:
        words = re.findall(word_pieces.WORD, text or "")
        tokens = [t.value for w in words for t in library.tokenize(w)]
        want.append((key, len(words), len(tokens), tokens.count("[UNK]")))
    got = [tuple(r) for r in word_pieces.token_counts(entries, vocabulary).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_vocabulary_with_failure_chains():
    matcher = word_pieces.LongestMatch(["a", "abcdx", "##b", "##c", "##cdy", "##dz"])
    assert [matcher.count(w) for w in ["a", "abcdx", "abcdz", "abcdy", "abcd", "x", "ab", "##", "abc"]] == [1, 1, 4, 3, 0, 0, 2, 0, 3]


def test_decoding_of_id_lists(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["Owner of the store, ñ 日本 🙂", "", "  two  blanks ", "x" * 300]
    rows = [(i, library.encode(t)) for i, t in enumerate(texts)] + [(4, None), (5, []), (6, [None, 450, None, 451])]
    df = spark.createDataFrame([(k, ids, "old") for k, ids in rows], "k int, token_ids array<int>, decoded_text string").repartition(3)
    got = {r.k: r.decoded_text for r in pieces.with_decoded_text(df, MODEL).collect()}
    assert got == {k: library.decode([i for i in ids or [] if i is not None]) for k, ids in rows}
    assert pieces.with_decoded_text(df.limit(0), MODEL).collect() == []
    with pytest.raises(Exception):
        pieces.with_decoded_text(df.selectExpr("array(10000000) AS token_ids"), MODEL).collect()
