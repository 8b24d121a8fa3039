"""Packing: token ids against the tokenizers library, bins against placing pieces one by one."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from docfields.llm import packing as p
from docfields.llm import queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "don't", "'tis the owner's", "\"'s", "(\"'tis", "x'''s 'S", "ΟΔΟΣ. Σ", "J̌ J̌x", "İx", "Áb", "≮ a≮b",
       "1⃣2", "a b\u0085c d", "“a”, b—c", "x\x00y\x1cz", "３４ ²½ 12345", "<|startoftext|> a<|endoftext|>b", "<|STARTOFTEXT|>", "日本語テキスト", "é.é",
       "ﬁ K Å", "don’t", "a_b-c/d@e.f", "🙂🙂 x🙂", "İSTANBUL", "ß" * 50, "word " * 5000, "\n\t\x0b\x0cq"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts_of(n):
    rng = random.Random(8)
    parts = ["Owner", "'s", "'", "’", " ", " ", "\n", ".", ",", "é", "é", "12", "x", "<", "̸", "|", "CITY", "ñ", "Σ", "<|endoftext|>", "ß", " ", "日"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_equal_the_library(library):
    encoder = p.Encoder(PATH)
    assert encoder.chunked
    for texts in (ODD, texts_of(3000), [], [None], ["<|endoftext|>"]):
        ids, offsets = encoder.encode(pa.array(texts, pa.string()))
        assert len(offsets) == len(texts) + 1 and offsets[-1] == len(ids)
        for i, text in enumerate(texts):
            assert ids[offsets[i]: offsets[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, known = p.Encoder(path), tokenizers.Tokenizer.from_file(path)
    assert not encoder.chunked
    ids, offsets = encoder.encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [known.encode(t or "", add_special_tokens=False).ids for t in ODD]


def test_chunks_are_forgotten_when_too_many(library, monkeypatch):
    monkeypatch.setattr(p, "_CACHED_CHUNKS", 20)
    encoder, texts = p.Encoder(PATH), [t for t in texts_of(60) if "<|" not in t]
    for text in texts:
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def one_by_one(lengths, room, rule, weights):
    """Contents of the bins when pieces are placed one after the other, the longest first."""
    bins = []
    w = [x / f / f for x, f in zip(weights, room)]
    for n in sorted(lengths, reverse=True):
        need, best = (n, 1, n * n), None
        for i, b in enumerate(bins):
            left = [f - x for f, x in zip(room, (sum(b), len(b), sum(x * x for x in b)))]
            if all(x >= y for x, y in zip(left, need)):
                score = sum(a * (x - y) ** 2 for a, x, y in zip(w, left, need)) if rule == "norm" else -sum(a * x * y for a, x, y in zip(w, left, need))
                if best is None or score < best[0] - 1e-15:
                    best = (score, i)
        if best:
            bins[best[1]].append(n)
        else:
            bins.append([n])
    return sorted(sorted(b) for b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("room", [(40, 40, 1600), (40, 3, 1600), (40, 40, 700), (100, 5, 4000)])
def test_equal_pieces_at_once_are_as_one_by_one(rule, room):
    rng = random.Random(str(room))
    for trial in range(20):
        lengths = [rng.choice([1, 1, 2, 3, 5, 7, 11, 12, 13, 20, 25]) for _ in range(rng.randrange(1, 120))]
        fit = p.BestFit(room, rule, (1.0, 0.13, 0.07))
        for n in sorted(set(lengths), reverse=True):
            fit.add(n, lengths.count(n))
        bins = defaultdict(list)
        ends = {n: lengths.count(n) for n in lengths}
        for i, (n, rank, first, offset, each) in enumerate(fit.runs):
            nxt = fit.runs[i + 1] if i + 1 < len(fit.runs) else (0, 0)
            for r in range((nxt[1] if nxt[0] == n else ends[n]) - rank):
                bins[first + r // each].append((offset + r % each * n, n))
        for held in bins.values():
            held.sort()
            assert [at for at, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist()
            assert sum(n for _, n in held) <= room[0] and len(held) <= room[1] and sum(n * n for _, n in held) <= room[2]
        got = sorted(sorted(n for _, n in held) for held in bins.values())
        assert sorted(n for b in got for n in b) == sorted(lengths)
        if rule == "norm":
            assert got == one_by_one(lengths, room, rule, (1.0, 0.13, 0.07)), trial
        assert abs(len(got) - len(one_by_one(lengths, room, rule, (1.0, 0.13, 0.07)))) <= 1
        assert sorted(bins) == list(range(fit.n_bins))


def check_sequences(rows, capacity):
    """Rows (sequence_id, offset, length) are gapless sequences within the capacity; returns their number."""
    sequences = defaultdict(list)
    for s, offset, n in rows:
        sequences[s].append((offset, n))
    for held in sequences.values():
        held.sort()
        assert [at for at, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist()
        assert sum(n for _, n in held) <= capacity
    return len(sequences)


def test_packed_table(spark, monkeypatch):
    monkeypatch.setattr(p, "_GROUP_ROWS", 50)
    rng = random.Random(2)
    data = [(i, 7 if i % 3 == 0 else rng.randrange(1, 65), "x", i) for i in range(3000)] + [(1, None, "n", 0), (2, 0, "n", 0), (None, 64, "k", 0), (None, 64, "k", 0)]
    df = spark.createDataFrame(data, "entry_id int, length int, _salt string, sequence_id int").repartition(9)
    got = p.packed(df, 64)
    assert got.columns == ["entry_id", "length", "_salt", "sequence_id", "offset"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[:3] for r in rows if r[2] == "x") == [d[:3] for d in data[:3000]] and len(rows) == len(data)
    assert all((r[3] is None) == (r[4] is None) == (r[2] == "n") for r in rows)
    total = sum(d[1] or 0 for d in data)
    assert check_sequences([(r[3], r[4], r[1]) for r in rows if r[3] is not None], 64) <= 1.01 * total / 64 + 1
    few = [tuple(r) for r in p.packed(df.where("length <= 20"), 64, entries_per_sequence=2, attention_cost=500).collect()]
    held = defaultdict(list)
    for r in few:
        held[r[3]].append(r[1])
    held.pop(None)
    assert all(len(h) <= 2 and sum(x * x for x in h) <= 500 for h in held.values())
    assert p.packed(df.limit(0), 64).collect() == []
    with pytest.raises(ValueError, match="64 tokens"):
        p.packed(df, 63)
    with pytest.raises(ValueError):
        p.packed(df, 64, attention_cost=100)


def test_pieces(spark, library, entries, corpus):
    got = p.token_pieces(entries, PATH, end_id=5, longest=100)
    assert got.columns == ["entry_id", "piece", "start", "length", "token_ids"]
    found = defaultdict(list)
    for r in got.collect():
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert len(ids) == r.length and r.start == r.piece * 100
        found[r.entry_id].append((r.piece, ids))
    want = defaultdict(list)
    for key, text in corpus:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 5]
        want[key] += [(i // 100, ids[i:i + 100]) for i in range(0, len(ids), 100)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert p.token_pieces(entries.limit(0), PATH).collect() == []


def test_query_packs_every_document(spark, library):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_best_fit_packing(spark, sf)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    want, total = [], 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at:at + 2048], "<u4")
            want.append((d.doc_id, piece, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted(tuple(r[:5]) for r in rows) == sorted(want)
    assert check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 2048) <= -(-total // 2048) + 1
