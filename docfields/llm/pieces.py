"""Merge-type sentence pieces of form texts: encoding by a table of last tokens per prefix, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.batches import add_columns, append, ragged, slices

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
_CACHED_CHUNKS = 200_000
_CACHED_PAIRS = 200_000
_CACHED_LENGTH = 64
# Piece types of the model format.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a merge-type model file, in id order."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, normalizer = model.trainer_spec, model.normalizer_spec
    if spec.model_type != 2 or not spec.byte_fallback or normalizer.precompiled_charsmap or not (
            normalizer.add_dummy_prefix and normalizer.escape_whitespaces) or normalizer.remove_extra_whitespaces:
        raise ValueError("only merge models with byte fallback and an identity normaliser are read")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    if any(kind == _USER for _, _, kind in pieces):
        raise ValueError("user-defined symbols are not supported")
    if any(SPACE in piece.lstrip(SPACE) or piece.strip(SPACE) and piece.startswith(SPACE * 2) for piece, _, _ in pieces):
        raise ValueError("pieces must not reach over the start of a word")
    return pieces


class Encoder:
    """Ids of texts. Built on the executor from the shipped list of pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.id_of = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _UNUSED)}
        self.score = {p: s for p, s, kind in pieces if kind in (_NORMAL, _UNUSED)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if not p.startswith(SPACE * 2):
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[int, dict[str, list[tuple[str, float]]]] = {0: {}, -1: {}}
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])

    def merges(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """The merges one by one, as (rank, parts after it): the best-scored pair first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[x], i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in self.score]
            if not found:
                break
            rank, i = min(found)
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            yield rank, parts

    def edge(self, piece: str, at: int) -> list[tuple[str, float]] | None:
        """What stands at the edge (first: 0, last: -1) of a piece while it is merged, with the worst rank of the
        merges that happen until it changes; the finished piece has rank infinity. None if it is never finished."""
        kept = self.edges[at].get(piece)
        if kept is None:
            kept, worst, shown, parts = [], 0.0, piece[at], [piece] if len(piece) == 1 else list(piece)
            for rank, parts in self.merges(piece):
                worst = max(worst, rank)
                if parts[at] != shown:
                    kept.append((shown, worst))
                    worst, shown = 0.0, parts[at]
            kept = [*kept, (piece, float("inf"))] if len(parts) == 1 else []
            self.edges[at][piece] = kept
        return kept or None

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``right`` can follow ``left``: merging the characters of both gives just these two.

        Both sides merge by themselves; they fail to stay apart if at some moment the pair across the border is
        better than the next merge of either side (of equals the leftmost goes first).
        """
        b = self.edge(right, 0)
        if not left or b is None:
            return b is not None
        a = self.edge(left, -1)
        if a is None:
            return False
        i = j = 0
        while True:
            (x, leave_x), (y, leave_y) = a[i], b[j]
            rank = -self.score.get(x + y, -float("inf"))
            if rank < leave_x and rank <= leave_y:
                return False
            if leave_x == leave_y == float("inf"):
                return True
            if leave_x <= leave_y:
                i += 1
            else:
                j += 1

    def word(self, text: str) -> list[str]:
        """Pieces of a word that starts with one space sign.

        Every prefix of the word has one encoding, so one last token. It is the piece that ends the prefix (all of
        them are automaton matches) and is compatible with the last token of the prefix before it. A character
        that is no piece is a token of its own.
        """
        last = ["", *text]
        fits, done = self.fits, -1
        for end, piece in self.automaton.iter(text):
            if done != end:
                left = last[end + 1 - len(piece)]
                fit = fits.get((left, piece))
                if fit is None:
                    fit = fits[left, piece] = self.compatible(left, piece)
                if fit:
                    last[end + 1], done = piece, end
        n, out = len(text), []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def spaces(self, n: int) -> list[str]:
        """Pieces of a run of space signs: they all have the same score, so the leftmost pair merges first."""
        out: list[str] = []
        for _ in range(n):
            out.append(SPACE)
            while len(out) > 1 and out[-2] + out[-1] in self.score:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def chunk(self, text: str) -> list[int]:
        """Ids of a run of space signs and the word after it."""
        rest = text.lstrip(SPACE)
        run = len(text) - len(rest)
        parts = self.word(SPACE + rest) if rest else [SPACE]
        # Space signs merge with each other after all else, with the first of the word if it stayed alone.
        parts = self.spaces(run) + parts[1:] if parts[0] == SPACE else self.spaces(run - 1) + parts
        out: list[int] = []
        for p in parts:
            found = self.id_of.get(p)
            out += [found] if found is not None else [self.byte_id[b] for b in p.encode()]
        return out

    def code(self, text: str) -> int:
        at = len(self.starts) - 1
        self.ids.extend(self.chunk(text))
        self.starts.append(len(self.ids))
        if len(text) <= _CACHED_LENGTH:
            self.codes[text] = at
        return at

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's ids."""
        if len(self.codes) > _CACHED_CHUNKS:
            self.forget()
        if len(self.fits) > _CACHED_PAIRS:
            self.fits.clear()
        flat: list[int] = []
        counts = [0]
        for text in texts:
            if text:
                get = self.codes.get
                for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE)):
                    known = get(c)
                    flat.append(self.code(c) if known is None else known)
            counts.append(len(flat))
        starts = np.array(self.starts, np.int64)
        used = np.array(flat, np.int64)
        sizes = starts[used + 1] - starts[used]
        ids = np.array(self.ids, np.int32)[ragged(starts[used], sizes)]
        return ids, np.concatenate(([0], np.cumsum(sizes)))[counts]


class Decoder:
    """Texts of id lists."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.kinds = np.array([kind for _, _, kind in pieces])
        shown = {_UNKNOWN: lambda p: " ⁇ ".encode(), _CONTROL: lambda p: b"",
                 _BYTE: lambda p: bytes([int(p[3:5], 16)])}
        surface = [shown.get(kind, lambda p: p.replace(SPACE, " ").encode())(p) for p, _, kind in pieces]
        self.sizes = np.array([len(s) for s in surface], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.sheds = np.array([p.startswith(SPACE) and kind == _NORMAL for p, _, kind in pieces])

    def text(self, ids: np.ndarray) -> str:
        said = ids[self.kinds[ids] != _CONTROL]
        if len(said) < len(ids) and (self.kinds[said] == _BYTE).any():
            return self._broken(ids)
        raw = self.bytes[ragged(self.starts[said], self.sizes[said])].tobytes()
        if len(said) and self.sheds[said[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._broken(ids)

    def _broken(self, ids: np.ndarray) -> str:
        """Runs of byte pieces, each by itself: a byte that belongs to no character becomes U+FFFD."""
        out, i = [], 0
        first = int(np.argmax(self.kinds[ids] != _CONTROL))
        while i < len(ids):
            j = i
            while j < len(ids) and (self.kinds[ids[j]] == _BYTE) == (self.kinds[ids[i]] == _BYTE):
                j += 1
            raw = self.bytes[ragged(self.starts[ids[i:j]], self.sizes[ids[i:j]])].tobytes()
            if self.kinds[ids[i]] != _BYTE:
                out.append(raw[1 if i <= first < j and self.sheds[ids[first]] else 0:].decode())
            while self.kinds[ids[i]] == _BYTE and raw:
                for k in range(min(4, len(raw)), 0, -1):
                    try:
                        char = raw[:k].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        out.append(char)
                        raw = raw[k:]
                        break
                else:
                    out.append("�")
                    raw = raw[1:]
            i = j
        return "".join(out)


_built: dict[tuple[str, int], object] = {}


def _once(kind: type, pieces: list[tuple[str, float, int]]):
    """One encoder or decoder for each Python worker and vocabulary."""
    key = (kind.__name__, hash(tuple(pieces)))
    if key not in _built:
        _built[key] = kind(pieces)
    return _built[key]


def with_token_ids(entries: DataFrame, model: str, text: str = "full_text", ids: str = "token_ids") -> DataFrame:
    """Append ``ids`` (array<int>) to each form entry: the encoding of its whole text by the model file ``model``.

    No begin or end ids, no sampling. Only words are looked at together (pieces do not reach over the start of a
    word), so encodings of words are remembered, up to a fixed number of them. A null or empty text has no ids (an
    empty array). Every input row gives one row; a column named like ``ids`` is replaced, the others stay.
    """
    pieces = read_pieces(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _once(Encoder, pieces)
        for batch in slices(batches, text):
            found, offsets = encoder.batch(batch.column(text).to_pylist())
            yield append(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))})
        encoder.forget()  # the Python worker lives on

    return add_columns(entries, f"`{ids}` array<int>", make)


def with_round_trip(entries: DataFrame, model: str, text: str = "full_text") -> DataFrame:
    """Append ``token_ids`` and ``decoded_text`` in one pass; see ``with_token_ids`` and ``with_decoded_text``."""
    pieces = read_pieces(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _once(Encoder, pieces), _once(Decoder, pieces)
        for batch in slices(batches, text):
            ids, offsets = encoder.batch(batch.column(text).to_pylist())
            texts = [decoder.text(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield append(batch, {"token_ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                                 "decoded_text": pa.array(texts, pa.string())})
        encoder.forget()

    return add_columns(entries, "token_ids array<int>, decoded_text string", make)


def with_decoded_text(tokens: DataFrame, model: str, ids: str = "token_ids", text: str = "decoded_text") -> DataFrame:
    """Append ``text``: the decoding of the id list in each row.

    Null or empty lists give an empty text. Null ids in a list are skipped; ids outside the vocabulary raise. Every
    input row gives one row; a column named like ``text`` is replaced, the others stay.
    """
    pieces = read_pieces(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, pieces)
        for batch in batches:
            lists = batch.column(ids)
            found = []
            for row in lists:
                values = row.values
                found.append("" if values is None else decoder.text(values.drop_null().to_numpy(zero_copy_only=False)))
            yield append(batch, {text: pa.array(found, pa.string())})

    return add_columns(tokens, f"`{text}` string", make)


def encoded_entries(entries: DataFrame, model: str, key: str = "entry_id", text: str = "full_text") -> DataFrame:
    """One row (key, token_ids, decoded_text) per form entry: its ids, and what they decode to.

    Null keys and repeated rows stay as they are; extra columns are ignored. See ``with_token_ids``.
    """
    rows = entries.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return with_round_trip(rows, model, "_text").select(F.col("_key").alias(key), "token_ids", "decoded_text")
