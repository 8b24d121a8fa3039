"""Greedy word-piece lengths of form texts by an automaton that never builds the pieces."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.batches import append, add_columns, slices

_CACHED_WORDS = 600_000
_PUNCTUATION = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
WORD = rf"[{_PUNCTUATION}]|[^\s{_PUNCTUATION}]+"


def word_piece_vocabulary(pieces: list[str], space: str = "▁") -> list[str]:
    """Word-piece form of a piece list: pieces that start a word lose the space sign, the others get ``##``."""
    return [p[1:] if p.startswith(space) else "##" + p for p in pieces if p.strip(space)]


class LongestMatch:
    """Trie of the vocabulary with failure links; each link knows how many pieces are popped on following it.

    Reading a character either follows a trie edge or the failure link, so a word costs time linear in its length.
    """

    def __init__(self, vocabulary: list[str], prefix: str = "##"):
        # Node 0 starts words, node 1 their continuations.
        self.edges: dict[tuple[int, str], int] = {}
        ends = [False, False]
        depths = [0, 0]
        for piece in vocabulary:
            node, rest = (1, piece[len(prefix):]) if piece.startswith(prefix) and piece != prefix else (0, piece)
            for char in rest:
                nxt = self.edges.get((node, char))
                if nxt is None:
                    nxt = self.edges[node, char] = len(ends)
                    ends.append(False)
                    depths.append(depths[node] + 1)
                node = nxt
            ends[node] = ends[node] or node > 1
        below: dict[int, list[tuple[str, int]]] = {}
        for (node, char), child in self.edges.items():
            below.setdefault(node, []).append((char, child))
        self.fail = [-1] * len(ends)
        self.popped = [0] * len(ends)
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for char, child in below.get(node, ()):
                if ends[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    at, pops = self.fail[node], self.popped[node]
                    while at >= 0 and (at, char) not in self.edges:
                        pops += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.edges[at, char], pops
                todo.append(child)

    def count(self, word: str) -> int:
        """Number of pieces of a word, longest match first; 0 if it cannot be cut into pieces."""
        node, pieces, edges, fail, popped = 0, 0, self.edges, self.fail, self.popped
        for char in word:
            while (nxt := edges.get((node, char))) is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = nxt
        while node > 1:
            pieces += popped[node]
            node = fail[node]
        return pieces if node == 1 else 0


_matchers: dict[int, tuple[LongestMatch, dict[str, int]]] = {}


def with_token_counts(entries: DataFrame, vocabulary: list[str], text: str = "full_text") -> DataFrame:
    """Append ``n_words``, ``n_tokens`` and ``n_unknown`` (bigint) to each form entry.

    Words are runs of characters that are neither white space nor ASCII punctuation, and single punctuation marks,
    as they are written (no case folding). A word is cut greedily, the longest piece first; a word that cannot be
    cut is one unknown token. The vocabulary (``##`` marks pieces inside words) is of the caller's fixed size and goes
    with the task; counts of words are remembered, up to a fixed number.

    Null and empty texts have 0 words and 0 tokens. Every input row gives one row, repeated ones and null keys too.
    Columns named like the three are replaced, all others stay.
    """
    key = hash(tuple(vocabulary))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _matchers:
            _matchers[key] = (LongestMatch(vocabulary), {})
        matcher, known = _matchers[key]
        find = re.compile(WORD).findall
        for batch in slices(batches, text):
            if len(known) > _CACHED_WORDS:
                known.clear()
            rows = []
            for row in batch.column(text).to_pylist():
                words = find(row or "")
                counts = list(map(known.get, words))
                if None in counts:
                    for i, c in enumerate(counts):
                        if c is None:
                            counts[i] = known[words[i]] = matcher.count(words[i])
                unknown = counts.count(0)
                rows.append((len(words), sum(counts) + unknown, unknown))
            table = np.array(rows, np.int64).reshape(-1, 3)
            names = ("n_words", "n_tokens", "n_unknown")
            yield append(batch, {n: pa.array(table[:, i]) for i, n in enumerate(names)})

    return add_columns(entries, "n_words bigint, n_tokens bigint, n_unknown bigint", make)


def token_counts(entries: DataFrame, vocabulary: list[str], key: str = "entry_id", text: str = "full_text") -> DataFrame:
    """One row (key, n_words, n_tokens, n_unknown) per form entry; see ``with_token_counts``."""
    rows = entries.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return with_token_counts(rows, vocabulary, "_text").select(
        F.col("_key").alias(key), "n_words", "n_tokens", "n_unknown")
