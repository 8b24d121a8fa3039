"""Phrase collocations of form texts: suffix subtrees, cut off at the phrase length, built one group of prefixes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import LOWER, hashes_of, mix, runs, slices, text_bytes

LENGTH = 4
BUDGET = 1 << 21
EXTENDED_BITS = 22
_SLICE_BYTES = 4 << 20
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLANK = pa.scalar(" ", pa.large_string())


def _packed(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that stand in ``data`` one after the other."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Suffixes:
    """Words of some texts as ids of their own dictionary, and the suffix that starts at each word.

    A suffix is the word and up to ``LENGTH - 1`` words after it in the same piece; ``left`` is its number of words.
    Prefixes are known by hashes of group and words: they only say where a suffix goes, never what is counted.
    """

    def __init__(self, texts: pa.Array, groups: pa.Array):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        kind = _KIND[data]
        starts, ends = runs(kind == _WORD, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        n = len(starts)
        new = np.ones(n + 1, bool)
        new[1:n] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
        firsts = np.flatnonzero(new)
        self.left = np.minimum(np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n), LENGTH).astype(np.int8)
        words = _packed(data[kind == _WORD], ends - starts).dictionary_encode()
        self.words = words.dictionary
        self.ids = np.concatenate((words.indices.to_numpy(zero_copy_only=False), np.full(LENGTH, -1, np.int32))).astype(np.int32)
        coded = groups.cast(pa.string()).dictionary_encode()
        self.groups = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False)[row].astype(np.int32)
        seen, at = text_bytes(self.words)
        self._hash = hashes_of(seen, at[:-1], at[1:])
        seen, at = text_bytes(self.groups)
        self._group_hash = hashes_of(seen, at[:-1], at[1:])

    def prefix_hash(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hash of the first ``depth`` words of the suffixes at ``at``, all of which have as many."""
        h = self._group_hash[self.code[at]]
        for d in range(depth):
            h = mix(h * _STEP + self._hash[self.ids[at + d]])
        return h

    def phrase(self, at: np.ndarray, depth: int) -> pa.Array:
        words = [self.words.take(pa.array(self.ids[at + d])) for d in range(depth)]
        return pc.binary_join_element_wise(*words, _BLANK) if depth > 1 else words[0]

    def extended(self, prefixes: list[np.ndarray]) -> list[np.ndarray]:
        """For every depth, the suffixes whose shorter prefixes are all in ``prefixes`` and that reach this depth."""
        at = np.flatnonzero(self.left >= 1)
        found = [at]
        for depth, held in enumerate(prefixes, 1):
            at = at[np.isin(self.prefix_hash(at, depth), held)]
            at = at[self.left[at] > depth]
            found.append(at)
        return found


def _rows(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A position of every distinct row of the key columns and how often it stands there."""
    if len(keys[0]) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys)
    new = np.concatenate(([True], np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)))
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _prefix_counts(entries: DataFrame, prefixes: list[np.ndarray]) -> DataFrame:
    """Exact counts of the prefixes one word longer than those extended so far: (_group, phrase, words, hash, n)."""
    depth = len(prefixes) + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", _SLICE_BYTES):
            s = Suffixes(batch.column("_text"), batch.column("_group"))
            at = s.extended(prefixes)[-1]
            place, counts = _rows([s.ids[at + d] for d in range(depth)] + [s.code[at]])
            at = at[place]
            yield pa.RecordBatch.from_arrays(
                [s.groups.take(pa.array(s.code[at])), s.phrase(at, depth).cast(pa.string()),
                 pa.array(s.prefix_hash(at, depth).view(np.int64)), pa.array(counts)], names=["_group", "phrase", "hash", "n"])

    found = entries.mapInArrow(make, "_group string, phrase string, hash bigint, n bigint")
    return found.groupBy("_group", "phrase", "hash").agg(F.sum("n").alias("n")).withColumn("words", F.lit(depth))


def _planes(ids: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; most high bytes are zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _grouped(entries: DataFrame, prefixes: list[np.ndarray], groups: int) -> DataFrame:
    """The suffixes below the final prefixes, dealt to groups of prefixes: a row holds those of one slice of texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", _SLICE_BYTES):
            s = Suffixes(batch.column("_text"), batch.column("_group"))
            reached = s.extended(prefixes)
            words = s.words.to_pylist()
            rows = []
            for depth in range(1, LENGTH):
                at = reached[depth - 1] if depth <= len(reached) else np.zeros(0, np.int64)
                if depth <= len(prefixes):
                    at = at[~np.isin(s.prefix_hash(at, depth), prefixes[depth - 1])]
                at = at[s.left[at] > depth]
                if not len(at):
                    continue
                group = (s.prefix_hash(at, depth) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                at, group = at[order], group[order]
                cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                for a, b in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist(), strict=True):
                    held = at[a:b]
                    path = np.stack([np.where(s.left[held] > d, s.ids[held + d], -1) for d in range(LENGTH)])
                    used, new = np.unique(path, return_inverse=True)
                    # Number 0 is the end of a short suffix.
                    new = new.ravel() + (used[0] >= 0)
                    codes, code = np.unique(s.code[held], return_inverse=True)
                    rows.append((int(group[a]), depth, " ".join(words[i] for i in used[used >= 0].tolist()).encode(),
                                 s.groups.take(pa.array(codes)).to_pylist(), _planes(np.concatenate((code.ravel(), new)))))
            for i in range(0, len(rows), 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[i:i + 16]), (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary()), strict=True)],
                    names=["bucket", "depth", "words", "codes", "paths"])

    return entries.mapInArrow(make, "bucket int, depth int, words binary, codes array<string>, paths binary")


def _subtree(held: list[tuple[bytes, list[str], bytes]], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """Nodes of ``least`` or more leaves below the prefixes of one group.

    The suffixes are sorted by their words; a node at some depth is a run of suffixes with the same first words, and
    its count is the number of leaves of the run.
    """
    sizes, texts, groups, paths, codes = [], [], [], [], []
    for words, names, numbers in held:
        own = words.decode().split(" ")
        table = _numbers(numbers).reshape(LENGTH + 1, -1)
        sizes.append((len(own), len(names)))
        texts.append(pa.array(own, pa.large_string()))
        groups.append(pa.array(names, pa.string()))
        codes.append(table[0])
        paths.append(table[1:])
    texts, groups = (pa.chunked_array(x).combine_chunks().dictionary_encode() for x in (texts, groups))
    word_of = texts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    group_of = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum([(0, 0), *sizes], axis=0)
    path = np.concatenate([np.concatenate(([0], word_of[start[i, 0]: start[i + 1, 0]] + 1)).astype(np.int32)[p] for i, p in enumerate(paths)], axis=1)
    code = np.concatenate([group_of[start[i, 1]:][c].astype(np.int32) for i, c in enumerate(codes)])
    del paths, codes
    # Two words to a number; arrays as long as the group go as soon as they are not needed.
    upper, lower = (path[d].astype(np.int64) << 32 | path[d + 1] for d in (0, 2))
    del path
    order = np.lexsort((lower, upper, code) if len(groups.dictionary) > 1 else (lower, upper))
    code, upper, lower = code[order], upper[order], lower[order]
    del order
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (upper[1:] >> 32 != upper[:-1] >> 32)

    def part(d: int) -> np.ndarray:
        pair = (upper, lower)[d // 2]
        return pair & 0xFFFFFFFF if d % 2 else pair >> 32

    for d in range(1, LENGTH):
        own = part(d)
        new[1:] |= own[1:] != own[:-1]
        if d < depth:
            continue
        first = np.flatnonzero(new)
        leaves = np.diff(np.append(first, len(new)))
        keep = (leaves >= least) & (own[first] > 0)
        first, leaves = first[keep], leaves[keep]
        words = [texts.dictionary.take(pa.array(part(i)[first] - 1)) for i in range(d + 1)]
        yield pa.RecordBatch.from_arrays(
            [groups.dictionary.take(pa.array(code[first])), pc.binary_join_element_wise(*words, _BLANK).cast(pa.string()),
             pa.array(np.full(len(first), d + 1, np.int32)), pa.array(leaves.astype(np.int64))], names=["_group", "phrase", "words", "n"])


def _subtrees(grouped: DataFrame, least: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["bucket"], row["depth"]):
                    if held:
                        yield from _subtree(held, key[1], least)
                    key, held = (row["bucket"], row["depth"]), []
                held.append((row["words"], row["codes"], row["paths"]))
        if held:
            yield from _subtree(held, key[1], least)

    dealt = grouped.repartition("bucket").sortWithinPartitions("bucket", "depth")
    return dealt.mapInArrow(make, "_group string, phrase string, words int, n bigint")


def phrase_counts(entries: DataFrame, least: int = 30, text: str = "full_text", group: str = "template_id",
                  no_group: str = "none", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to 4 words that stand ``least`` times or more in a group: (_group, phrase, words, n), stored,
    and the number of words of each group: (_group, n).

    Prefixes are split vertically: words are counted, and every prefix with more than ``budget`` occurrences is
    extended by a word and counted again (one pass over the texts a level, none where no prefix is that frequent). The
    remaining prefixes are dealt to groups of about ``budget`` suffixes, so the suffixes of a group fit into one task's
    memory however frequent a word is, and what is more frequent is a sum that combines before the shuffle. Each group's
    subtree is then built by itself, four words deep. The hashes of extended prefixes go to all tasks; there are at
    most ``2 ** 22`` a level, because the budget is raised if the texts hold more than ``2 ** 22`` budgets of words.
    """
    rows = entries.select(F.coalesce(F.col(group).cast("string"), F.lit(no_group)).alias("_group"), F.col(text).alias("_text"))
    levels = [materialize(_prefix_counts(rows, []))]
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    budget = max(budget, total >> EXTENDED_BITS)
    prefixes: list[np.ndarray] = []
    while len(levels) < LENGTH:
        found = levels[-1].where(F.col("n") > budget).select("hash").toArrow().column("hash").to_numpy().view(np.uint64)
        if not len(found):
            break
        prefixes.append(np.sort(found))
        levels.append(materialize(_prefix_counts(rows, prefixes)))
    nodes = _subtrees(_grouped(rows, prefixes, max(1, -(-total // budget))), least)
    for level in levels:
        nodes = nodes.unionByName(level.where(F.col("n") >= least).select("_group", "phrase", "words", "n"))
    return materialize(nodes), levels[0].groupBy("_group").agg(F.sum("n").alias("n"))


def collocations(entries: DataFrame, least: int = 30, best: int = 2000, contained: int = 80, text: str = "full_text",
                 group: str = "template_id", no_group: str = "none", budget: int = BUDGET) -> DataFrame:
    """The ``best`` phrases of the texts of each form template: (group, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at blanks and tabs into words. Per
    group, n counts all words, f(phrase) all its occurrences in pieces, overlapping ones too. Candidates are phrases of
    2 to 4 words with a = f(phrase) >= ``least``. A candidate is cut after each of its words but the last; l and r are
    the counts of the parts, floor(2000000 * a / (l + r)) is the score, the cut with the lowest score counts (ties: the
    shortest first part). Candidates that lie inside a longer candidate with at least ``contained`` percent of their
    occurrences go. Ranks follow score and a, descending, then the phrase in byte order. Products are decimals.

    ``group`` may be any column; its null is ``no_group`` and the result has it as text. Null and empty texts hold no
    words. Every row counts, repeated ones too; keys and other columns, whatever their names, do not matter. A group
    without candidates has no rows; no rows give no rows.
    """
    nodes, words = phrase_counts(entries, least, text, group, no_group, budget)
    candidates = nodes.where("words > 1").select("_group", "phrase", "words", F.col("n").alias("a"))
    counts = nodes.select("_group", "phrase", "n")

    word = F.split("phrase", " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "_group", "phrase", "words", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(counts.select("_group", F.col("phrase").alias("left"), F.col("n").alias("l")), ["_group", "left"])
    cuts = cuts.join(counts.select("_group", F.col("phrase").alias("right"), F.col("n").alias("r")), ["_group", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = cuts.groupBy("_group", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inside = candidates.where("words > 2").select(
        "_group", word.alias("w"), "words", F.col("a").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size")))))).alias("s"))
    inside = inside.select("_group", F.array_join(F.slice("w", F.col("s.at"), F.col("s.size")), " ").alias("phrase"), "longer")
    inside = inside.groupBy("_group", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(inside, ["_group", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * contained))

    ranked = kept.select("_group", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(
        Window.partitionBy("_group").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= best).join(words, "_group").select(
        F.col("_group").alias(group), F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
