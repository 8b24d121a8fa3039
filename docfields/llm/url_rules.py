"""Verdicts on the addresses of form images: listed rules, and association rules mined from what those decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.materialize import materialize
from docfields.llm.batches import add_columns, append

MAX_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of an address: labels of the host, and runs of letters and digits of the path."""
    mark = lambda values, sign: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(sign), x))
    return F.array_distinct(F.concat(
        mark(F.split(host, r"\."), "host:"), mark(F.split(F.lower(path), r"[^\p{L}\p{Nd}]+"), "path:")))


@dataclass
class ListedRules:
    """Rules such as ``example.net/en/`` by host; a rule fits its host and all subdomains, the longest wins."""

    by_host: dict[str, list[tuple[str, str, str]]]

    @staticmethod
    def of(rules: list[tuple[str, str]]) -> ListedRules:
        """``rules``: (rule, verdict); of equally long rules the first by spelling wins."""
        by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            host, slash, path = rule.partition("/")
            by_host.setdefault(host, []).append((slash + path, rule, verdict))
        return ListedRules(by_host)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best: tuple[str, str] | None = None
        at = 0
        while True:
            for begin, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(begin):
                    if best is None or (-len(rule), rule) < (-len(best[0]), best[0]):
                        best = (rule, verdict)
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


@dataclass
class MinedRules:
    """Mined rules in an inverted index: each stands at its rarest token only."""

    by_token: dict[str, list[tuple[float, float, str, frozenset[str]]]]

    @staticmethod
    def of(rules: list[tuple[list[str], str, float, float]]) -> MinedRules:
        """``rules``: (tokens, verdict, confidence, support). A rule is dropped if a more general one with the same
        verdict is at least as sure."""
        kept: dict[tuple[frozenset[str], str], tuple[float, float]] = {}
        # Kept rules by their first token, the shortest first: a more general rule starts with a token of this one.
        first: dict[tuple[str, str], list[tuple[frozenset[str], float]]] = {}
        for tokens, verdict, confidence, support in sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]), r[1])):
            own = frozenset(tokens)
            if not any(c >= confidence and other <= own for t in own for other, c in first.get((t, verdict), ())):
                kept[own, verdict] = (confidence, support)
                first.setdefault((min(own, default=""), verdict), []).append((own, confidence))
        uses: dict[str, int] = {}
        for tokens, _ in kept:
            for t in tokens:
                uses[t] = uses.get(t, 0) + 1
        by_token: dict[str, list[tuple[float, float, str, frozenset[str]]]] = {}
        for (tokens, verdict), (confidence, support) in kept.items():
            rarest = min(tokens, key=lambda t: (uses[t], t))
            by_token.setdefault(rarest, []).append((confidence, support, verdict, tokens))
        return MinedRules(by_token)

    def verdict(self, tokens: list[str]) -> str:
        """That of the surest matching rule (then the best supported, then block); allow if none matches."""
        own = set(tokens)
        found = [(c, s, v) for t in own for c, s, v, needed in self.by_token.get(t, ()) if needed <= own]
        return max(found)[2] if found else "allow"


def mine_rules(tokens: DataFrame, min_support: float, min_confidence: float, partitions: int | None = None) -> list[tuple[list[str], str, float, float]]:
    """Token combinations that imply a verdict, by FP-growth over all rows (tokens, verdict).

    Their number is bounded by the support, not by the rows; more than ``MAX_RULES`` raise, and ask for more support.
    """
    baskets = tokens.select(F.array_append("tokens", F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    miner = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if partitions:
        miner = miner.setNumPartitions(partitions)
    rules = miner.fit(baskets).associationRules.where("consequent[0] LIKE 'verdict:%'")
    found = rules.select("antecedent", F.expr("substring(consequent[0], 9)"), "confidence", "support").limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; raise min_support")
    return [(list(r[0]), r[1], r[2], r[3]) for r in found]


def judged_urls(entries: DataFrame, rules: list[tuple[str, str]], key: str = "entry_id", url: str = "image_url",
                min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """One row (key, host, path, rule, verdict) per form entry: may its image address be used (allow or block)?

    ``rules`` are (rule, verdict) pairs. Where one fits, the longest decides and stands in ``rule``. The addresses so
    decided are the labels for the others: FP-growth mines the token combinations that imply a verdict with at least
    ``min_support`` of the labelled addresses and ``min_confidence``; rules that a more general one covers are pruned.
    Other addresses get the verdict of the surest mined rule that matches, else allow; their ``rule`` is null.

    Null addresses and those without ``://`` have an empty host and path, so no tokens, and are allowed. Null keys and repeated rows stay; extra columns are ignored. Without any
    labelled address nothing is mined. No rows give no rows.
    """
    listed = ListedRules.of(rules)
    rows = entries.select(F.col(key).alias("_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [listed.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield append(batch, {"rule": pa.array([f and f[0] for f in found], pa.string()),
                                 "verdict": pa.array([f and f[1] for f in found], pa.string())})

    # Stored: mining reads it several times, the last step once more.
    decided = materialize(add_columns(rows, "rule string, verdict string", decide))
    labelled = decided.where("rule IS NOT NULL").select("tokens", "verdict")
    mined = MinedRules.of([] if labelled.isEmpty() else mine_rules(labelled, min_support, min_confidence))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [v or mined.verdict(t) for v, t in zip(batch.column("verdict").to_pylist(), batch.column("tokens").to_pylist(), strict=True)]
            names = [n for n in batch.schema.names if n != "verdict"]
            yield append(batch.select(names), {"verdict": pa.array(verdicts, pa.string())})

    return decided.mapInArrow(complete, decided.schema).select(F.col("_id").alias(key), "host", "path", "rule", "verdict")
