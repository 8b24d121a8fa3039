"""Verdicts on addresses against a scan of all rules and of all token combinations."""

import itertools
import random
import re

import pytest

from docfields.llm import url_rules
from docfields.llm.queries import URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def listed(host, path):
    fits = [(len(r), r, v) for r, v in URL_RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def tokens(host, path):
    return {"host:" + x for x in host.split(".") if x} | {"path:" + x for x in re.split(r"[\W_]+", path.lower()) if x}


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(6)
    rows = []
    for i in range(900):
        tld, lang = rng.choice(["net", "com", "org"]), rng.choice(["en", "de", "fr", "es"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'blog.', 'm.'])}{rng.choice(['a', 'b'])}.Example.{tld}/{lang}/"
                        f"{rng.randrange(99999)}{rng.choice(['', '.html', '/', '?x=1', '#top'])}"))
    rows += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "http://"), (1004, "http://NET"), (1005, "ftp://net/x"),
             (1006, "http://internet/"), (1007, "http://a.net?q"), (1008, "x\ny://org/fr/\nz#a://net/"), (None, "http://x.net/en/"),
             (7, rows[7][1]), (1009, "http://a.example.net/en"), (1010, "http://example.net/en/" + "seg/" * 3000), (1011, "://net/")]
    return rows


def test_verdicts_match_brute_force(spark, urls):
    df = spark.createDataFrame([(k, u, 1, "t") for k, u in urls], "entry_id bigint, image_url string, rule int, tokens string").repartition(3)
    got = url_rules.judged_urls(df, URL_RULES).collect()
    labelled = [(tokens(*parse(u)), listed(*parse(u))[1]) for _, u in urls if listed(*parse(u))]
    counts, of = {}, {}
    for own, verdict in labelled:
        often = [t for t in own if sum(t in o for o, _ in labelled) >= 0.01 * len(labelled)]
        for n in range(1, len(often) + 1):
            for combo in itertools.combinations(sorted(often), n):
                counts[combo] = counts.get(combo, 0) + 1
                of[combo, verdict] = of.get((combo, verdict), 0) + 1
    rules = [(n / counts[c], n / len(labelled), v, set(c)) for (c, v), n in of.items()
             if n >= 0.01 * len(labelled) and n / counts[c] >= 0.8]
    want = []
    for key, url in urls:
        host, path = parse(url)
        hit = listed(host, path)
        # Pruning drops only rules that a more general, at least as sure one covers: the best confidence stays.
        fits = [r[:3] for r in rules if r[3] <= tokens(host, path)]
        best = {v for c, _, v in fits if c == max(f[0] for f in fits)} if fits else {"allow"}
        want.append((key, host, path, hit and hit[0], {hit[1]} if hit else best))
    by_key = {(w[0], w[1], w[2]): w for w in want}
    assert len(got) == len(urls)
    for r in got:
        _, _, _, rule, verdicts = by_key[r.entry_id, r.host, r.path]
        assert r.rule == rule and r.verdict in verdicts
    assert sum(r.verdict == "block" and r.rule is None for r in got) > 0


def test_no_labels_and_no_rows(spark, urls):
    df = spark.createDataFrame([(k, u) for k, u in urls], "entry_id bigint, image_url string")
    assert {r.verdict for r in url_rules.judged_urls(df, []).collect()} == {"allow"}
    assert url_rules.judged_urls(df.limit(0), URL_RULES).count() == 0


def test_general_rules_replace_special_ones():
    mined = url_rules.MinedRules.of([(["a"], "block", 0.9, 0.2), (["a", "b"], "block", 0.9, 0.1), (["a", "c"], "block", 1.0, 0.1), (["b"], "allow", 0.95, 0.3)])
    assert sum(map(len, mined.by_token.values())) == 3
    assert [mined.verdict(t) for t in (["a"], ["a", "b"], ["a", "b", "c"], ["x"], [])] == ["block", "allow", "block", "allow", "allow"]


def test_pruning_equals_comparing_all_rules():
    rng = random.Random(12)
    rules = [([f"t{x}" for x in rng.sample(range(8), rng.randrange(1, 5))], rng.choice(["allow", "block"]), rng.randrange(80, 100) / 100, 0.1)
             for _ in range(300)]
    rules = list({(frozenset(r[0]), r[1]): r for r in rules}.values())
    want = {(frozenset(t), v) for t, v, c, _ in rules
            if not any(v2 == v and c2 >= c and set(t2) < set(t) for t2, v2, c2, _ in rules)}
    got = url_rules.MinedRules.of(rules)
    assert {(tokens, v) for found in got.by_token.values() for _, _, v, tokens in found} == want
