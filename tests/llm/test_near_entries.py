"""SimHash near-duplicates against a brute-force version."""

import random
import re

import xxhash

from docfields.llm import near_entries


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [simhash(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    out = []
    for i, (k, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((k, prints[i], min(keys, default=None)))
    return out


def order(rows):
    return sorted(rows, key=str)


def test_classes_match_brute_force(spark, entries, corpus):
    got = near_entries.near_duplicate_entries(entries).collect()
    assert order((r[0], r[1] % 2**64, r[2]) for r in got) == order(brute(corpus))
    assert len({r[2] for r in got}) < len(got) - 10


def test_links_connect_the_same_fingerprints_as_all_pairs(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64)}
    while len(values) < 300:
        v = rng.choice(sorted(values)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 2, 3])):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    links = near_entries.fingerprint_links(df)
    roots = {r.node: r.root for r in near_entries.components(links).collect()}
    want = {v: v for v in signed}
    for _ in range(300):
        changed = False
        for a in signed:
            for b in signed:
                if (a ^ b).bit_count() <= 2 and want[a] > want[b]:
                    want[a], changed = want[b], True
        if not changed:
            break
    assert {v: roots.get(v, v) for v in signed} == want


def test_tree_follows_only_edges_within_the_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    tree = near_entries.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 4096, 37):
        assert sorted(tree.within(q, 2)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 2)


def test_representatives_and_empty_table(spark, entries):
    kept = near_entries.representatives(entries)
    assert kept.columns == entries.columns
    ids = [r.entry_id for r in kept.collect()]
    classes = near_entries.near_duplicate_entries(entries.where("entry_id is not null"))
    assert {i for i in ids if i is not None} == {r.component_id for r in classes.collect()}
    assert near_entries.near_duplicate_entries(entries.limit(0)).count() == 0
