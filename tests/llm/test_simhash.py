"""Covering SimHash against brute force over all pairs."""
import random
from itertools import combinations

import xxhash

from ticketlens.llm import simhash
from ticketlens.llm.components import connected_components


def plain(text):
    ws = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace(
        "\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(values, radius=2):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(values, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(2, list(range(64)))
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)
    deep = simhash.mask_levels(2)[2]
    assert len(deep) == 343 and all((~m & (1 << 64) - 1).bit_count() <= 8 for m in deep)


def test_fingerprints_and_components_match_brute_force(spark, small_docs):
    rows = small_docs.select("doc_id", "text").collect()
    want = {r.doc_id: plain(r.text) for r in rows}
    got = {r.doc_id: r for r in simhash.near_duplicates(small_docs).collect()}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == want
    root = brute(sorted(set(want.values())))
    first = {}
    for d in sorted(want):
        first.setdefault(root[want[d]], d)
    assert {k: r.component_id for k, r in got.items()} == {d: first[root[v]] for d, v in want.items()}


def test_hot_buckets_are_split_without_losing_a_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    r = random.Random(3)
    base = r.getrandbits(64) - (1 << 63)
    values = {base}
    while len(values) < 300:
        v = r.choice(sorted(values)) if r.random() < .5 else base
        for _ in range(r.randint(1, 4)):
            v ^= 1 << r.randrange(63)
        values.add(v)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {x.node: x.root for x in connected_components(simhash.links(df)).collect()}
    want = brute(sorted(values))
    assert {v: roots.get(v, v) for v in values} == want


def test_edge_cases(spark, docs_of):
    long = "x y z w " * 20000
    df = docs_of([(5, None), (3, ""), (9, " \n\t"), (1, "Ein Wort"), (2, "ein wort"), (None, "ein wort"),
                  (7, long), (7, long), (8, "ÄB c d")]).selectExpr("*", "1 as fp", "2 as component_id")
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id)
           for r in simhash.near_duplicates(df.drop("fp", "component_id")).collect()]
    assert sorted((g for g in got if g[0] is not None)) == sorted(
        [(5, 0, 3), (3, 0, 3), (9, 0, 3), (1, plain("ein wort"), 1), (2, plain("ein wort"), 1),
         (7, plain(long), 7), (7, plain(long), 7), (8, plain("ÄB c d"), 8)])
    assert (None, plain("ein wort"), 1) in got
    assert len(simhash.near_duplicates(df).collect()) == 9
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, x) for x in range(900, 960)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 900 for x in [*range(900, 960), 1000]}}
    assert connected_components(df.limit(0)).collect() == []
