"""Cube-method mixing: targets against water filling, balance, bounds, reruns."""
import random
import re
from collections import Counter, defaultdict

import pytest

from ticketlens.llm import mixing


def plain_targets(sizes):
    """Sharing by weight, again and again, as the contract says it."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: unit * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def check(got, sizes):
    want = plain_targets(sizes)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r["size"]
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * most[s], 1), (s, taken[s], want[s])


def with_source(df):
    plan = mixing.mix(df)
    return plan.join(df.select("doc_id", "source"), "doc_id").collect()


def test_targets_and_balance(spark, small_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    sizes = Counter()
    for r in small_docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    got = with_source(small_docs)
    assert len(got) == small_docs.count()
    check(got, sizes)


def test_one_source_with_most_rows(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    r = random.Random(5)
    rows = [(i, "w " * r.choice([1, 5, 40]), "en", r.choice(["a", "b", "big", "big", "big", None]))
            for i in range(600)]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    df = docs_of(rows)
    got = mixing.mix(df.withColumn("copies", df.doc_id), row="doc_id").collect()
    src = {x[0]: x[3] for x in rows}
    taken = Counter()
    for x in got:
        taken[src[x.doc_id]] += x.taken
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 80
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in got}


def test_flight_keeps_both_totals():
    r = random.Random(1)
    p, z = [r.random() for _ in range(500)], [float(r.randint(0, 9)) for _ in range(500)]
    a, b = sum(p), sum(x * y for x, y in zip(p, z))
    left = mixing.flight(p, z, r)
    assert len(left) <= 2 and all(x in (0, 1) for i, x in enumerate(p) if i not in left)
    assert sum(p) == pytest.approx(a) and sum(x * y for x, y in zip(p, z)) == pytest.approx(b)


def test_inclusion_probabilities_are_kept():
    n = Counter()
    for seed in range(3000):
        p, z = [.3] * 5, [1., 2., 3., 4., 10.]
        mixing.land(p, z, mixing.flight(p, z, random.Random(seed)))
        n.update(i for i in range(5) if p[i])
    assert sum(n.values()) / 3000 == pytest.approx(1.5, abs=.5)


def test_edge_cases(docs_of):
    df = docs_of([(1, None, None, None), (2, "", "x", "a"), (None, "one two", "x", "b"), (3, "same", "x", "b"),
                  (3, "same", "x", "b"), (4, "long " * 30000, "x", "c")])
    got = mixing.mix(df).collect()
    assert len(got) == 6 and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def test_equal_rows_are_one_unit_and_other_columns_tell_rows_apart(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 20)
    seen = []
    walk = mixing._walk
    monkeypatch.setattr(mixing, "_walk", lambda final: seen.append(final) or walk(final))
    rows = [(7, "same words here", "en", "a")] * 300 + [(i, f"text of number {i}", "en", "ab"[i % 2]) for i in range(400, 480)]
    out = mixing.mix(docs_of(rows)).collect()
    mine = [r.copies for r in out if r.doc_id == 7]
    assert len(out) == 380 and len(mine) == 300 and max(mine) - min(mine) <= 1 and max(r.copies for r in out) <= 2
    target = {r.target for r in out if r.doc_id == 7}.pop()
    assert abs(sum(r.taken for r in out if r.doc_id == 7 or r.doc_id % 2 == 0 and r.doc_id >= 400) - target) <= 8
    rows = [(1, "one two three", "en", "s1")] * 2 + [(1, "one two three", "en", "s2")] * 2
    got = mixing.mixed(docs_of(rows), weights=(1, 1), share=2.0, cap=2.0).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"s1": 4, "s2": 4}
