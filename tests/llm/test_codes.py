"""Vector codes against measuring every entry."""
from hashlib import sha256

import numpy as np
import pytest

from ticketlens.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector, label) -> [(id, label, code, error)] and the books, in plain Python integers."""
    kept = [(i, [int(np.clip(np.floor(4096 * x), -codes.LIMIT, codes.LIMIT)) for x in v], lab) for i, v, lab in rows
            if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w:(p + 1) * w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(of[k]) for x in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    out = []
    for (i, _, lab), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def check(spark, rows, table=None, **how):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3) if table is None else table
    want, books = plain(rows, **{k: v for k, v in how.items()})
    found = codes.codebooks(table, **how)
    got = codes.encode(table, found)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], str(r[1]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert (found.tolist() if found is not None else None) == books
    return got, found, want


@pytest.mark.parametrize("entries,d", [(1, 1), (2, 3), (16, 8), (64, 4)])
def test_slices_find_the_first_nearest_entry(entries, d):
    rng = np.random.default_rng(entries)
    for spread in (3, 1000, 1 << 27):
        book = rng.integers(-spread, spread + 1, (entries, d))
        book[entries // 2:] = book[:entries - entries // 2]  # equal entries: the first counts
        x = rng.integers(-spread, spread + 1, (500, d))
        s = codes.Slices(book)
        all_ = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        e, far = s.nearest(x)
        assert (e == all_.argmin(axis=1)).all() and (far == all_.min(axis=1)).all()
        if entries == 64 and spread > 3:  # fewer than all are measured
            assert np.bitwise_count(s.candidates(x)).mean() < 48
    assert s.nearest(x[:0])[0].shape == (0,)
    with pytest.raises(ValueError):
        codes.Slices(np.zeros((65, 2), np.int64))


def test_given_vectors_match_plain_integers(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.select("vec_id", "embedding", "label").collect()]
    got, found, want = check(spark, rows, table)
    assert len(set(r[2] for r in want)) > 50 and len(rows) > 400
    out = {r.vec_id: r for r in codes.op12_vector_codes(spark, sf_small).collect()}
    by_label = {}
    for i, lab, _, err in want:
        by_label[lab] = by_label.get(lab, 0) + err
    text = ",".join(str(x) for p in found.tolist() for e in p for x in e)
    assert {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.values()} == {
        (i, c, err, by_label[lab], sha256(text.encode()).hexdigest()) for i, lab, c, err in want}


def test_nulls_ties_repeated_rows_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    some = [(int(i) % 25, rng.normal(size=8).round(1).tolist(), None if i % 3 else 1) for i in range(60)]
    rows = some + some[:20] + [(None, [0.0] * 8, 2), (None, [1.0] * 8, None), (1, None, 1), (2, [], 1), (3, [1.0] * 7, 1),
                               (-5, [1.0] * 4, 1), (4, [1.0] * 16, 1), (-3, [None] + [1.0] * 7, 1), (-2, [float("nan")] * 8, 1),
                               (-1, [float("inf")] * 8, 1), (70, [1e300, -1e300] * 4, 1), (71, [-0.0001] * 8, 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 as id", "2 as v", "3 as p", "4 as code", "5 as error")
    check(spark, rows, table)
    check(spark, rows, table, parts=2, entries=5, rounds=2)


def test_few_or_no_vectors(spark):
    check(spark, [(3, [0.5] * 16, 1), (2, [0.25] * 16, 1)])
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 7, 1)]):
        got, found, _ = check(spark, rows, spark.createDataFrame(rows, SCHEMA))
        out = codes.with_totals(got, "label", "error", "label_error")
        assert found is None and out.columns == ["id", "label", "code", "error", "label_error"] and out.count() == 0


def test_totals_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, cast(id as string))) as label", "id as error")
    want = sorted(map(tuple, codes.with_totals(rows, "label", "error", "t").collect()))
    monkeypatch.setattr(codes, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, codes.with_totals(rows, "label", "error", "t").collect())) == want and len(want) == 2000
