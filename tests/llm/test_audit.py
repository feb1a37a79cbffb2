"""Filter audit against a document-by-document run of every order."""
import re
from itertools import permutations

from ticketlens.llm import audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def plain(docs, labels):
    """docs (id, text, part), labels (id, quality, toxic) -> the rows of the audit."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = {}
    fails_of = []
    for i, t, p in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (
            len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            re.search(r"[#$%&*|]", t), i is not None and first[t] < i)) if x}
        fails_of.append((i, p or "", fails))
    for part in {p for _, p, _ in fails_of}:
        mine = [(i, f) for i, p, f in fails_of if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for s, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                rows[part, "".join(order), s] = (
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x)
        for key in [k for k in rows if k[0] == part]:
            rows[key] = (*rows[key][:6], shapley[rows[key][6]])
    return rows


def got(counts):
    return {(r.part, r.filter_order, r.step): (*[r[c] for c in COUNTS], r.shapley) for r in audit.audit(counts).collect()}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_every_step_matches_a_document_by_document_run(spark, small_docs, sf_small):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    want = plain([(r.doc_id, r.text, r.source) for r in small_docs.collect()],
                 [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got(audit.cells(small_docs, labels)) == want
    assert any(v[2] for v in want.values()) and any(v[3] for v in want.values()) and any(v[4] for v in want.values())


def test_nulls_ties_repeated_rows_and_clashing_names(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (None, None, "en", None), (3, "a b", "en", None), (2, None), (5, ""),
            (4, "X Y #"), (4, "x y", "en", "b"), (6, long), (7, long, "en", "b"), (0, "é" * 20 + "A"), (0, "a\x0bb c")]
    docs = docs_of([r if len(r) > 2 else (*r, "en", "a") for r in rows])
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (None, 1, 1), (7, 0, 1), (7, None, None), (99, 1, 1)]
    docs = docs.selectExpr("*", "1 as n", "'x' as part", "2 as bits", "'d' as digest", "true as first", "5 as good")
    want = plain([(r[0], r[1], r[3] if len(r) > 3 else "a") for r in rows], labels)
    assert got(audit.cells(docs, labels_of(spark, labels).selectExpr("*", "1 as n", "'x' as part"))) == want


def test_empty_tables(spark, docs_of, small_docs):
    none = labels_of(spark, [])
    assert audit.audit(audit.cells(small_docs.limit(0), none)).count() == 0
    only = got(audit.cells(docs_of(["a b"]), none))
    assert len(only) == 600 and only["a", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 2), ("p", 2, 4, 1, 1)],
                                   "part string, bits int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): r for r in audit.audit(counts, "XY").collect()}
    assert (rows["XY", 1].removed, rows["XY", 2].removed, rows["YX", 1].removed, rows["YX", 2].redundant) == (2, 4, 6, 2)
    assert rows["XY", 1].shapley == 2 and rows["YX", 1].shapley == 10 and rows["XY", 2].unique_fails == 4
