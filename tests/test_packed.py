"""Packed weights (a row a document) against the long table's joins, with repeated ids,
empty documents, and slices of a few tokens."""

import numpy as np
from pyspark.sql import functions as F

from ticketlens.operators import features as FE
from ticketlens.operators import models as M
from ticketlens.operators import packed as P
from ticketlens.operators import training as TR

ROWS = [(1, "train", 0, "red green red"), (2, "train", 1, "blue green"), (2, "train", 1, "blue sky"), (3, "val", 0, "red sky"),
        (4, "train", 2, None), (5, "val", 2, "nothing known"), (6, "train", 2, "sky sky green"), (3, "val", 1, "blue")]


def _fitted(spark):
    df = spark.createDataFrame(ROWS, "id long, split string, y int, text string")
    train = F.col("split") == "train"
    rows, vocab, _ = FE.fit_transform_tfidf(df, "id", train, max_features=8, keep=["id", "split", "y"])
    weights = FE.fit_transform_tfidf(df, "id", train, max_features=8)[0]
    return df, train, rows, vocab, weights


def test_rows_are_the_long_weights(spark):
    df, _, rows, vocab, weights = _fitted(spark)
    got = sorted(tuple(r) for r in FE.unpacked(rows, vocab, "id").collect())
    assert got == sorted(tuple(r) for r in weights.collect()) and got
    assert rows.count() == len(ROWS)
    vec = M.feature_vectors(rows, vocab, "id", 8).collect()  # repeated ids are documents of their own
    assert len(vec) == len(ROWS) and all(list(r.features.indices) == sorted(set(r.features.indices)) for r in vec)


def test_sums_and_scores_equal_the_joins(spark):
    df, train, rows, vocab, weights = _fitted(spark)
    labels = df.where(train).select("id", "y")
    old = FE.centroid_coefficients(weights, labels, "id", "y")
    new = FE.centroid_coefficients(P.with_marks(rows, "id", "y", 3, train), labels, "id", "y", vocab, 3)
    a, b = ({(r.term, r.class_id): r.coef for r in x.collect()} for x in (old, new))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k]) for k in a)
    s, t = ({r.id: r.scores for r in x.collect()} for x in (FE.linear_scores(weights, old, "id", 3, ids=df, bias=[1.0, 0.0, 2.0]),
                                                          FE.linear_scores(rows, new, "id", 3, ids=df, bias=[1.0, 0.0, 2.0], vocab=vocab)))
    assert s.keys() == t.keys() and all(np.allclose(s[k], t[k]) for k in s)


def test_epochs_equal_the_joins(spark):
    df, train, rows, vocab, weights = _fitted(spark)
    terms = {r.feature_index: r.term for r in vocab.collect()}
    labels, val = df.where(train).select("id", "y"), df.where("split = 'val'").select("id", "y")
    marked = P.with_marks(rows, "id", "y", 3, train, squared=True)
    mine = P.with_marks(rows, "id", "y", 3, F.col("split") == "val", squared=True)
    for (_, c), (_, d) in zip(TR.epochs(weights, labels, "id", "y", 3, 3, 2.0), TR.epochs(marked, labels, "id", "y", 3, 3, 2.0, len(terms))):
        old, new = {r.term: r.coef for r in c.collect()}, {terms[r.feature_index]: r.coef for r in d.collect()}
        assert old.keys() == new.keys() and all(np.allclose(old[k], new[k]) for k in old)
        s, t = (sorted((r.id, np.round(r.scores, 9).tolist()) for r in x.collect()) for x in
                (TR.class_scores(weights, c, val, "id", 3), TR.class_scores(mine, d, val, "id", 3)))
        assert s == t and len(s) == 3


def test_small_slices_count_the_same(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "id long, split string, y int, text string")
    want = sorted(map(tuple, FE.vocabulary(df, max_features=8).collect()))
    monkeypatch.setattr(FE, "_TOKENS", 2)
    assert sorted(map(tuple, FE.vocabulary(df, max_features=8).collect())) == want
