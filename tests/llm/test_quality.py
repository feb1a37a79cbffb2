import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import quality
from ticketlens.llm.common import crc_mod


def test_context_tables_equal_a_plain_count(spark, docs_of):
    texts = ["a b c a", None, "", "c, b! c " * 40, "x"]
    got = quality.word_vectors(docs_of(texts))
    at, sign = quality.index_vectors()
    want, ids = np.zeros((quality.BUCKETS, quality.DIM)), quality._Ids()
    for t in texts:
        b = quality.bucket_ids(t, ids)
        for i in range(len(b)):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    np.add.at(want[b[i]], at[b[j]], sign[b[j]])
    assert np.abs(got - want).max() < 1e-3


def test_held_out_accuracy(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = crc_mod(F.col("doc_id"), 4)
    model = quality.fit(docs, labels, fold != 2)
    got = quality.score(docs, model, keep=["doc_id"]).where(fold == 2).join(labels, "doc_id").collect()
    right = {q: [r.predicted == q for r in got if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) / len(right[1]) > .95 and sum(right[0]) / len(right[0]) > .6
    p = np.array([r.score for r in got])
    y = np.array([r.quality for r in got])
    assert abs(p.mean() - y.mean()) < .08 and .5 <= model["temperature"] <= 20


def test_edge_cases(spark, docs_of):
    rows = [(i, "good plain text here " * (i % 5 + 1)) for i in range(60)]
    rows += [(100 + i, "bad$$$ junk$$$ here$$$ " * (i % 5 + 1)) for i in range(60)]
    rows += [(300, None), (301, ""), (None, "good plain text here"), (302, "good text " * 100000), (300, None)]
    docs = docs_of(rows).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, None) for i in range(60)]
                                   + [(5, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= .7) for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 60} == {1}
    assert {r.predicted for r in got if r.doc_id is not None and 100 <= r.doc_id < 160} == {0}
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels, F.lit(True))).collect() == []
