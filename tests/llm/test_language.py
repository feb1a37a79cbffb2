import numpy as np
from pyspark.sql import functions as F

from ticketlens.llm import language
from ticketlens.llm.common import crc_mod


def test_codewords_differ_in_many_bits():
    for k in (2, 3, 4, 7, 12, 30):
        code = language.codewords(k)
        d = (code[:, None] != code[None]).sum(axis=2)
        np.fill_diagonal(d, 99)
        assert d.min() >= (1 if k == 2 else 2) and (np.abs(code.sum(axis=0)) < k).all()


def test_a_wrong_bit_is_corrected():
    code = language.codewords(4)
    model = {"code": code, "bits": np.full(7, 1 / 7)}
    for c in range(4):
        for b in range(7):
            margins = code[c].copy()
            margins[b] *= -1
            assert language.decode(model, margins)[0] == c


def test_held_out_accuracy(spark, sf_small):
    docs = spark.read.parquet(sf_small.replace("0.001", "0.01") + "/documents.parquet")
    fold = crc_mod(F.col("doc_id"), 3)
    model = language.fit(docs, fold != 1)
    got = language.identify(docs, model, keep=["doc_id", "lang"]).where(fold == 1).collect()
    assert len(got) > 250 and sum(r.lang == r.lang_pred for r in got) / len(got) > .97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(docs_of):
    df = docs_of([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"),
                  (4, "", "de"), (5, "12 34 !!", "en"), (None, "the dog", None), (6, "und der " * 200000, None),
                  (7, "THE DOG and the cat", None)]).withColumn("score", F.lit(3)).withColumn("lang_pred", F.lit("q"))
    model = language.fit(df, F.lit(True))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert {k: r.lang_pred for k, r in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und",
                                                        None: "en", 6: "de", 7: "en"}
    assert got[3].score == 0 and got[6].n_chars == len("und der " * 200000)
    one = language.fit(df.where("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in language.identify(df, one).collect()} == {"en", "und"}
    none = language.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}
    assert language.identify(df.limit(0), model).collect() == []
