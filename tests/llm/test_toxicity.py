from pyspark.sql import functions as F

from ticketlens.llm import toxicity as tox
from ticketlens.llm.common import crc_mod


def test_folding():
    assert tox.fold("An 1diot, a l0ser!") == " an idiot a loser "
    assert tox.fold("іdіоt ｓｃｕｍ st​upid") == " idiot scum stupid "
    assert tox.fold("cl0wn$$$ &&& tr@sh*** 1984") == " clown trash 1984 "
    assert tox.fold(None) == tox.fold("") == tox.fold(" \n") == "  "


def test_matcher_takes_the_heaviest_entry_per_word_and_spares_exceptions():
    m = tox.Matcher({" idiot ": 2.0, " idio": 1.0, " trash ": 3.0}, ["trash can"])
    assert m.hits(tox.fold("idiot idiots classidiot trash")) == {0: 2.0, 6: 1.0, 24: 3.0}
    assert m.hits(tox.fold("a trash can, idiot idiot")) == {12: 2.0, 18: 2.0}
    assert tox.Matcher({}, ["x"]).hits(" a ") == {}


def plain_hits(flat, entries):
    out, at = {}, 0
    for w in flat.split():
        at = flat.index(f" {w} ", at)
        best = max([v for e, v in entries.items() if f" {w} ".startswith(e) and (e[-1] != " " or e == f" {w} ")],
                   default=0)
        if best:
            out[at] = best
        at += 1
    return out


def test_automaton_equals_a_plain_scan(small_docs):
    entries = {" the ": 1.0, " th": .5, " and ": 2.0, " an": .25, " einer": 3.0}
    m = tox.Matcher(entries, [])
    for r in small_docs.limit(60).collect():
        flat = tox.fold(r.text)
        assert m.hits(flat) == plain_hits(flat, entries)


def test_held_out_accuracy(spark, sf_small):
    sf = sf_small.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 5)
    model = tox.fit(docs, labels, held != 0)
    marked = docs.join(labels.where(held == 0).select("doc_id", "toxic"), "doc_id")
    got = tox.score(marked, model, keep=["doc_id", "toxic"]).collect()
    right = {q: [r.predicted == q for r in got if r.toxic == q] for q in (0, 1)}
    assert sum(right[0]) / len(right[0]) > .98 and sum(right[1]) / len(right[1]) > .85


def test_learned_exceptions_and_edge_cases(spark, docs_of):
    rows = [(i, f"plain words number {chr(97 + i % 26)} in the trash can today " + "more of it " * (i % 4))
            for i in range(90)]
    rows += [(100 + i, f"you are scum {chr(97 + i % 26)} and trash " + "more of it " * (i % 4)) for i in range(90)]
    rows += [(300, None), (301, ""), (None, "you are scum"), (302, "calm words " * 100000 + "scum"), (300, None),
             (303, "what 5cum"), (304, "into the trash can")]
    docs = docs_of(rows).withColumn("score", F.lit("clash")).withColumn("n_hits", F.lit(0))
    labels = spark.createDataFrame([(i, 0) for i in range(90)] + [(100 + i, 1) for i in range(90)]
                                   + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = tox.fit(docs, labels, F.lit(True), exceptions=["Scum line"])
    assert " scum " in model["entries"] and "scum line" in model["exceptions"]
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    assert len(got) == 186 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == 0 and got[100 + i].predicted == 1 for i in range(90))
    assert got[303].predicted == 1 and got[None].predicted == 1 and got[302].n_hits >= 1
    assert got[300].predicted == got[301].predicted == got[304].predicted == 0
    none = tox.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in tox.score(docs, none).collect()} == {0.0}
    assert tox.score(docs.limit(0), model).collect() == []
