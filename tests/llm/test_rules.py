import random
import re

from pyspark.sql import functions as F

from ticketlens.llm import rules


def plain(text):
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    seen, covered = {}, set()
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    n, rep = len(ws), len(covered)
    return (n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep,
            n < 10 or 100 * rep > 20 * n)


def test_counts_match_brute_force(docs_of, small_docs):
    r = random.Random(4)
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    odd = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 30, "ä ö\xa0ü €\U0001f600 #*$%&|<>", "a\r\na\r\nb",
           "one\n\none\n \none", "w " * 60000]
    odd += [" ".join(r.choice("abc") + r.choice(" \n ") for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts |= {10_000 + i: t for i, t in enumerate(odd)}
    df = docs_of(list(texts.items())).withColumn("n_words", F.lit("clash")).withColumn("rule", F.lit(1))
    got = rules.apply(df, [], keep=["doc_id", "n_words", "lang"]).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain(
            texts[x.doc_id]), texts[x.doc_id]
        assert x.kept == (not x.base_failed) and x.rule is None
    assert rules.measure(df.limit(0)).collect() == []


def test_learned_list(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learned = rules.learn(docs, labels)
    assert learned and all(m in rules.MEASURES and op in ("<=", ">") for rule in learned for m, op, _ in rule)
    got = rules.apply(docs, learned, keep=["doc_id"]).join(labels, "doc_id").where("not base_failed").collect()
    right = {q: [r.kept == bool(q) for r in got if r.quality == q] for q in (0, 1)}
    assert sum(right[1]) / len(right[1]) > .98 and sum(right[0]) / len(right[0]) > .8


def test_rules_apply_in_order(docs_of):
    d = docs_of(["a b c d e f g h i j k # #", "A B c d e f g h i j k", "a b c d e f g h i j k"])
    listed = [[("symbol_share", ">", .1)], [("upper_share", ">", .1), ("n_words", "<=", 20.0)]]
    got = {x.doc_id: (x.rule, x.kept) for x in rules.apply(d, listed, keep=["doc_id"]).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (None, True)}


def test_without_labels(spark, docs_of):
    labels = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert rules.learn(docs_of(["a b", None]), labels) == []
