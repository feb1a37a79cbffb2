"""Properties of the split, ranks, weights, evaluation and drift operators."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketlens.operators import drift as D
from ticketlens.operators import evaluate as V
from ticketlens.operators import runs as RU
from ticketlens.operators import split as S
from ticketlens.operators import joins as J
from ticketlens.operators.features import encode_sequences, word_vocabulary
from ticketlens.operators.ordering import ranked


def test_exact_group_rank_matches_row_number(spark):
    df = spark.range(3000).select(F.col("id").alias("tid"), (F.col("id") % 7).alias("g"))
    ranked = S.exact_group_rank(df, ["g"], "tid", bucket_digits=2)
    w = Window.partitionBy("g").orderBy(S.seeded_key("tid"), "tid")
    brute = df.withColumn("rn", F.row_number().over(w))
    j = ranked.join(brute, ["tid", "g"])
    assert j.filter(F.col("_rank") != F.col("rn")).count() == 0
    assert j.count() == 3000


def test_stratified_split_properties(spark):
    df = spark.range(2001).select(F.col("id").alias("tid"), (F.col("id") % 5).alias("cls"))
    out = S.stratified_split(df, "cls", "tid")
    assert out.count() == 2001 and out.select("tid").distinct().count() == 2001
    per = out.groupBy("cls").pivot("split", ["train", "val", "test"]).count().collect()
    for r in per:
        n = r.train + r.val + r.test
        assert abs(r.train - 0.8 * n) <= 1 and abs(r.val - 0.1 * n) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    w = {r.y: r.weight for r in S.inverse_frequency_weights(df, "y", 3).collect()}
    assert w == pytest.approx({0: 3 / 7, 1: 9 / 7, 2: 9 / 7})
    b = {r.y: r.weight for r in S.balanced_class_weights(df, "y").collect()}
    assert b == pytest.approx({0: 4 / 6, 1: 2.0})


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(1, 1, 0.95), (1, 2, 0.85), (1, 1, 0.55)], "t int, p int, c double")
    out = {r.threshold: r for r in V.threshold_sweep(df, "t", "p", "c", [0.85, 0.95, 0.99]).collect()}
    assert (out[0.85].auto_n, out[0.85].review_n, out[0.85].auto_accuracy) == (2, 1, 0.5)
    assert (out[0.95].auto_n, out[0.95].review_n, out[0.95].auto_accuracy) == (1, 2, 1.0)
    assert out[0.99].auto_accuracy == 0.0


def test_confusion_total_and_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    assert sum(r.n for r in V.confusion_long(df, "t", "p").collect()) == 4
    m = {r.class_id: r for r in V.per_class_metrics(df, "t", "p").collect()}
    assert m[2].precision == 0.0 and m[2].f1 == 0.0
    assert m[1].precision == pytest.approx(1 / 3, abs=1e-6) and m[1].recall == 1.0


def test_early_stopping(spark):
    h = spark.createDataFrame([("r", e + 1, v) for e, v in enumerate([0.50, 0.60, 0.60, 0.55, 0.58, 0.70])],
                              "run_id string, epoch int, val_f1 double")
    r = RU.early_stopping(h).first()
    assert (r.best_epoch, r.stop_epoch, r.last_epoch_seen) == (2, 5, 5)


def test_drift_self_is_zero(spark):
    df = spark.range(50).select((F.col("id") % 9).alias("x"))
    r = D.numeric_drift(df, df, ["x"]).first()
    assert r.ks_stat == 0.0 and r.wasserstein_norm == 0.0 and not r.drift_detected
    c = spark.range(50).select((F.col("id") % 3).cast("string").alias("c"))
    assert D.categorical_drift(c, c, ["c"]).first().js_distance == 0.0


def test_drift_known_values(spark):
    ref = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "x int")
    cur = spark.createDataFrame([(v,) for v in (2, 3, 4, 5)], "x int")
    r = D.numeric_drift(ref, cur, ["x"]).first()
    assert r.ks_stat == 0.25
    import math
    assert r.wasserstein_norm == pytest.approx(1.0 / math.sqrt(1.25), abs=1e-6)


def test_vocab_and_sequences(spark):
    train = spark.createDataFrame([(1, "a a b"), (2, "b c")], "tid long, text string")
    v = word_vocabulary(train)
    assert {r.word: r.word_id for r in v.collect()} == {"a": 2, "b": 3}
    q = spark.createDataFrame([(9, "b c a"), (8, "a a a a a a")], "tid long, text string")
    seq = {r.tid: r.sequence for r in encode_sequences(q, v, "tid", max_len=5).collect()}
    assert seq[9] == [3, 1, 2, 0, 0] and seq[8] == [2, 2, 2, 2, 2]


def test_ranked_matches_global_sort(spark):
    df = spark.range(3000).select(F.concat(F.lit("w"), (F.col("id") * 7919 % 5000).cast("string")).alias("word"),
                                  F.when(F.col("id") % 3 > 0, 2).otherwise(F.col("id") % 13).alias("n"))
    for rows in (df, df.withColumn("n", F.lit(2)), df.limit(0)):  # also one count that all words share
        r = ranked(rows, [F.desc("n"), F.asc("word")])
        brute = rows.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "word")))
        j = r.join(brute, ["word", "n"])
        assert j.count() == rows.count() and j.filter(F.col("rank") != F.col("rn")).count() == 0
        assert "Window" not in r._jdf.queryExecution().executedPlan().toString()


def test_word_ids_by_shuffle_equal_those_by_broadcast(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "word string, word_id int")
    q = spark.createDataFrame([(i, "a x a b") for i in range(50)] + [(50, None)], "tid long, text string")
    want = sorted(map(str, encode_sequences(q, vocab, "tid", max_len=5).collect()))
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    assert sorted(map(str, encode_sequences(q, vocab, "tid", max_len=5).collect())) == want


def test_running_counts_over_ranges(spark):
    rows = [("a", float(v ** 4), v % 3, v % 5) for v in range(300)] + [("b", 1.0, 2, 3), ("c", -1.0, 0, 1), ("c", 5.0, 1, 0)]
    df = spark.createDataFrame(rows, "feature string, value double, n_ref long, n_cur long")
    got = {(r.feature, r.value): (r.cum_ref, r.cum_cur, r.next_value) for r in D.running_cdf(df).collect()}
    want = {}
    for f in "abc":
        mine = sorted(r for r in rows if r[0] == f)
        for i, r in enumerate(mine):
            want[f, r[1]] = (sum(x[2] for x in mine[:i + 1]), sum(x[3] for x in mine[:i + 1]),
                             mine[i + 1][1] if i + 1 < len(mine) else None)
    assert got == want


def test_chi_square_tail_known_values(spark):
    from ticketlens.functions import special as SP
    import math
    known = [(3.841458820694124, 1, 0.05), (7.814727903251179, 3, 0.05), (0.5, 2, math.exp(-0.25)), (100.0, 50, 3.1e-5),
             (0.0, 4, 1.0), (18.307038053275146, 10, 0.05), (1.0, 1, 0.31731050786291415), (40.0, 4, 21 * math.exp(-20)),
             (5.0, 0, 1.0), (123.225221, 100, 0.0573), (1106.969, 999, None), (3.0, 1002, None)]
    df = spark.createDataFrame([(float(x), float(k), p) for x, k, p in known], "x double, k double, p double")
    for r in df.select("x", "k", "p", SP.chi2_tail(F.col("x"), F.col("k")).alias("q")).collect():
        if r.k > 1000:
            assert r.q is None
        elif r.k % 2 == 0 and r.k:  # a closed form for even degrees of freedom
            half = r.x / 2
            assert r.q == pytest.approx(sum(math.exp(-half + i * math.log(half or 1) - math.lgamma(i + 1)) for i in range(int(r.k // 2)))
                                        if r.x else 1.0, abs=1e-9)
        elif r.p is not None:
            assert r.q == pytest.approx(r.p, abs=1e-6)
        else:
            assert 0.008 < r.q < 0.011


def test_chi_square_verdicts_and_dispatch(spark):
    ref = spark.range(400).select((F.col("id") % 4).cast("int").alias("few"), (F.col("id") % 50).cast("int").alias("many"))
    cur = spark.range(400).select((F.col("id") % 4 % 3).cast("int").alias("few"), (F.col("id") % 50).cast("int").alias("many"))
    c = D.categorical_drift(ref, cur, ["few", "many"], "chisquare").collect()
    by = {r.feature: r for r in c}
    assert by["few"].drift_detected and by["few"].chi2_stat == 200.0 and by["few"].chi2_pvalue == 0.0
    assert not by["many"].drift_detected and by["many"].chi2_pvalue == 1.0
    new = D.categorical_drift(ref, cur.select((F.col("few") + 2).alias("few"), "many"), ["few"], "chisquare").first()
    assert new.chi2_pvalue == 0.0 and new.drift_detected
    for small, names in ((False, ("jensenshannon", "wasserstein")), (True, ("chisquare", "ks"))):
        d = {r.feature: (r.n_values, r.method) for r in D.dispatched_drift(ref, cur, ["few", "many"], small).collect()}
        assert d == {"few": (4, names[0]), "many": (50, names[1])}


def test_mark_duplicates_digest_equals_plain_key(spark):
    from ticketlens.operators.profile import mark_duplicates
    rows = [(i, t) for i, t in enumerate(["a", "b", "a", None, "c", None, "a", "b"])]
    df = spark.createDataFrame(rows, "tid long, text string")
    a = {r.tid: r.is_duplicate for r in mark_duplicates(df, "text", "tid").collect()}
    b = {r.tid: r.is_duplicate for r in mark_duplicates(df, "text", "tid", digest=False).collect()}
    assert a == b == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_hash_split_proportions(spark):
    df = spark.range(20000).select(F.col("id").alias("tid"))
    c = {r.split: r["count"] for r in S.hash_split(df, "tid").groupBy("split").count().collect()}
    assert abs(c["train"] / 20000 - 0.8) < 0.02 and abs(c["test"] / 20000 - 0.1) < 0.02


def test_exact_ks_counts_all_orders(spark):
    from itertools import combinations
    for n, m in ((1, 1), (3, 5), (6, 4), (7, 7), (9, 2)):
        stats = []
        for ref in combinations(range(n + m), n):
            ref, i, j, worst = set(ref), 0, 0, 0
            for x in range(n + m):
                i, j = i + (x in ref), j + (x not in ref)
                worst = max(worst, abs(i * m - j * n))
            stats.append(worst)
        for steps in range(0, n * m + 1):
            assert D.ks_exact(steps, n, m) == pytest.approx(sum(s >= steps for s in stats) / len(stats), abs=1e-12)
    assert abs(D.ks_exact(400, 100, 100) - 0.9999) < 0.01 and D.ks_exact(3000, 100, 100) == pytest.approx(0.000239, abs=2e-5)
    ref = spark.createDataFrame([(float(v),) for v in range(6)], "x double")
    cur = spark.createDataFrame([(v + 3.5,) for v in range(4)], "x double")
    r = D.numeric_drift(ref, cur, ["x"], "ks_exact").first()
    assert r.method == "ks_exact" and r.score == pytest.approx(D.ks_exact(round(r.ks_stat * 24), 6, 4), abs=1e-6)
