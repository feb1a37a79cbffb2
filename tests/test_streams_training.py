"""Drift per event-time window over several triggers, sinks written twice, training epochs."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import drift as D
from ticketlens.operators import evaluate as V
from ticketlens.operators import runs as RU
from ticketlens.operators import training as TR
from ticketlens.session import scratch_path
from ticketlens.streaming import streams as ST

T0 = datetime(2024, 3, 1)
SCHEMA = "ts timestamp_ntz, minutes long, kind string"


def rows(day, n, shift=0):
    return [(T0 + timedelta(days=day, minutes=7 * i), (i * 13) % 40 + shift, "ab"[i % 2] if not shift else "a") for i in range(n)]


def test_windows_over_part_files_equal_the_batch_per_window(spark):
    path = scratch_path(spark, "k3-parts")
    parts = [rows(0, 30) + rows(1, 20), rows(1, 25, 50) + rows(2, 40, 5), rows(3, 35) + rows(2, 3, 90),
             rows(9, 4) + [(T0 + timedelta(hours=1), 999, "late")] , [(T0 + timedelta(hours=2), 999, "late")] + rows(9, 5)]
    for i, part in enumerate(parts):  # a file a trigger, in this order
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")
    import glob
    import os
    import shutil
    flat = scratch_path(spark, "k3-flat")
    os.makedirs(flat)
    for i in range(len(parts)):
        for f in glob.glob(f"{path}/f{i}/part-*.parquet"):
            shutil.copy(f, f"{flat}/p{i}.parquet")
            os.utime(f"{flat}/p{i}.parquet", (1_700_000_000 + i * 10,) * 2)
    ref = spark.createDataFrame(rows(0, 200), SCHEMA)
    out, ckpt = ST.stream_paths(spark, "k3-test")
    src = ST.with_event_time(ST.file_stream(spark, flat, SCHEMA, max_files_per_trigger=1))
    ST.drift_per_window(src, ref, "event_time", "1 day", "1 day", ["minutes"], out, ckpt, ["kind"])
    got = spark.read.schema(ST.WINDOW_VERDICTS + ", batch_id int").parquet(out).collect()
    # the last part's late row comes when its window is closed; day 9 is still open
    days = {d: [r for p in parts[:4] for r in p if r[0].date() == (T0 + timedelta(days=d)).date()] for d in range(4)}
    assert len(got) == 8 and len({r.batch_id for r in got}) >= 2
    for d, mine in days.items():
        kept = [r for r in mine if r[2] != "late"]
        want = {r.feature: r for r in D.drift_verdicts(ref, spark.createDataFrame(kept, SCHEMA), ["minutes"], ["kind"]).collect()}
        for r in got:
            if r.window_start == T0 + timedelta(days=d):
                w = want[r.feature]
                assert (r.method, r.score, r.drift_detected, r.status) == (w.method, w.score, w.drift_detected, w.status)
    assert {r.drift_detected for r in got} == {True, False}


def test_records_of_a_retried_job_stay_once(spark):
    path = scratch_path(spark, "runs")
    m = spark.createDataFrame([("f1", 0.5, 1), ("f1", 0.6, 2)], "key string, value double, step int")
    for _ in range(2):
        RU.record_run(spark, "r1", {"C": 1.0}, m, path)
    RU.record_run(spark, "r2", {"C": 2.0}, None, path)
    got = sorted((r.run_id, r.kind, r.key, r.value, r.step) for r in RU.read_runs(spark, path).collect() if r.step is not None)
    assert got == [("r1", "metric", "f1", 0.5, 1), ("r1", "metric", "f1", 0.6, 2)]
    assert RU.read_runs(spark, path).count() == 4
    sink = scratch_path(spark, "metrics")
    long = spark.createDataFrame([("m1", "acc", 0.5), ("m2", "acc", 0.7)], "model string, metric string, value double")
    for _ in range(2):
        RU.write_metrics(long, sink, run=1)
    assert spark.read.parquet(sink).count() == 2
    RU.write_metrics(long.where("model = 'm1'").withColumn("value", F.lit(0.9)), sink, run=2)
    assert {r.model: r.value for r in RU.read_metrics(spark, sink).collect()} == {"m1": 0.9, "m2": 0.7}


def test_epochs_equal_plain_gradient_descent(spark):
    rng = np.random.default_rng(4)
    x, y = rng.random((30, 6)) * (rng.random((30, 6)) < 0.6), rng.integers(0, 3, 30)
    weights = spark.createDataFrame([(i, f"t{t}", float(x[i, t])) for i in range(30) for t in range(6) if x[i, t]],
                                    "id long, term string, weight double")
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, y int")
    w = np.zeros((6, 3))
    for epoch, coef in TR.epochs(weights, labels, "id", "y", 3, 3, 2.0):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 2.0 / 30 * x.T @ (p - np.eye(3)[y])
        got = {r.term: r.coef for r in coef.collect()}
        assert np.allclose([got[f"t{t}"] for t in range(6)], w, atol=1e-12) and epoch <= 3
    s = {r.id: r.scores for r in TR.class_scores(weights, coef, labels, "id", 3).collect()}
    assert np.allclose([s[i] for i in range(30)], x @ w, atol=1e-9)


def test_median_of_ties_and_nulls(spark):
    values = [(1, 1, v) for v in [0.5] * 50 + [0.1, 0.2, 0.9]] + [(1, 2, v) for v in (0.1, 0.4, None, 0.2, 0.3)] + [(None, 2, 0.7)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "tid long, t int, p int, c double")
    got = {r.correct: (r.n, r.median_confidence) for r in V.confidence_by_correctness(df, "t", "p", "c").collect()}
    assert got == {True: (53, 0.5), False: (5, pytest.approx(0.25)), None: (1, 0.7)}
