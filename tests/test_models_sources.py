"""Classifier optimality, relational scoring parity, persistence, user-model
scoring, file sources/sinks, the batch job and stream = batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.operators import features as FE
from ticketlens.operators import models as M
from ticketlens.operators import runs as RU
from ticketlens.operators import scoring as S
from ticketlens.plans import fixtures as FX
from ticketlens.session import scratch_path, stored
from ticketlens.sources import files as SF
from ticketlens.sources.tables import require_columns


@pytest.fixture(scope="module")
def fitted(spark, sf_small):
    st = FX.split_tickets(spark, sf_small)
    weights, vocab, _ = FE.fit_transform_tfidf(st, "ticket_id", F.col("split") == "train", max_features=500)
    weights, vocab = stored(weights, "weights"), stored(vocab, "vocab")
    vec = M.feature_vectors(weights, vocab, "ticket_id", 500, ids=st)
    data = vec.join(st.select("ticket_id", "split", "category_id"), "ticket_id")
    data = stored(data, "data")
    train = data.filter(F.col("split") == "train")
    model = M.fit_head(train, "category_id", max_iter=500, prefix="cat_")
    return st, weights, vocab, data, train, model


def test_lr_is_stationary_for_c_form(fitted):
    """Gradient of C * sum_i w_i * CE_i + 0.5 * ||W||^2 at Spark's solution ~ 0."""
    _, _, _, _, train, model = fitted
    wt = M.with_balanced_weights(train, "category_id", "_cw").collect()
    X = np.array([r.features.toArray() for r in wt])
    y = np.array([r.category_id for r in wt])
    w = np.array([r._cw for r in wt])
    W = model.coefficientMatrix.toArray()
    b = model.interceptVector.toArray()
    classes = W.shape[0]
    Z = X @ W.T + b
    P = np.exp(Z - Z.max(axis=1, keepdims=True))
    P /= P.sum(axis=1, keepdims=True)
    Y = np.eye(classes)[y]
    G = ((P - Y) * w[:, None]).T @ X + W
    scale = np.abs(((P - Y) * w[:, None]).T @ X).max()
    assert np.abs(G).max() < 1e-3 * max(scale, 1.0)


def test_relational_scoring_matches_model(spark, fitted):
    st, weights, vocab, data, _, model = fitted
    coef, bias = M.coefficient_table(model, vocab)
    sc = FE.linear_scores(weights, coef, "ticket_id", len(K.CATEGORIES), bias=bias, ids=st)
    from ticketlens.functions import arrays as A
    rel = sc.select("ticket_id", A.argmax("scores").alias("r"))
    ml = model.transform(data).select("ticket_id", F.col("cat_prediction").cast("int").alias("m"))
    j = rel.join(ml, "ticket_id")
    assert j.count() == st.count()
    assert j.filter(F.col("r") != F.col("m")).count() == 0


def test_model_round_trip(spark, fitted):
    _, _, _, data, _, model = fitted
    path = scratch_path(spark, "models")
    M.save_models({"category": model}, path)
    again = M.load_model(f"{path}/category")
    a = model.transform(data).select("ticket_id", "cat_prediction")
    b = again.transform(data).select("ticket_id", "cat_prediction")
    assert a.exceptAll(b).count() == 0


def test_user_model_scoring(spark, sf_small):
    t = FX.tickets(spark, sf_small)
    out = S.decode_logits(M.score_with_model(t, M.HashedLinearModel))
    assert out.count() == t.count()
    assert out.filter(F.col("category").isNull()).count() == 0


def test_csv_round_trip_and_batch_job(spark, sf_small):
    base = scratch_path(spark, "csv")
    t = FX.tickets(spark, sf_small).select("ticket_id", "text")
    SF.write_csv(t, f"{base}/in")
    back = SF.read_csv(spark, f"{base}/in", schema="ticket_id long, text string")
    assert back.exceptAll(t).count() == 0 and t.exceptAll(back).count() == 0

    def score(df):
        from ticketlens.operators import labels as L
        p = FX.with_predictions(FX.tickets(spark, sf_small)).select("ticket_id", "category", "priority",
                                                                    "category_confidence")
        return L.route_team(df.join(p, "ticket_id"))
    n = S.run_batch_job(spark, f"{base}/in", f"{base}/out", score, schema="ticket_id long, text string")
    assert n == t.count()
    out = SF.read_csv(spark, f"{base}/out")
    assert out.columns == ["ticket_id", "text", "category", "priority", "confidence", "routing_team"]
    with pytest.raises(ValueError):
        require_columns(back.select("ticket_id"), ["text"])


def test_label_mappings_round_trip(spark):
    path = scratch_path(spark, "maps")
    SF.write_mappings(SF.label_mappings(spark), path)
    m = SF.mapping_as_maps(SF.read_mappings(spark, path)).first()
    assert len(m.category_to_id) == 10 and len(m.id_to_priority) == 4
    assert m.id_to_category["0"] == "Account Access" and m.priority_to_id["P3-Low"] == 3


def test_metrics_sink(spark):
    path = scratch_path(spark, "metrics")
    one = spark.createDataFrame([(0.9, 0.8)], "cat_accuracy double, cat_f1 double")
    RU.write_metrics(RU.metrics_long(one, "m1", ["cat_accuracy", "cat_f1"]), path)
    RU.write_metrics(RU.metrics_long(one, "m2", ["cat_accuracy", "cat_f1"]), path)
    wide = RU.comparison_table(RU.read_metrics(spark, path), ["cat_accuracy", "cat_f1"])
    assert wide.count() == 2
    assert RU.best_model(wide, "cat_f1").first().model == "m1"


def test_stream_equals_batch(spark, sf_small):
    import __spark_entry__ as E
    s = E.queries()["k1_stream_scoring"](spark, sf_small)
    b = E.queries()["i10_decode_logits"](spark, sf_small).select(*s.columns)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
    ws = E.queries()["k2_window_counts_stream"](spark, sf_small).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "priority", "n")
    wb = E.queries()["k2_window_counts"](spark, sf_small).select("window_start", "priority", "n")
    # append mode: all windows but those that the watermark (one day) still holds open
    assert ws.exceptAll(wb).count() == 0 and ws.count() > 0
    assert wb.exceptAll(ws).select("window_start").distinct().count() <= 2


def test_partitioned_split_write_and_drift_sink(spark, sf_small):
    import __spark_entry__ as E
    base = scratch_path(spark, "sinks")
    st = FX.split_tickets(spark, sf_small).select("ticket_id", "category", "split")
    SF.write_csv(st, f"{base}/splits", partition_by="split")
    back = SF.read_csv(spark, f"{base}/splits", schema="ticket_id long, category string, split string",
                       csv_only=False)
    assert back.count() == st.count()
    assert {r.split for r in back.select("split").distinct().collect()} == {"train", "val", "test"}
    v = E.queries()["j6_drift_verdicts"](spark, sf_small)
    SF.write_table(v, f"{base}/drift", partition_by="scenario")
    assert spark.read.parquet(f"{base}/drift").count() == v.count()


def test_length_stats_approx_close_to_exact(spark):
    from ticketlens.operators.profile import length_stats
    df = spark.range(10001).select((F.col("id") % 997).alias("x"))
    exact = length_stats(df, "x").first()
    approx = length_stats(df, "x", approx=True).first()
    assert exact.mean == approx.mean and abs(exact.median - approx.median) <= 2


def test_append_mode_windows_are_closed_batch_windows(spark, sf_small):
    from ticketlens.plans.q_scoring import event_tickets
    from ticketlens.streaming import streams as ST
    import __spark_entry__ as E
    out, ckpt = ST.stream_paths(spark, "k2-append")
    src = ST.file_stream(spark, f"{sf_small}/events.parquet", ST.EVENTS_SCHEMA)
    t = ST.with_event_time(event_tickets(spark, sf_small, source=src), "opened_at", "event_time")
    ST.write_closed_windows(ST.windowed_counts(t, "event_time", "1 day", ["priority"], "1 day"), out, ckpt)
    got = spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                                          "priority", "n")
    batch = E.queries()["k2_window_counts"](spark, sf_small).select("window_start", "priority", "n")
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0  # every emitted (closed) window equals the batch count


def test_streams_read_folders_of_part_files(spark, sf_small):
    """Several part files and micro-batches give what the batch gives."""
    from ticketlens.operators import scoring as SC
    from ticketlens.streaming import streams as ST
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    path = scratch_path(spark, "parts")
    emb.repartition(5).write.parquet(path)
    out, ckpt = ST.stream_paths(spark, "parts-stream")
    ST.score_stream(ST.file_stream(spark, path, ST.EMBEDDINGS_SCHEMA, max_files_per_trigger=1), out, ckpt)
    cols = ["ticket_id", "category", "priority", "routing_team"]
    want = SC.decode_logits(SC.logits_from_embeddings(emb)).select(*cols)
    got = spark.read.parquet(out).select(*cols)
    assert got.count() == want.count() == 500 and got.exceptAll(want).isEmpty()


def test_drift_per_batch_over_part_files(spark, sf_small):
    from ticketlens.operators import drift as D
    from ticketlens.streaming import streams as ST
    rows = spark.range(400).selectExpr("id", "cast(id % 37 as double) v", "cast(id % 5 as double) w")
    path = scratch_path(spark, "drift-parts")
    rows.repartition(3).write.parquet(path)
    out, ckpt = ST.stream_paths(spark, "drift-stream")
    src = ST.file_stream(spark, path, "id long, v double, w double", max_files_per_trigger=1)
    ST.drift_per_batch(src, rows, ["v", "w"], out, ckpt)
    got = spark.read.parquet(out).collect()
    assert len(got) == 6 and {r.feature for r in got} == {"v", "w"}
    whole = D.drift_verdicts(rows, rows, ["v", "w"]).collect()
    assert all(r.score == 0 and not r.drift_detected for r in whole)


def test_text_params_in_run_records(spark):
    from ticketlens.operators import runs as RU
    got = {r.key: (r.value, r.text) for r in RU.record_run(spark, "r", {"solver": "lbfgs", "C": 1.5, "on": True}).collect()}
    assert got == {"solver": (None, "lbfgs"), "C": (1.5, "1.5"), "on": (None, "True")}
