"""Catalogue: evaluation of a scored ticket table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.operators import evaluate as V
from ticketlens.operators import labels as L
from ticketlens.operators.scoring import logits_from_embeddings
from ticketlens.functions import arrays as A
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.registry import query
from ticketlens.sources import tables as T

R = 6


def _metrics_sql(t: str = "category_id", p: str = "pred_category_id", src: str = "predictions",
                 prefix: str = "") -> str:
    conf, cm, metrics = f"{prefix}conf", f"{prefix}cm", f"{prefix}metrics"
    return f"""{conf} AS (SELECT {t} AS t, {p} AS p, count(*) AS n FROM {src} GROUP BY 1, 2),
{cm} AS (
  SELECT coalesce(s.c, q.c) AS class_id, coalesce(tp.n, 0) AS tp, coalesce(s.support, 0) AS support,
         coalesce(q.predicted, 0) AS predicted
  FROM (SELECT t AS c, sum(n) AS support FROM {conf} GROUP BY t) s
  FULL OUTER JOIN (SELECT p AS c, sum(n) AS predicted FROM {conf} GROUP BY p) q ON s.c = q.c
  LEFT JOIN (SELECT t AS c, n FROM {conf} WHERE t = p) tp ON tp.c = coalesce(s.c, q.c)),
{metrics} AS (
  SELECT class_id, tp, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN (2 * tp) / (support + predicted) ELSE 0.0 END AS f1
  FROM {cm})"""


def _id_name_sql(col: str, names) -> str:
    whens = " ".join(f"WHEN {col} = {i} THEN {O.q(n)}" for i, n in enumerate(names))
    return f"(CASE {whens} END)"


def _band_sql(col: str) -> str:
    whens = " ".join(f"WHEN {col} < {lim} THEN '{name}'" for lim, name in K.F1_BANDS)
    return f"CASE {whens} ELSE '{K.F1_BAND_TOP}' END"


def _hint_sql(t: str, p: str) -> str:
    whens = " ".join(f"WHEN {t} = {O.q(a)} AND {p} = {O.q(b)} THEN {O.q(w)}" for a, b, w in K.CONFUSION_HINTS)
    return f"CASE {whens} END"


def _preds(spark, sf_dir):
    return FX.predictions(spark, sf_dir)


def _named(spark, sf_dir):
    return FX.named_predictions(spark, sf_dir)


# DuckDB: argmax over a 1-based list slice, the same logits as the Spark side.
EMB_PRED = """emb_pred AS (
  SELECT vec_id AS ticket_id,
         CAST(list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) - 1 AS INTEGER)
           AS pred_category_id
  FROM embeddings)"""


def _emb_pred(spark, sf_dir):
    e = logits_from_embeddings(T.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return e.select("ticket_id", A.argmax("category_logits").alias("pred_category_id"))


@query("c7_align_predictions", O.with_tickets("""
SELECT t.ticket_id, t.category_id, e.pred_category_id FROM emb_pred e JOIN tickets t USING (ticket_id)""", EMB_PRED))
def c7_align_predictions(spark, sf_dir):
    truth = FX.tickets(spark, sf_dir).select("ticket_id", "category_id")
    return V.align(_emb_pred(spark, sf_dir), truth).select("ticket_id", "category_id", "pred_category_id")


@query("c8_prediction_parity", O.with_predictions(f"""
SELECT count(*) AS n_keys, count_if(a.pred_category_id IS NOT DISTINCT FROM b.pred_category_id) AS n_match,
       round(count_if(a.pred_category_id IS NOT DISTINCT FROM b.pred_category_id) * 100.0 / count(*), {R}) AS match_pct,
       round(avg(CAST(a.pred_category_id = a.category_id AS DOUBLE)), {R}) AS accuracy_a,
       round(avg(CAST(b.pred_category_id = a.category_id AS DOUBLE)), {R}) AS accuracy_b,
       round(avg(CAST(a.pred_category_id = a.category_id AS DOUBLE)) - avg(CAST(b.pred_category_id = a.category_id AS DOUBLE)), {R}) AS accuracy_diff
FROM predictions a FULL OUTER JOIN emb_pred b ON a.ticket_id = b.ticket_id""", EMB_PRED))
def c8_prediction_parity(spark, sf_dir):
    return V.prediction_parity(_preds(spark, sf_dir), _emb_pred(spark, sf_dir), "ticket_id",
                               "pred_category_id", truth="category_id")


@query("b10_misclassified", O.with_predictions(
    "SELECT ticket_id, category_id, pred_category_id FROM predictions WHERE category_id <> pred_category_id"))
def b10_misclassified(spark, sf_dir):
    return V.misclassified(_preds(spark, sf_dir), "category_id", "pred_category_id").select(
        "ticket_id", "category_id", "pred_category_id")


@query("d16_confusion_long", O.with_predictions(
    "SELECT category_id AS truth, pred_category_id AS pred, count(*) AS n FROM predictions GROUP BY 1, 2"))
def d16_confusion_long(spark, sf_dir):
    return V.confusion_long(_preds(spark, sf_dir), "category_id", "pred_category_id")


@query("d16_confusion_matrix", O.with_predictions(
    "SELECT category_id AS truth, "
    + ", ".join(f"count_if(pred_category_id = {c}) AS pred_{c}" for c in range(10))
    + " FROM predictions GROUP BY 1"))
def d16_confusion_matrix(spark, sf_dir):
    return V.confusion_matrix(_preds(spark, sf_dir), "category_id", "pred_category_id", len(K.CATEGORIES))


@query("d17_per_class_metrics", O.with_predictions(f"""
SELECT m.class_id, n.name AS category, CAST(support AS BIGINT) AS support, round(precision, {R}) AS precision,
       round(recall, {R}) AS recall, round(f1, {R}) AS f1, {_band_sql('f1')} AS f1_band
FROM metrics m LEFT JOIN cat_names n ON m.class_id = n.id""", _metrics_sql(), O.cat_names_cte()))
def d17_per_class_metrics(spark, sf_dir):
    m = V.per_class_metrics(_preds(spark, sf_dir), "category_id", "pred_category_id")
    return L.id_to_name(m, "class_id", "category", K.CATEGORIES)


@query("d18_report_averages", O.with_predictions(f"""
SELECT 'macro avg' AS row, round(avg(precision), {R}) AS precision, round(avg(recall), {R}) AS recall,
       round(avg(f1), {R}) AS f1, CAST(sum(support) AS BIGINT) AS support FROM metrics
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), {R}), round(sum(recall * support) / sum(support), {R}),
       round(sum(f1 * support) / sum(support), {R}), CAST(sum(support) AS BIGINT) FROM metrics""",
    _metrics_sql()))
def d18_report_averages(spark, sf_dir):
    return V.report_averages(V.class_metrics(_preds(spark, sf_dir), "category_id", "pred_category_id"))


@query("d19_overall_metrics", O.with_predictions(f"""
SELECT round(sum(tp) / sum(support), {R}) AS accuracy,
       round(sum(precision * support) / sum(support), {R}) AS weighted_precision,
       round(sum(recall * support) / sum(support), {R}) AS weighted_recall,
       round(sum(f1 * support) / sum(support), {R}) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n
FROM metrics""", _metrics_sql()))
def d19_overall_metrics(spark, sf_dir):
    return V.overall_metrics(_preds(spark, sf_dir), "category_id", "pred_category_id")


@query("d20_accuracy_by_split", O.with_predictions(f"""
SELECT split, round(avg(CAST(category_id = pred_category_id AS INTEGER)), {R}) AS accuracy, count(*) AS n
FROM split_p GROUP BY split""", O.split_cte("predictions", name="split_p")))
def d20_accuracy_by_split(spark, sf_dir):
    from ticketlens.operators.split import stratified_split
    p = stratified_split(_preds(spark, sf_dir), "category_id", "ticket_id")
    return V.accuracy_by(p, "category_id", "pred_category_id", "split")


NAMED = """named AS (
  SELECT p.*, n.name AS pred_category FROM predictions p LEFT JOIN cat_names n ON p.pred_category_id = n.id)"""


@query("d21_confusion_pairs", O.with_predictions(f"""
SELECT true_category, pred_category, n, {_hint_sql('true_category', 'pred_category')} AS hint FROM (
  SELECT category AS true_category, pred_category, count(*) AS n FROM named
  WHERE category <> pred_category GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10) x""",
    O.cat_names_cte(), NAMED))
def d21_confusion_pairs(spark, sf_dir):
    top = V.confusion_pairs(_named(spark, sf_dir), "category", "pred_category", 10)
    return top.withColumn("hint", V.explain_hint("true_category", "pred_category"))


@query("d22_confidence_by_correctness", O.with_predictions(f"""
SELECT correct, n, mean_confidence, median_confidence, round(n * 100.0 / sum(n) OVER (), {R}) AS pct FROM (
  SELECT category_id = pred_category_id AS correct, count(*) AS n,
         round(avg(category_confidence), {R}) AS mean_confidence,
         round(quantile_cont(category_confidence, 0.5), {R}) AS median_confidence
  FROM predictions GROUP BY 1) g"""))
def d22_confidence_by_correctness(spark, sf_dir):
    return V.confidence_by_correctness(_preds(spark, sf_dir), "category_id", "pred_category_id",
                                       "category_confidence")


_TH = ", ".join(f"({t})" for t in K.SWEEP_THRESHOLDS)


@query("d23_threshold_sweep", O.with_predictions(f"""
SELECT threshold, auto_n, round(auto_n * 100.0 / n, {R}) AS auto_pct, n - auto_n AS review_n,
       round((n - auto_n) * 100.0 / n, {R}) AS review_pct,
       round(CASE WHEN auto_n > 0 THEN auto_correct / auto_n ELSE 0.0 END, {R}) AS auto_accuracy
FROM (SELECT CAST(th.t AS DOUBLE) AS threshold,
             count_if(category_confidence >= th.t) AS auto_n,
             count_if(category_confidence >= th.t AND category_id = pred_category_id) AS auto_correct,
             count(*) AS n
      FROM predictions, (VALUES {_TH}) th(t) GROUP BY th.t) s"""))
def d23_threshold_sweep(spark, sf_dir):
    return V.threshold_sweep(_preds(spark, sf_dir), "category_id", "pred_category_id", "category_confidence")


@query("d25_misclassified_share", O.with_predictions(f"""
SELECT count_if(category_id <> pred_category_id) AS n_misclassified, count(*) AS n_rows,
       round(count_if(category_id <> pred_category_id) * 100.0 / count(*), {R}) AS misclassified_pct
FROM predictions"""))
def d25_misclassified_share(spark, sf_dir):
    from ticketlens.operators.profile import count_if_share
    return count_if_share(_preds(spark, sf_dir), F.col("category_id") != F.col("pred_category_id"),
                          "misclassified")


@query("d26_auto_route_share", O.with_predictions(f"""
SELECT round(avg(CAST(category_confidence >= {K.AUTO_ROUTE_THRESHOLD} AS DOUBLE)), {R}) AS auto_route_share
FROM predictions"""))
def d26_auto_route_share(spark, sf_dir):
    p = _preds(spark, sf_dir)
    return p.agg(F.round(F.avg((F.col("category_confidence") >= F.lit(K.AUTO_ROUTE_THRESHOLD))
                               .cast("double")), R).alias("auto_route_share"))


@query("f1_worst_best", O.with_predictions(f"""
SELECT first(name ORDER BY rf1, name) AS worst_class, min(rf1) AS worst_f1,
       first(name ORDER BY rf1 DESC, name) AS best_class, max(rf1) AS best_f1
FROM (SELECT n.name, round(m.f1, {R}) AS rf1 FROM metrics m JOIN cat_names n ON m.class_id = n.id) x""",
    _metrics_sql(), O.cat_names_cte()))
def f1_worst_best(spark, sf_dir):
    m = V.per_class_metrics(_preds(spark, sf_dir), "category_id", "pred_category_id")
    m = L.id_to_name(m, "class_id", "category", K.CATEGORIES)
    return V.worst_and_best(m, "category")


@query("d28_headline", O.with_predictions(f"""
SELECT w.worst_class, w.worst_f1, c.true_category AS top_true, c.pred_category AS top_pred, c.n AS top_pair_n,
       k.mean_correct, k.mean_wrong, a.auto_route_share
FROM (SELECT first(name ORDER BY rf1, name) AS worst_class, min(rf1) AS worst_f1
      FROM (SELECT n.name, round(m.f1, {R}) AS rf1 FROM metrics m JOIN cat_names n ON m.class_id = n.id) x) w,
     (SELECT category AS true_category, pred_category, count(*) AS n FROM named
      WHERE category <> pred_category GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1) c,
     (SELECT round(avg(category_confidence) FILTER (WHERE category_id = pred_category_id), {R}) AS mean_correct,
             round(avg(category_confidence) FILTER (WHERE category_id <> pred_category_id), {R}) AS mean_wrong
      FROM predictions) k,
     (SELECT round(avg(CAST(category_confidence >= {K.AUTO_ROUTE_THRESHOLD} AS DOUBLE)), {R}) AS auto_route_share
      FROM predictions) a""", _metrics_sql(), O.cat_names_cte(), NAMED))
def d28_headline(spark, sf_dir):
    """Worst class, top confusion pair, mean confidences, auto-route share (one row)."""
    p = _named(spark, sf_dir)
    m = L.id_to_name(V.per_class_metrics(p, "category_id", "pred_category_id"), "class_id",
                     "category", K.CATEGORIES)
    worst = V.worst_and_best(m, "category").select("worst_class", "worst_f1")
    pair = V.confusion_pairs(p, "category", "pred_category", 1).select(
        F.col("true_category").alias("top_true"), F.col("pred_category").alias("top_pred"),
        F.col("n").alias("top_pair_n"))
    ok = F.col("category_id") == F.col("pred_category_id")
    conf = p.agg(
        F.round(F.avg(F.when(ok, F.col("category_confidence"))), R).alias("mean_correct"),
        F.round(F.avg(F.when(~ok, F.col("category_confidence"))), R).alias("mean_wrong"),
        F.round(F.avg((F.col("category_confidence") >= F.lit(K.AUTO_ROUTE_THRESHOLD)).cast("double")), R)
        .alias("auto_route_share"))
    w = worst.select(F.struct("*")).scalar()
    c = conf.select(F.struct("*")).scalar()
    return pair.select(w["worst_class"].alias("worst_class"), w["worst_f1"].alias("worst_f1"), "*",
                       c["mean_correct"].alias("mean_correct"), c["mean_wrong"].alias("mean_wrong"),
                       c["auto_route_share"].alias("auto_route_share"))


@query("e4_confident_errors", O.with_predictions(f"""
SELECT row_number() OVER (ORDER BY category_confidence DESC, ticket_id) AS rank, ticket_id,
       category, pred_category, category_confidence,
       CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_preview,
       {_hint_sql('category', 'pred_category')} AS hint
FROM named WHERE category_id <> pred_category_id ORDER BY category_confidence DESC, ticket_id LIMIT 15""",
    O.cat_names_cte(), NAMED))
def e4_confident_errors(spark, sf_dir):
    out = V.most_confident_errors(_named(spark, sf_dir), "category_id", "pred_category_id",
                                  "category_confidence", "ticket_id", 15)
    return out.select(F.col("rank").cast("long"), "ticket_id", "category", "pred_category",
                      "category_confidence", "text_preview",
                      V.explain_hint("category", "pred_category").alias("hint"))


@query("i13_two_head_metrics", O.with_predictions(f"""
SELECT head, round(sum(tp) / sum(support), {R}) AS accuracy,
       round(sum(f1 * support) / sum(support), {R}) AS weighted_f1, round(avg(f1), {R}) AS macro_f1,
       CAST(sum(support) AS BIGINT) AS n
FROM (SELECT 'category' AS head, * FROM metrics UNION ALL SELECT 'priority', * FROM pmetrics) x GROUP BY head""",
    _metrics_sql(), _metrics_sql("priority_id", "pred_priority_id", prefix="p")))
def i13_two_head_metrics(spark, sf_dir):
    return V.two_head_metrics(_preds(spark, sf_dir), {
        "category": ("category_id", "pred_category_id"),
        "priority": ("priority_id", "pred_priority_id")})


@query("f5_first_misclassified", O.with_predictions("""
SELECT ticket_id, category_id, pred_category_id FROM predictions
WHERE category_id <> pred_category_id ORDER BY ticket_id LIMIT 10"""))
def f5_first_misclassified(spark, sf_dir):
    """the first n misclassified tickets in input (id) order."""
    w = V.misclassified(_preds(spark, sf_dir), "category_id", "pred_category_id")
    return w.orderBy("ticket_id").limit(10).select("ticket_id", "category_id", "pred_category_id")


@query("f6_preview_scored", O.with_predictions(f"""
SELECT ticket_id, category, {_id_name_sql('pred_priority_id', K.PRIORITIES)} AS priority,
       round(category_confidence, 4) AS confidence
FROM predictions ORDER BY ticket_id LIMIT 10"""))
def f6_preview_scored(spark, sf_dir):
    """first 10 scored rows in input order."""
    p = L.id_to_name(_preds(spark, sf_dir), "pred_priority_id", "priority_name", K.PRIORITIES)
    return (p.orderBy("ticket_id").limit(10)
             .select("ticket_id", "category", F.col("priority_name").alias("priority"),
                     F.round("category_confidence", 4).alias("confidence")))
