"""Catalogue: metric records, model comparison and run records.

Two scorers are evaluated on the tickets: the id-arithmetic predictions and
the logits decoder over ``embeddings`` (a ticket without logits counts as
wrong, so both are measured on the same tickets).  Their
accuracy and weighted F1 per head form the metric table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.operators import evaluate as V
from ticketlens.operators import runs as RU
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.q_eval import _metrics_sql
from ticketlens.plans.q_scoring import DECODED, _decoded
from ticketlens.plans.registry import query
from ticketlens.session import scratch_path

R = 6
METRICS = ["cat_accuracy", "cat_f1", "pri_accuracy", "pri_f1"]
HEADS = {"cat": ("category_id", "pred_category_id"), "pri": ("priority_id", "pred_priority_id")}


_SCORED = """logit_pred AS (
  SELECT t.ticket_id, t.category_id, t.priority_id, coalesce(d.category_id, -1) AS pred_category_id,
         coalesce(d.priority_id, -1) AS pred_priority_id
  FROM tickets t LEFT JOIN decoded d ON t.ticket_id = d.ticket_id)"""

_MODELS = {"arithmetic": "predictions", "logits": "logit_pred"}
_CTES = [_SCORED] + [_metrics_sql(t, p, src, prefix=f"{m}_{h}_")
                     for m, src in _MODELS.items() for h, (t, p) in HEADS.items()]
_LONG_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{h}_accuracy' AS metric, round(sum(tp) / sum(support), {R}) AS value FROM {m}_{h}_metrics "
    f"UNION ALL SELECT '{m}', '{h}_f1', round(sum(f1 * support) / sum(support), {R}) FROM {m}_{h}_metrics"
    for m in _MODELS for h in HEADS)
METRICS_SQL = O.with_predictions(f"SELECT * FROM ({_LONG_SQL}) x", DECODED, *_CTES)


def metric_table(spark, sf_dir):
    """Long metric records; each scorer is evaluated for both heads in one pass
    (I13's stacked evaluation), then the two scorers are unioned."""
    preds = FX.predictions(spark, sf_dir)
    t = FX.tickets(spark, sf_dir).select("ticket_id", "category_id", "priority_id")
    d = _decoded(spark, sf_dir).select("ticket_id", F.col("category_id").alias("pred_category_id"),
                                       F.col("priority_id").alias("pred_priority_id"))
    logit = t.join(d, "ticket_id", "left").na.fill(-1, ["pred_category_id", "pred_priority_id"])
    out = None
    for name, df in (("arithmetic", preds), ("logits", logit)):
        m = V.two_head_metrics(df, HEADS)
        pairs = F.explode(F.array(
            F.struct(F.concat(F.col("head"), F.lit("_accuracy")).alias("metric"), F.col("accuracy").alias("value")),
            F.struct(F.concat(F.col("head"), F.lit("_f1")).alias("metric"), F.col("weighted_f1").alias("value"))))
        part = m.select(F.lit(name).alias("model"), pairs.alias("x")).select("model", "x.metric", "x.value")
        out = part if out is None else out.unionByName(part)
    return out


@query("a9_metric_records", METRICS_SQL)
def a9_metric_records(spark, sf_dir):
    """The records that two runs appended to the metrics sink, read back:
    the first run's values of one model are replaced by the second's."""
    path = scratch_path(spark, "metrics")
    now = metric_table(spark, sf_dir)
    RU.write_metrics(now.where("model = 'logits'").withColumn("value", F.lit(0.0)), path, run=1)
    RU.write_metrics(now, path, run=2)
    return RU.read_metrics(spark, path)


#: Costs as a user records them beside the measured metrics: milliseconds a ticket
#: and megabytes of the model (parameters of the comparison, not measured here).
COSTS = [("arithmetic", "latency_ms", 0.02), ("arithmetic", "size_mb", 0.1),
         ("logits", "latency_ms", 1.14), ("logits", "size_mb", 4.0)]
COST_METRICS = ["latency_ms", "size_mb"]
ALL_METRICS = METRICS + COST_METRICS


def all_metrics(spark, sf_dir):
    """Measured metrics and recorded costs, through the sink."""
    path = scratch_path(spark, "metrics")
    RU.write_metrics(metric_table(spark, sf_dir), path, run=1)
    RU.write_metrics(spark.createDataFrame(COSTS, "model string, metric string, value double"), path, run=2)
    return RU.comparison_table(RU.read_metrics(spark, path), ALL_METRICS)


_COST_SQL = O.values(COSTS, ["model", "metric", "value"])
_WIDE = ", ".join(f"CAST(first(value) FILTER (WHERE metric = '{m}') AS DOUBLE) AS {m}" for m in ALL_METRICS)
_FLAGS = ", ".join([f"{m} = max({m}) OVER () AS best_{m}" for m in METRICS] + [f"{m} = min({m}) OVER () AS best_{m}" for m in COST_METRICS])
_WIDE_SQL = f"(SELECT model, {_WIDE} FROM ({_LONG_SQL} UNION ALL SELECT * FROM {_COST_SQL}) x GROUP BY model) w"


@query("i14_model_comparison", METRICS_SQL.replace(
    f"SELECT * FROM ({_LONG_SQL}) x",
    f"SELECT *, {_FLAGS}, round(cat_f1 / max(cat_f1) OVER (), {R}) AS cat_f1_vs_best, "
    f"round(max(CASE WHEN model = 'logits' THEN latency_ms END) OVER () / latency_ms, {R}) AS speed_up, "
    f"round(max(CASE WHEN model = 'logits' THEN size_mb END) OVER () / size_mb, {R}) AS size_ratio "
    f"FROM {_WIDE_SQL}"))
def i14_model_comparison(spark, sf_dir):
    """I14 + E8: the comparison table with latency and size, best-in-column flags
    (largest metric, least cost), the ratio to the best F1, and speed-up and size
    ratio over the logits model."""
    from pyspark.sql import Window
    wide = RU.best_flags(all_metrics(spark, sf_dir), maximize=METRICS, minimize=COST_METRICS)
    wide = wide.withColumn("cat_f1_vs_best", F.round(F.col("cat_f1") / F.max("cat_f1").over(Window.partitionBy()), R))
    return RU.relative_to(RU.relative_to(wide, "latency_ms", "logits", "speed_up"), "size_mb", "logits", "size_ratio")


@query("f4_best_model", METRICS_SQL.replace(
    f"SELECT * FROM ({_LONG_SQL}) x",
    f"SELECT first(model ORDER BY cat_f1 DESC, model) AS model, max(cat_f1) AS cat_f1 FROM {_WIDE_SQL}"))
def f4_best_model(spark, sf_dir):
    """the best model by category F1 (first name on ties)."""
    wide = RU.comparison_table(metric_table(spark, sf_dir), METRICS)
    return RU.best_model(wide, "cat_f1")


@query("f4_fastest_model", METRICS_SQL.replace(
    f"SELECT * FROM ({_LONG_SQL}) x",
    f"SELECT first(model ORDER BY latency_ms, model) AS model, min(latency_ms) AS latency_ms FROM {_WIDE_SQL}"))
def f4_fastest_model(spark, sf_dir):
    """the fastest model (first name on ties)."""
    return RU.best_model(all_metrics(spark, sf_dir), "latency_ms", largest=False)


@query("a10_run_records", METRICS_SQL.replace(
    f"SELECT * FROM ({_LONG_SQL}) x",
    "SELECT * FROM (VALUES ('baseline', 'param', 'max_features', CAST(" + str(K.MAX_FEATURES) + f" AS DOUBLE), '{K.MAX_FEATURES}', CAST(NULL AS INTEGER)),"
    " ('baseline', 'param', 'seed', CAST(" + str(K.SPLIT_SEED) + f" AS DOUBLE), '{K.SPLIT_SEED}', CAST(NULL AS INTEGER)),"
    " ('baseline', 'param', 'solver', CAST(NULL AS DOUBLE), 'lbfgs', CAST(NULL AS INTEGER))) p(run_id, kind, key, value, text, step)"
    f" UNION ALL SELECT model, 'metric', metric, value, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM ({_LONG_SQL}) x"))
def a10_run_records(spark, sf_dir):
    """A10: params of the run plus the metrics each scorer produced, one runs table."""
    long = metric_table(spark, sf_dir)
    params = RU.record_run(spark, "baseline", {"max_features": K.MAX_FEATURES, "seed": K.SPLIT_SEED, "solver": "lbfgs"})
    metrics = long.select(F.col("model").alias("run_id"), F.lit("metric").alias("kind"),
                          F.col("metric").alias("key"), "value", F.lit(None).cast("string").alias("text"),
                          F.lit(None).cast("int").alias("step"))
    return params.unionByName(metrics)
