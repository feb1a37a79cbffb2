"""Run and metric tables.

Metric records are a long table ``(model, metric, value)``; a comparison is
its pivot with a listed set of metrics (so the pivot needs no extra pass to
find its columns).  All of these tables are small (models x metrics), but
the operators are plain DataFrame code so they run where the data is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens import constants as K

R = 6
RUN_SCHEMA = "run_id string, kind string, key string, value double, text string, step int"


def metrics_long(df: DataFrame, model: str, metrics) -> DataFrame:
    """One-row metric frame -> ``(model, metric, value)`` rows (``stack``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics]))
    return df.select(F.lit(model).alias("model"), pairs.alias("x")).select("model", "x.metric", "x.value")


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Write ``df`` in folders by ``parts``, replacing the folders that it has rows
    for: a job that is run again leaves its rows once, and other runs' rows alone."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def write_metrics(df: DataFrame, path: str, run: int = 0) -> None:
    """A9 sink: the metric records of a run as parquet, a folder per run and model."""
    _replace(df.select(F.lit(run).cast("int").alias("run"), "model", "metric", "value"), path, "run", "model")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A9 read-back: each model's latest value of each metric."""
    rows = spark.read.schema("metric string, value double, run int, model string").parquet(path)
    return rows.groupBy("model", "metric").agg(F.max_by("value", F.struct("run", "value")).alias("value"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A10 read-back: the records of all runs."""
    schema = "key string, value double, text string, step int, run_id string, kind string"
    return spark.read.schema(schema).parquet(path).select("run_id", "kind", "key", "value", "text", "step")


def record_run(spark: SparkSession, run_id: str, params: dict, metrics: DataFrame | None = None,
               path: str | None = None) -> DataFrame:
    """A10: experiment record ``runs(run_id, kind, key, value, text, step)``.

    Params are a driver-side dict (a handful of values): numbers go to
    ``value``, all of them as written to ``text``; metrics come as a
    ``(key, value[, step])`` DataFrame computed by Spark.  With a ``path`` they
    are written there, in place of the run's records of the same kind.
    """
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    p = spark.createDataFrame([(run_id, "param", k, number(v), str(v), None) for k, v in params.items()], RUN_SCHEMA)
    out = p
    if metrics is not None:
        step = F.col("step").cast("int") if "step" in metrics.columns else F.lit(None).cast("int")
        m = metrics.select(F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"),
                           F.col("key"), F.col("value").cast("double"), F.lit(None).cast("string").alias("text"),
                           step.alias("step"))
        out = out.unionByName(m)
    if path:
        _replace(out, path, "run_id", "kind")
    return out


def comparison_table(long: DataFrame, metrics) -> DataFrame:
    """One row per model, one column per listed metric."""
    return long.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def best_flags(table: DataFrame, maximize=(), minimize=()) -> DataFrame:
    """``best_<col>`` is true where the column reaches its best value."""
    w = Window.partitionBy()  # over the comparison table: one row per model
    out = table
    for c in maximize:
        out = out.withColumn(f"best_{c}", F.col(c) == F.max(c).over(w))
    for c in minimize:
        out = out.withColumn(f"best_{c}", F.col(c) == F.min(c).over(w))
    return out


def best_model(table: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """the model with the best value of ``metric`` (first name on ties)."""
    key = F.struct((-F.col(metric)) if largest else F.col(metric), F.col("model"))
    return table.agg(F.min_by("model", key).alias("model"),
                     (F.max(metric) if largest else F.min(metric)).alias(metric))


def relative_to(table: DataFrame, metric: str, baseline: str, out_col: str | None = None) -> DataFrame:
    """I14 speed-up style ratio: ``metric(baseline) / metric(model)`` per row."""
    base = table.filter(F.col("model") == baseline).select(F.first(metric)).scalar()
    return table.withColumn(out_col or f"{metric}_vs_{baseline}", F.round(base / F.col(metric), R))


def early_stopping(history: DataFrame, run_col: str = "run_id", epoch_col: str = "epoch",
                   metric_col: str = "val_f1", patience: int = K.PATIENCE) -> DataFrame:
    """Per run, the best epoch (strict improvement) and the epoch where
    training stops after ``patience`` epochs without one.

    A running max over earlier epochs marks improvements; an island id
    (running count of improvements) gives the misses since the last one.
    Epochs after the stop are dropped ("never seen").  Windows are per
    run, bounded by its epoch count.
    """
    w = Window.partitionBy(run_col).orderBy(epoch_col)
    prev_best = F.max(metric_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = history.withColumn("improved", F.coalesce(F.col(metric_col) > prev_best, F.lit(True)))
    h = h.withColumn("_island", F.sum(F.col("improved").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("misses", F.row_number().over(
        Window.partitionBy(run_col, "_island").orderBy(epoch_col)) - 1)
    h = h.withColumn("stop_epoch", F.min(F.when(F.col("misses") >= patience, F.col(epoch_col)))
                     .over(Window.partitionBy(run_col)))
    seen = h.filter(F.col("stop_epoch").isNull() | (F.col(epoch_col) <= F.col("stop_epoch")))
    return seen.groupBy(run_col).agg(
        F.max(F.when(F.col("improved"), F.col(epoch_col))).alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col(metric_col))).alias("best_value"),
        F.first("stop_epoch", ignorenulls=True).alias("stop_epoch"),
        F.max(epoch_col).alias("last_epoch_seen"))
