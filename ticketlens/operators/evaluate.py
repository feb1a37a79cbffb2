"""Model evaluation as relational operators (B10, B13, B14, C7, C8, D16-D23, D25, D26,
D28, E4, F1, I13).

Pattern: one map-side-combined aggregate of the scored rows into a long
confusion table ``(truth, pred, n)`` -- at most k^2 rows however many
tickets there are -- then every metric is computed on that small table.
Nothing per-ticket is collected or windowed globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions.text import preview

R = 6


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def align(pred: DataFrame, truth: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Predictions next to the truth by an equi-join on the ticket key."""
    return pred.join(truth, key, "inner")


def misclassified(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """B10."""
    return df.filter(F.col(truth) != F.col(pred))


def confusion_long(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """D16 (long form): ``(truth, pred, n)``."""
    return (df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred"))
              .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, truth: str, pred: str, num_classes: int) -> DataFrame:
    """D16 (wide form): one row per true class, one column per predicted class."""
    classes = list(range(num_classes))
    wide = (confusion_long(df, truth, pred).groupBy("truth")
            .pivot("pred", classes).agg(F.sum("n")).na.fill(0))
    return wide.select("truth", *[F.col(str(c)).cast("long").alias(f"pred_{c}") for c in classes])


def class_metrics(df: DataFrame, truth, pred, keys=()) -> DataFrame:
    """Support, predicted, true positives and unrounded precision / recall / F1 per
    class (present as truth or prediction; 0 where undefined), and per ``keys``.

    One pass: the confusion counts are stacked as (class, role) rows and summed.
    """
    t, p = (F.col(x) if isinstance(x, str) else x for x in (truth, pred))
    c = df.groupBy(*keys, t.alias("_t"), p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    n, none = F.col("_n"), F.lit(0).cast("long")
    hit = F.when(F.col("_t") == F.col("_p"), n).otherwise(none)
    roles = F.inline(F.array(
        F.struct(F.col("_t").alias("class_id"), n.alias("_s"), none.alias("_q"), hit.alias("_h")),
        F.struct(F.col("_p").alias("class_id"), none.alias("_s"), n.alias("_q"), none.alias("_h"))))
    m = (c.select(*keys, "_t", "_p", "_n").select(*keys, roles).groupBy(*keys, "class_id")
         .agg(F.sum("_h").alias("tp"), F.sum("_s").alias("support"), F.sum("_q").alias("predicted")))
    return m.select(*keys, "class_id", "tp", "support", "predicted",
                    _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                    _safe_div(F.col("tp"), F.col("support")).alias("recall"),
                    _safe_div(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def per_class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """D17 + B14: precision, recall, F1 and support per class, rounded, and the
    quality band of the unrounded F1."""
    return class_metrics(df, truth, pred).select(
        "class_id", "support", f1_band("f1").alias("f1_band"), F.round("precision", R).alias("precision"),
        F.round("recall", R).alias("recall"), F.round("f1", R).alias("f1"))


def report_averages(metrics: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of the (unrounded) ``class_metrics`` rows."""
    s = F.col("support")
    tot = F.sum(s)
    macro = metrics.agg(F.lit("macro avg").alias("row"), F.round(F.avg("precision"), R).alias("precision"),
                        F.round(F.avg("recall"), R).alias("recall"), F.round(F.avg("f1"), R).alias("f1"),
                        tot.cast("long").alias("support"))
    weighted = metrics.agg(F.lit("weighted avg").alias("row"),
                           F.round(F.sum(F.col("precision") * s) / tot, R).alias("precision"),
                           F.round(F.sum(F.col("recall") * s) / tot, R).alias("recall"),
                           F.round(F.sum(F.col("f1") * s) / tot, R).alias("f1"),
                           tot.cast("long").alias("support"))
    return macro.unionByName(weighted)


def overall_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (one row)."""
    m = class_metrics(df, truth, pred)
    s = F.col("support")
    return m.agg(
        F.round(F.sum("tp") / F.sum(s), R).alias("accuracy"),
        F.round(F.sum(F.col("precision") * s) / F.sum(s), R).alias("weighted_precision"),
        F.round(F.sum(F.col("recall") * s) / F.sum(s), R).alias("weighted_recall"),
        F.round(F.sum(F.col("f1") * s) / F.sum(s), R).alias("weighted_f1"),
        F.sum(s).cast("long").alias("n"))


def accuracy_by(df: DataFrame, truth: str, pred: str, by: str) -> DataFrame:
    """Accuracy per group (e.g. split)."""
    ok = (F.col(truth) == F.col(pred)).cast("int")
    return df.groupBy(by).agg(F.round(F.avg(ok), R).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def two_head_metrics(df: DataFrame, heads: dict) -> DataFrame:
    """Stack (truth, pred) pairs of several heads and evaluate them per head.

    ``heads`` maps head name -> (truth column, pred column).  The stack is a
    projection (``explode`` of a literal-sized array), so each ticket row is
    read once for all heads.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("head"), F.col(t).alias("t"), F.col(p).alias("p"))
        for h, (t, p) in heads.items()]))
    long = df.select(pairs.alias("x")).select("x.head", "x.t", "x.p")
    m = class_metrics(long, "t", "p", ["head"])
    s = F.col("support")
    return m.groupBy("head").agg(
        F.round(F.sum("tp") / F.sum(s), R).alias("accuracy"),
        F.round(F.sum(F.col("f1") * s) / F.sum(s), R).alias("weighted_f1"),
        F.round(F.avg("f1"), R).alias("macro_f1"),
        F.sum(s).cast("long").alias("n"))


def confusion_pairs(df: DataFrame, truth_name: str, pred_name: str, top_n: int = 10) -> DataFrame:
    """Most frequent (true, predicted) pairs among the errors."""
    wrong = df.filter(F.col(truth_name) != F.col(pred_name))
    c = wrong.groupBy(F.col(truth_name).alias("true_category"),
                      F.col(pred_name).alias("pred_category")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "true_category", "pred_category").limit(top_n)


def confidence_by_correctness(df: DataFrame, truth: str, pred: str, conf: str) -> DataFrame:
    """Count, share, mean and median confidence for right vs wrong predictions.

    The median is read off at its place in the global order (``ordering``), so no
    task holds a group's values; a value that most rows share is split by row hash."""
    from ticketlens.operators.ordering import ranked
    rows = df.select((F.col(truth) == F.col(pred)).alias("correct"), F.col(conf).alias("_v"), F.xxhash64(*df.columns).alias("_h"))
    known = ranked(rows.where("_v is not null"), [F.col("correct"), F.col("_v"), F.col("_h")], "_rank")
    ends = known.groupBy("correct").agg(F.min("_rank").alias("_lo"), F.count(F.lit(1)).alias("_k"))  # a row a group
    middle = known.join(F.broadcast(ends), known["correct"].eqNullSafe(ends["correct"])).drop(ends["correct"])
    at = F.col("_rank") - F.col("_lo")
    middle = middle.where((at == F.floor((F.col("_k") - 1) / 2)) | (at == F.floor(F.col("_k") / 2)))
    median = middle.groupBy(F.col("correct").alias("_c")).agg(F.avg("_v").alias("_median"))
    g = rows.groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_v"), R).alias("mean_confidence"))
    g = g.join(F.broadcast(median), F.col("correct").eqNullSafe(F.col("_c")), "left").drop("_c")
    return (g.withColumn("median_confidence", F.round("_median", R)).drop("_median")
            .withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), R)))


def threshold_sweep(df: DataFrame, truth: str, pred: str, conf: str,
                    thresholds=K.SWEEP_THRESHOLDS) -> DataFrame:
    """Per threshold, rows auto-routed / sent to review and accuracy on the
    auto-routed rows (0 when none) -- one pass of conditional aggregates, then
    the single result row is unpivoted."""
    ok = F.col(truth) == F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        above = F.col(conf) >= F.lit(float(t))
        aggs += [F.count_if(above).alias(f"a{i}"), F.count_if(above & ok).alias(f"c{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("auto_n"),
                 F.col(f"c{i}").alias("auto_correct")) for i, t in enumerate(thresholds)]))
    x = one.select("n", rows.alias("r")).select("n", "r.*")
    return x.select(
        "threshold", "auto_n",
        F.round(F.col("auto_n") * 100.0 / F.col("n"), R).alias("auto_pct"),
        (F.col("n") - F.col("auto_n")).alias("review_n"),
        F.round((F.col("n") - F.col("auto_n")) * 100.0 / F.col("n"), R).alias("review_pct"),
        F.round(_safe_div(F.col("auto_correct").cast("double"), F.col("auto_n")), R).alias("auto_accuracy"))


def most_confident_errors(df: DataFrame, truth: str, pred: str, conf: str, key: str,
                          n: int = 15, text_col: str = "text") -> DataFrame:
    """The ``n`` wrong predictions with the highest confidence, ranked, text cut."""
    wrong = df.filter(F.col(truth) != F.col(pred))
    top = wrong.orderBy(F.desc(conf), F.asc(key)).limit(n)
    w = Window.orderBy(F.desc(conf), F.asc(key))  # over at most n rows
    return (top.withColumn("rank", F.row_number().over(w))
               .withColumn("text_preview", preview(text_col)))


def explain_hint(true_col: str, pred_col: str, hints=K.CONFUSION_HINTS) -> Column:
    """An explanation for the two known confusions, else null."""
    expr = None
    for t, p, why in hints:
        cond = (F.col(true_col) == t) & (F.col(pred_col) == p)
        expr = F.when(cond, F.lit(why)) if expr is None else expr.when(cond, F.lit(why))
    return expr.otherwise(F.lit(None).cast("string"))


def f1_band(f1_col: str, bands=K.F1_BANDS, top: str = K.F1_BAND_TOP) -> Column:
    """Quality band of an F1 score."""
    expr = None
    for limit, name in bands:
        cond = F.col(f1_col) < F.lit(limit)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(top))


def worst_and_best(metrics: DataFrame, name_col: str) -> DataFrame:
    """worst and best class by F1 (ties by name)."""
    return metrics.agg(
        F.min_by(name_col, F.struct("f1", name_col)).alias("worst_class"),
        F.min("f1").alias("worst_f1"),
        F.min_by(name_col, F.struct(-F.col("f1"), name_col)).alias("best_class"),
        F.max("f1").alias("best_f1"))


def prediction_parity(a: DataFrame, b: DataFrame, key: str, pred: str, truth: str | None = None) -> DataFrame:
    """Agreement of two scorers over the union of their keys, and the
    accuracy difference when a truth column is given (on ``a``)."""
    left = a.select(key, F.col(pred).alias("pred_a"), *([F.col(truth).alias("truth")] if truth else []))
    right = b.select(key, F.col(pred).alias("pred_b"))
    j = left.join(right, key, "full_outer")
    aggs = [F.count(F.lit(1)).alias("n_keys"),
            F.count_if(F.col("pred_a").eqNullSafe(F.col("pred_b"))).alias("n_match")]
    if truth:
        aggs += [F.avg((F.col("pred_a") == F.col("truth")).cast("double")).alias("_acc_a"),
                 F.avg((F.col("pred_b") == F.col("truth")).cast("double")).alias("_acc_b")]
    out = j.agg(*aggs).withColumn("match_pct", F.round(F.col("n_match") * 100.0 / F.col("n_keys"), R))
    if truth:
        out = (out.withColumn("accuracy_a", F.round("_acc_a", R))
                  .withColumn("accuracy_b", F.round("_acc_b", R))
                  .withColumn("accuracy_diff", F.round(F.col("_acc_a") - F.col("_acc_b"), R))
                  .drop("_acc_a", "_acc_b"))
    return out


def grouped_weighted_f1(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """Support-weighted F1 and accuracy per value of ``key`` (e.g. per epoch), from
    one confusion aggregate keyed by (key, truth, pred)."""
    m = class_metrics(df, truth, pred, [key])
    return m.groupBy(key).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                              (F.sum("tp") / F.sum("support")).alias("accuracy"))
