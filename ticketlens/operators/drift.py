"""Data-drift monitoring as Spark aggregates.

Per column, reference vs current:

* numeric, method "wasserstein" (the default): Wasserstein-1 distance divided
  by the reference's population std, drift when >= 0.1;
* numeric, method "ks" (for small references): two-sample Kolmogorov-Smirnov,
  drift when p < 0.05 (asymptotic Kolmogorov distribution; with "ks_exact" the
  exact one, counted over all orders, up to 10^8 pairs of rows);
  both statistics are returned whichever decides;
* categorical, method "jensenshannon" (the default): Jensen-Shannon distance (natural
  log), drift when >= 0.1;
* categorical, method "chisquare" (for small references): drift when p < 0.05;
* numbers with five distinct values or fewer may be taken as categories.

Dataset drift: share of drifted columns >= 0.5.  These defaults are
parameters.

Plan: every monitored column is stacked into one long ``(column, value)``
relation and aggregated to ``(column, value, n_ref, n_cur)`` -- one row per
distinct value, map-side combined.  Empirical CDFs then need running sums
in value order; instead of one global window, the values are sorted over
ranges of about equal depth (``ordering``): a row per column and range gives
the range's offset (and the first value of the next), and the running sum
inside is a window over the range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import constants as K
from ticketlens.functions import special as SP
from ticketlens.functions import text as H
from ticketlens.operators.ordering import in_ranges
from ticketlens.session import ship, stored

R = 6
WASSERSTEIN_LIMIT = 0.1
KS_P_LIMIT = 0.05
JS_LIMIT = 0.1
CHI2_P_LIMIT = 0.05
#: Numbers with up to so many distinct values are categories.
FEW_VALUES = 5
DATASET_SHARE_LIMIT = 0.5


def monitor_features(df: DataFrame, text_col: str = "text", label_col: str = "category_id") -> DataFrame:
    """text_length, word_count (and the label id) per row."""
    return df.select("*", H.char_length(text_col).alias("text_length"),
                     H.word_count(text_col).alias("word_count"),
                     F.col(label_col).alias("label_id") if label_col != "label_id" else F.col(label_col))


def rewrite_text(df: DataFrame, text_col: str = "text", pairs=K.DRIFT_REPLACEMENTS,
                 suffix: str = K.DRIFT_SUFFIX) -> DataFrame:
    """H6 applied as a scenario: lowered text, ordered replacements, appended suffix."""
    return df.withColumn(text_col, H.replace_chain(text_col, pairs, suffix))


def _stack(df: DataFrame, cols, side, cast: str, keys=()) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in cols])
    side_col = F.lit(side) if isinstance(side, str) else side
    return (df.select(*keys, side_col.alias("side"), F.explode(arr).alias("x"))
              .select(*keys, "side", "x.feature", "x.value")
              .where(F.col("value").isNotNull()))


def value_counts(df: DataFrame, cols, out_col: str, cast: str = "double") -> DataFrame:
    """``(feature, value, <out_col>)``: rows per distinct value of each column."""
    return (_stack(df, cols, "x", cast).groupBy("feature", "value").agg(F.count(F.lit(1)).alias(out_col)))


def value_counts_by_side(ref: DataFrame, cur: DataFrame | None, cols, cast: str = "double",
                         keys=(), side_col: str = "side") -> DataFrame:
    """``(keys..., feature, value, n_ref, n_cur)`` over the union of both sides.

    With ``cur=None``, ``ref`` already holds both sides, told apart by
    ``side_col`` ('ref' / 'cur'); this lets several scenarios share one scan.
    """
    if cur is None:
        u = _stack(ref, cols, F.col(side_col), cast, keys)
    else:
        u = _stack(ref, cols, "ref", cast, keys).unionByName(_stack(cur, cols, "cur", cast, keys))
    return u.groupBy(*keys, "feature", "value").agg(F.count_if(F.col("side") == "ref").alias("n_ref"),
                                                    F.count_if(F.col("side") == "cur").alias("n_cur"))


def running_cdf(vc: DataFrame, keys=()) -> DataFrame:
    """Adds inclusive running counts ``cum_ref``/``cum_cur`` in value order per feature
    and ``next_value`` (the next distinct value of the feature, null for the last).

    However the values lie, a range holds about as many of them as the next."""
    g = [*keys, "feature"]
    rows = in_ranges(vc, [F.col(c) for c in (*g, "value")], "values")
    # a row per feature and range that it stands in: at most one more than ranges and features
    per = rows.groupBy(*g, "_part").agg(F.sum("n_ref").alias("_br"), F.sum("n_cur").alias("_bc"), F.min("value").alias("_first"))
    wb = Window.partitionBy(*g).orderBy("_part")
    prev = wb.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("_off_ref", F.coalesce(F.sum("_br").over(prev), F.lit(0)))
              .withColumn("_off_cur", F.coalesce(F.sum("_bc").over(prev), F.lit(0)))
              .withColumn("_next", F.lead("_first").over(wb)).drop("_br", "_bc", "_first"))
    j = rows.join(F.broadcast(per), [*g, "_part"], "inner")
    w = Window.partitionBy(*g, "_part").orderBy("value")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return (j.withColumn("cum_ref", F.col("_off_ref") + F.sum("n_ref").over(run))
             .withColumn("cum_cur", F.col("_off_cur") + F.sum("n_cur").over(run))
             .withColumn("next_value", F.coalesce(F.lead("value").over(w), F.col("_next")))
             .select(*g, "value", "n_ref", "n_cur", "cum_ref", "cum_cur", "next_value"))


def ks_pvalue(stat: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p-value Q(sqrt(n m / (n + m)) * D).

    Small arguments use the Jacobi-theta form (fast convergence there),
    large ones the alternating series; both are sums over a literal
    ``sequence`` inside one expression.
    """
    lam = F.sqrt(n_ref * n_cur / (n_ref + n_cur)) * stat
    js = F.sequence(F.lit(1), F.lit(terms))
    alt = F.aggregate(js, F.lit(0.0), lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) *
                      F.exp(F.lit(-2.0) * j * j * lam * lam)) * 2.0
    cdf_small = F.aggregate(js, F.lit(0.0), lambda acc, j: acc + F.exp(
        -(2 * j - 1) * (2 * j - 1) * (F.lit(math.pi) * F.lit(math.pi)) / (8.0 * lam * lam))) * (F.sqrt(F.lit(2.0) * F.lit(math.pi)) / lam)
    p = (F.when(lam <= 0, F.lit(1.0))
          .when(lam < 1.0, F.lit(1.0) - cdf_small)
          .otherwise(alt))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


#: Pairs of rows up to which the exact KS distribution is counted.
EXACT_PAIRS = 10 ** 8


def ks_exact(steps: int, n: int, m: int) -> float:
    """P(KS statistic >= steps / (n * m)) for samples of n and m different values: of
    all orders of the two samples (lattice paths from (0, 0) to (n, m)), those that
    leave the band ``|i * m - j * n| < steps``.  Diagonal by diagonal, the share of
    paths to each point that stayed inside."""
    inside = np.ones(1)  # of the paths to (i, s - i), for i from low on
    low = 0
    for s in range(1, n + m + 1):
        first, last = max(0, s - m), min(s, n)
        i = np.arange(first, last + 1)
        wide = np.zeros(last - first + 3)  # the diagonal before, at i - 1 and i
        at = np.arange(first - 1, last + 1)
        known = (at >= low) & (at < low + len(inside))
        wide[:len(at)][known] = inside[at[known] - low]
        inside = (wide[:len(i)] * i + wide[1:len(i) + 1] * (s - i)) / s
        inside[np.abs(i * m - (s - i) * n) >= steps] = 0.0
        low = first
    return float(min(max(1.0 - inside[-1], 0.0), 1.0)) if steps > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def _ks_exact(steps: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_exact(int(a), int(b), int(c)) for a, b, c in zip(steps, n, m)])


def numeric_drift(ref: DataFrame, cur: DataFrame | None, cols, method: str = "wasserstein",
                  keys=(), ref_counts: DataFrame | None = None) -> DataFrame:
    """Per feature KS statistic and p-value, normalised Wasserstein distance, and
    the verdict of ``method`` (see ``value_counts_by_side`` for ``cur=None``;
    ``ref_counts`` are the reference's ``value_counts`` where it is fixed)."""
    if ref_counts is None:
        vc = value_counts_by_side(ref, cur, cols, keys=keys)
    else:
        now = value_counts(cur, cols, "n_cur").withColumn("n_ref", F.lit(0).cast("long"))
        vc = (ref_counts.withColumn("n_cur", F.lit(0).cast("long")).unionByName(now).groupBy("feature", "value")
              .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")))
    return numeric_from_counts(vc, method, keys)


def numeric_from_counts(vc: DataFrame, method: str = "wasserstein", keys=()) -> DataFrame:
    """J2 from ``(keys..., feature, value, n_ref, n_cur)``, one row per distinct value."""
    if method not in ("wasserstein", "ks", "ks_exact"):
        raise ValueError(f"unknown method {method!r}")
    g = [*keys, "feature"]
    vc = stored(vc, "values")  # read by several branches below
    cdf = running_cdf(vc, keys)
    # All per-feature tables below have one row per (keys, feature): tiny.
    tot = vc.groupBy(*g).agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"),
                             (F.sum(F.col("value") * F.col("n_ref")) / F.sum("n_ref")).alias("_mean"))
    std = (vc.join(F.broadcast(tot.select(*g, "_mean")), g).groupBy(*g)
             .agg(F.sqrt(F.sum(F.col("n_ref") * (F.col("value") - F.col("_mean")) ** 2) / F.sum("n_ref"))
                  .alias("ref_std")))
    c = cdf.join(F.broadcast(tot.select(*g, F.col("n_ref").alias("_nr"), F.col("n_cur").alias("_nc"))), g)
    gap = F.abs(F.col("cum_ref") / F.col("_nr") - F.col("cum_cur") / F.col("_nc"))
    stats = c.groupBy(*g).agg(
        F.max(gap).alias("_ks"),
        F.max(F.abs(F.col("cum_ref") * F.col("_nc") - F.col("cum_cur") * F.col("_nr"))).alias("_steps"),
        F.sum(F.when(F.col("next_value").isNotNull(), gap * (F.col("next_value") - F.col("value")))
               .otherwise(F.lit(0.0))).alias("wasserstein"))
    out = stats.join(tot.drop("_mean"), g).join(std, g)
    # Unrounded values get their own names first: a same-named rounded alias
    # in one select could otherwise be picked up inside the lambda below.
    out = (out.withColumn("_wd", F.when(F.col("ref_std") > 0, F.col("wasserstein") / F.col("ref_std"))
                          .otherwise(F.col("wasserstein")))
              .withColumn("_p", ks_pvalue(F.col("_ks"), F.col("n_ref").cast("double"),
                                          F.col("n_cur").cast("double"))))
    if method == "ks_exact":  # a row a feature
        ship(vc.sparkSession)
        few = F.col("n_ref") * F.col("n_cur") <= EXACT_PAIRS
        out = out.withColumn("_p", F.when(few, _ks_exact(F.when(few, F.col("_steps")).otherwise(0), F.when(few, F.col("n_ref")).otherwise(1),
                                                         F.when(few, F.col("n_cur")).otherwise(1))).otherwise(F.col("_p")))
    wd_norm, pval, by_distance = F.col("_wd"), F.col("_p"), method == "wasserstein"
    return out.select(
        *g, "n_ref", "n_cur",
        F.round("_ks", R).alias("ks_stat"), F.round(pval, R).alias("ks_pvalue"),
        F.round(wd_norm, R).alias("wasserstein_norm"),
        F.lit(method).alias("method"), F.round(wd_norm if by_distance else pval, R).alias("score"),
        F.lit(WASSERSTEIN_LIMIT if by_distance else KS_P_LIMIT).alias("threshold"),
        (wd_norm >= WASSERSTEIN_LIMIT if by_distance else pval < KS_P_LIMIT).alias("drift_detected"))


def categorical_drift(ref: DataFrame, cur: DataFrame | None, cols, method: str = "jensenshannon", keys=()) -> DataFrame:
    """Jensen-Shannon distance (natural log) and the chi-square test of the
    current counts against the reference's shares, with the verdict of ``method``
    ("chisquare", for small references: drift when p < 0.05).

    A value that the reference lacks makes p zero, as its expected count is; p is
    null beyond 1,000 values."""
    return categorical_from_counts(value_counts_by_side(ref, cur, cols, cast="string", keys=keys), method, keys)


def categorical_from_counts(vc: DataFrame, method: str = "jensenshannon", keys=()) -> DataFrame:
    """J3 from ``(keys..., feature, value, n_ref, n_cur)``, one row per distinct value."""
    if method not in ("jensenshannon", "chisquare"):
        raise ValueError(f"unknown method {method!r}")
    g = [*keys, "feature"]
    tot = vc.groupBy(*g).agg(F.sum("n_ref").alias("_nr"), F.sum("n_cur").alias("_nc"))
    s = vc.join(F.broadcast(tot), g).select(
        *g, (F.col("n_ref") / F.col("_nr")).alias("p"), (F.col("n_cur") / F.col("_nc")).alias("q"),
        "n_ref", "n_cur", "_nc")
    m = (F.col("p") + F.col("q")) / 2.0
    kl = lambda a: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / m)).otherwise(F.lit(0.0))
    expct = F.col("p") * F.col("_nc")
    chi = F.when(expct > 0, (F.col("n_cur") - expct) ** 2 / expct).otherwise(F.lit(0.0))
    out = s.groupBy(*g).agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(kl("p")) + 0.5 * F.sum(kl("q"))))
                            .alias("_js"), F.sum(chi).alias("_chi2"), F.count(F.lit(1)).alias("n_values"),
                            F.count_if((F.col("n_ref") == 0) & (F.col("n_cur") > 0)).alias("_new"))
    tail = SP.chi2_tail(F.col("_chi2"), (F.col("n_values") - 1).cast("double"))
    out = out.withColumn("_p", F.when(F.col("_new") > 0, F.lit(0.0)).otherwise(tail))
    by_chi = method == "chisquare"
    return out.select(*g, F.round("_js", R).alias("js_distance"), F.round("_chi2", R).alias("chi2_stat"),
                      F.round("_p", R).alias("chi2_pvalue"), "n_values", F.lit(method).alias("method"),
                      F.round("_p" if by_chi else "_js", R).alias("score"),
                      F.lit(CHI2_P_LIMIT if by_chi else JS_LIMIT).alias("threshold"),
                      (F.col("_p") < CHI2_P_LIMIT if by_chi else F.col("_js") >= JS_LIMIT).alias("drift_detected"))


def dispatched_drift(ref: DataFrame, cur: DataFrame | None, cols, small: bool = False, few_values: int = FEW_VALUES,
                     keys=()) -> DataFrame:
    """J2 / J3 by column: numbers with up to ``few_values`` distinct values are
    categories.  ``small`` references are tested (KS, chi-square), others compared
    by distance."""
    out = ["n_values", "method", "score", "threshold", "drift_detected"]
    cat = categorical_drift(ref, cur, cols, "chisquare" if small else "jensenshannon", keys)
    cat = cat.select(*keys, "feature", *out)
    num = numeric_drift(ref, cur, cols, "ks" if small else "wasserstein", keys=keys)
    num = num.join(cat.select(*keys, "feature", "n_values"), [*keys, "feature"])  # a row a column
    return (num.where(F.col("n_values") > few_values).select(*keys, "feature", *out)
            .unionByName(cat.where(F.col("n_values") <= few_values)))


def drift_verdicts(ref: DataFrame, cur: DataFrame | None, numeric_cols, categorical_cols=(),
                   method: str = "wasserstein", keys=(), ref_counts: DataFrame | None = None) -> DataFrame:
    """One row per feature (feature, method, score, threshold, drift, status)."""
    cols = [*keys, "feature", "method", "score", "threshold", "drift_detected"]
    parts = []
    if numeric_cols:
        parts.append(numeric_drift(ref, cur, numeric_cols, method, keys=keys, ref_counts=ref_counts).select(*cols))
    if categorical_cols:
        parts.append(categorical_drift(ref, cur, categorical_cols, keys=keys).select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_status(out)


_VERDICT = ["method", "score", "threshold", "drift_detected"]


def with_status(verdicts: DataFrame) -> DataFrame:
    return verdicts.withColumn("status", F.when(F.col("drift_detected"), F.lit("DRIFT")).otherwise(F.lit("OK")))


def verdicts_per_key(counts: DataFrame, ref_numeric: DataFrame, ref_categorical: DataFrame, key: str) -> DataFrame:
    """J6 for each value of ``key`` (a window): ``counts`` are the current rows by
    (key, feature, value, name) -- ``value`` of numeric features, ``name`` of
    categorical ones -- and the reference's counts are by (feature, value)."""
    parts = []
    for column, ref, verdict in (("value", ref_numeric, numeric_from_counts), ("name", ref_categorical, categorical_from_counts)):
        cur = counts.select(key, "feature", F.col(column).alias("value"), F.col("n").alias("n_cur")).where("value is not null")
        met = F.broadcast(cur.select(key, "feature").distinct())  # windows that close at once, times features
        both = (ref.join(met, "feature").select(key, "feature", "value", "n_ref", F.lit(0).cast("long").alias("n_cur"))
                .unionByName(cur.select(key, "feature", "value", F.lit(0).cast("long").alias("n_ref"), "n_cur")))
        vc = both.groupBy(key, "feature", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
        parts.append(verdict(vc, keys=[key]).select(key, "feature", *_VERDICT))
    return with_status(parts[0].unionByName(parts[1]))


def dataset_drift(verdicts: DataFrame, share_limit: float = DATASET_SHARE_LIMIT) -> DataFrame:
    """Share of drifted columns and the dataset verdict (one row; grouped when
    the verdicts carry a ``scenario`` column)."""
    keys = ["scenario"] if "scenario" in verdicts.columns else []
    g = verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_columns"),
                                     F.count_if("drift_detected").alias("n_drifted"))
    share = F.col("n_drifted") / F.col("n_columns")
    return g.select(*keys, "n_columns", "n_drifted", F.round(share, R).alias("share_drifted_columns"),
                    F.lit(share_limit).alias("drift_share_limit"),
                    (share >= share_limit).alias("dataset_drift"))


def drift_alerts(verdicts: DataFrame, alert_score: float = K.DRIFT_ALERT_SCORE) -> DataFrame:
    """Distance-type verdict rows whose score exceeds the alert level."""
    return verdicts.filter(~F.col("method").isin("ks", "chisquare") & (F.col("score") > alert_score))
