"""Catalogue: drift monitoring.

Reference = training split of the tickets; current = test split, either as
is ("normal") or with the drift rewrite applied to its text ("drifted").
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions import text as H
from ticketlens.operators import drift as D
from ticketlens.operators.profile import histogram
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.registry import query
from ticketlens.session import stored

R = 6
SPLIT = O.split_cte()
NUMERIC = ["text_length", "word_count", "category_id"]
CATEGORICAL = ["priority"]


def _rewrite_sql(col: str) -> str:
    out = f"lower({col})"
    for a, b in K.DRIFT_REPLACEMENTS:
        out = f"replace({out}, {O.q(a)}, {O.q(b)})"
    return f"({out} || {O.q(K.DRIFT_SUFFIX)})"


FEATURES = f"""feat AS (
  SELECT ticket_id, split, 'normal' AS scenario, text, category_id, priority, priority_id FROM split_tickets
  UNION ALL
  SELECT ticket_id, split, 'drifted', {_rewrite_sql('text')}, category_id, priority, priority_id FROM split_tickets WHERE split = 'test'),
feat2 AS (SELECT *, CAST(length(text) AS INTEGER) AS text_length, {O.word_count('text')} AS word_count FROM feat),
sides AS (
  SELECT s.scenario, 'ref' AS side, f.* EXCLUDE (scenario) FROM feat2 f, (VALUES ('normal'), ('drifted')) s(scenario)
  WHERE f.split = 'train' AND f.scenario = 'normal'
  UNION ALL
  SELECT scenario, 'cur', * EXCLUDE (scenario) FROM feat2 WHERE split = 'test')"""


def _long(cols, cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT scenario, side, '{c}' AS feature, CAST({c} AS {cast}) AS value FROM sides" for c in cols)


NUMERIC_SQL = f"""vc AS (
  SELECT scenario, feature, value, count_if(side = 'ref') AS n_ref, count_if(side = 'cur') AS n_cur
  FROM ({_long(NUMERIC, 'DOUBLE')}) l WHERE value IS NOT NULL GROUP BY ALL),
cdf AS (
  SELECT *, sum(n_ref) OVER w AS cum_ref, sum(n_cur) OVER w AS cum_cur,
         lead(value) OVER (PARTITION BY scenario, feature ORDER BY value) AS next_value
  FROM vc WINDOW w AS (PARTITION BY scenario, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT scenario, feature, sum(n_ref) AS n_ref, sum(n_cur) AS n_cur FROM vc GROUP BY ALL),
mu AS (SELECT scenario, feature, sum(value * n_ref) / sum(n_ref) AS m FROM vc GROUP BY ALL),
sd AS (SELECT vc.scenario, vc.feature, sqrt(sum(n_ref * (value - m) ^ 2) / sum(n_ref)) AS ref_std
       FROM vc JOIN mu USING (scenario, feature) GROUP BY ALL),
st AS (
  SELECT c.scenario, c.feature, max(abs(cum_ref / t.n_ref - cum_cur / t.n_cur)) AS ks_stat,
         sum(CASE WHEN next_value IS NOT NULL THEN abs(cum_ref / t.n_ref - cum_cur / t.n_cur) * (next_value - value)
                  ELSE 0.0 END) AS wasserstein
  FROM cdf c JOIN tot t USING (scenario, feature) GROUP BY ALL),
st2 AS (
  SELECT st.*, t.n_ref, t.n_cur, sd.ref_std,
         CASE WHEN ref_std > 0 THEN wasserstein / ref_std ELSE wasserstein END AS wd_norm,
         sqrt(CAST(t.n_ref AS DOUBLE) * t.n_cur / (t.n_ref + t.n_cur)) * ks_stat AS lam
  FROM st JOIN tot t USING (scenario, feature) JOIN sd USING (scenario, feature)),
st3 AS (
  SELECT *, least(greatest(CASE WHEN lam <= 0 THEN 1.0
     WHEN lam < 1.0 THEN 1.0 - sqrt(2 * pi()) / lam *
          list_sum(list_transform(range(1, 101), lambda j: exp(-(2 * j - 1) * (2 * j - 1) * (pi() * pi()) / (8.0 * lam * lam))))
     ELSE 2.0 * list_sum(list_transform(range(1, 101), lambda j: pow(-1.0, j - 1) * exp(-2.0 * j * j * lam * lam)))
     END, 0.0), 1.0) AS pval
  FROM st2),
numeric AS (
  SELECT scenario, feature, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
         round(ks_stat, {R}) AS ks_stat, round(pval, {R}) AS ks_pvalue, round(wd_norm, {R}) AS wasserstein_norm,
         'wasserstein' AS method, round(wd_norm, {R}) AS score, CAST({D.WASSERSTEIN_LIMIT} AS DOUBLE) AS threshold,
         wd_norm >= {D.WASSERSTEIN_LIMIT} AS drift_detected
  FROM st3)"""

CATEGORICAL_SQL = f"""cvc AS (
  SELECT scenario, feature, value, count_if(side = 'ref') AS n_ref, count_if(side = 'cur') AS n_cur
  FROM ({_long(CATEGORICAL, 'VARCHAR')}) l WHERE value IS NOT NULL GROUP BY ALL),
ctot AS (SELECT scenario, feature, sum(n_ref) AS nr, sum(n_cur) AS nc FROM cvc GROUP BY ALL),
cs AS (SELECT c.scenario, c.feature, c.n_ref / t.nr AS p, c.n_cur / t.nc AS q, c.n_ref, c.n_cur, t.nc
       FROM cvc c JOIN ctot t USING (scenario, feature)),
chi AS (
  SELECT *, CASE WHEN fresh > 0 THEN 0.0 WHEN n_values < 2 OR chi2 <= 0 THEN 1.0 ELSE
         least(greatest(1.0 - list_sum(list_transform(range(0, 2000), lambda n:
           exp((a + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(a + n + 1)))), 0.0), 1.0) END AS chi2_p
  FROM (SELECT scenario, feature, (count(*) - 1) / 2.0 AS a, count(*) AS n_values,
               sum(CASE WHEN p * nc > 0 THEN (n_cur - p * nc) ^ 2 / (p * nc) ELSE 0.0 END) AS chi2,
               count_if(n_ref = 0 AND n_cur > 0) AS fresh FROM cs GROUP BY ALL) x),
categorical AS (
  SELECT scenario, feature, round(js, {R}) AS js_distance, round(x.chi2, {R}) AS chi2_stat,
         round(chi2_p, {R}) AS chi2_pvalue, x.n_values, 'jensenshannon' AS method, round(js, {R}) AS score, CAST({D.JS_LIMIT} AS DOUBLE) AS threshold, js >= {D.JS_LIMIT} AS drift_detected
  FROM (SELECT scenario, feature,
               sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0.0 END)
                               + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0.0 END))) AS js,
               sum(CASE WHEN p * nc > 0 THEN (n_cur - p * nc) ^ 2 / (p * nc) ELSE 0.0 END) AS chi2,
               count(*) AS n_values
        FROM cs GROUP BY ALL) x JOIN chi USING (scenario, feature))"""

VERDICTS_SQL = """verdicts AS (
  SELECT scenario, feature, method, score, threshold, drift_detected FROM numeric
  UNION ALL SELECT scenario, feature, method, score, threshold, drift_detected FROM categorical)"""


def _with_drift(body: str) -> str:
    return O.with_tickets(body, SPLIT, FEATURES, NUMERIC_SQL, CATEGORICAL_SQL, VERDICTS_SQL)


# ---- Spark side --------------------------------------------------------------------

def sides(spark, sf_dir):
    """Split tickets -> rows tagged (scenario, side) with J1 features.

    Training rows are the reference of both scenarios: their features are
    computed once and the small feature row is duplicated.  Test rows are
    the current side, with the rewritten text in the "drifted" scenario.
    """
    st = FX.split_tickets(spark, sf_dir).select("ticket_id", "category_id", "priority", "priority_id", "split", "text")
    cols = ["ticket_id", "category_id", "priority", "priority_id", "text_length", "word_count", "label_id"]
    train = D.monitor_features(st.filter(F.col("split") == "train")).select(*cols)
    ref = train.select("*", F.explode(F.array(F.lit("normal"), F.lit("drifted"))).alias("scenario"))
    test = st.filter(F.col("split") == "test")
    normal = D.monitor_features(test).select(*cols, F.lit("normal").alias("scenario"))
    drifted = D.monitor_features(D.rewrite_text(test)).select(*cols, F.lit("drifted").alias("scenario"))
    out = (ref.withColumn("side", F.lit("ref"))
              .unionByName(normal.withColumn("side", F.lit("cur")))
              .unionByName(drifted.withColumn("side", F.lit("cur"))))
    # a narrow feature table (no text) read by the numeric and categorical
    # branches: written so the texts are scanned and measured once
    return stored(out, "sides")


def verdicts(spark, sf_dir):
    return D.drift_verdicts(sides(spark, sf_dir), None, NUMERIC, CATEGORICAL, keys=["scenario"])


@query("h6_drift_rewrite", O.with_tickets(
    f"SELECT ticket_id, {_rewrite_sql('text')} AS rewritten FROM tickets"))
def h6_drift_rewrite(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.select("ticket_id", H.replace_chain("text", K.DRIFT_REPLACEMENTS, K.DRIFT_SUFFIX).alias("rewritten"))


@query("j1_monitor_features", _with_drift(
    "SELECT scenario, side, ticket_id, text_length, word_count, category_id FROM sides"))
def j1_monitor_features(spark, sf_dir):
    return sides(spark, sf_dir).select("scenario", "side", "ticket_id", "text_length", "word_count", "category_id")


@query("j2_numeric_drift", _with_drift("SELECT * FROM numeric"))
def j2_numeric_drift(spark, sf_dir):
    return D.numeric_drift(sides(spark, sf_dir), None, NUMERIC, keys=["scenario"])


@query("j2_numeric_drift_ks", _with_drift(f"""
SELECT * EXCLUDE (method, score, threshold, drift_detected), 'ks' AS method, ks_pvalue AS score,
       CAST({D.KS_P_LIMIT} AS DOUBLE) AS threshold, (SELECT pval FROM st3 x WHERE x.scenario = numeric.scenario
       AND x.feature = numeric.feature) < {D.KS_P_LIMIT} AS drift_detected
FROM numeric"""))
def j2_numeric_drift_ks(spark, sf_dir):
    """J2 with the small-reference method."""
    return D.numeric_drift(sides(spark, sf_dir), None, NUMERIC, "ks", keys=["scenario"])


@query("j2_numeric_drift_ks_exact")
def j2_numeric_drift_ks_exact(spark, sf_dir):
    """J2 with the exact distribution of the KS statistic."""
    return D.numeric_drift(sides(spark, sf_dir), None, NUMERIC, "ks_exact", keys=["scenario"])


@query("j3_categorical_drift", _with_drift("SELECT * FROM categorical"))
def j3_categorical_drift(spark, sf_dir):
    return D.categorical_drift(sides(spark, sf_dir), None, CATEGORICAL, keys=["scenario"])


@query("j3_categorical_drift_chi2", _with_drift(f"""
SELECT * EXCLUDE (method, score, threshold, drift_detected), 'chisquare' AS method, chi2_pvalue AS score,
       CAST({D.CHI2_P_LIMIT} AS DOUBLE) AS threshold, (SELECT chi2_p FROM chi WHERE chi.scenario = categorical.scenario
       AND chi.feature = categorical.feature) < {D.CHI2_P_LIMIT} AS drift_detected
FROM categorical"""))
def j3_categorical_drift_chi2(spark, sf_dir):
    """J3 with the small-reference method."""
    return D.categorical_drift(sides(spark, sf_dir), None, CATEGORICAL, "chisquare", keys=["scenario"])


DISPATCHED = ["text_length", "word_count", "category_id", "priority_id"]


@query("j6_dispatched_drift", O.with_tickets(f"""
SELECT scenario, feature, n_values, method, score, threshold, drift_detected FROM categorical WHERE n_values <= {D.FEW_VALUES}
UNION ALL
SELECT n.scenario, n.feature, n_values, n.method, n.score, n.threshold, n.drift_detected
FROM numeric n JOIN (SELECT scenario, feature, n_values FROM categorical) c USING (scenario, feature)
WHERE n_values > {D.FEW_VALUES}""", SPLIT, FEATURES, NUMERIC_SQL.replace(_long(NUMERIC, "DOUBLE"), _long(DISPATCHED, "DOUBLE")),
    CATEGORICAL_SQL.replace(_long(CATEGORICAL, "VARCHAR"), _long(DISPATCHED, "VARCHAR"))))
def j6_dispatched_drift(spark, sf_dir):
    """J2 / J3 with numbers of few values taken as categories (priority_id has four)."""
    return D.dispatched_drift(sides(spark, sf_dir), None, DISPATCHED, keys=["scenario"])


@query("j6_drift_verdicts", _with_drift(
    "SELECT *, CASE WHEN drift_detected THEN 'DRIFT' ELSE 'OK' END AS status FROM verdicts"))
def j6_drift_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir)


@query("j4_dataset_drift", _with_drift(f"""
SELECT scenario, count(*) AS n_columns, count_if(drift_detected) AS n_drifted,
       round(count_if(drift_detected) / count(*), {R}) AS share_drifted_columns,
       CAST({D.DATASET_SHARE_LIMIT} AS DOUBLE) AS drift_share_limit,
       count_if(drift_detected) / count(*) >= {D.DATASET_SHARE_LIMIT} AS dataset_drift
FROM verdicts GROUP BY scenario"""))
def j4_dataset_drift(spark, sf_dir):
    return D.dataset_drift(verdicts(spark, sf_dir))


@query("j5_distribution_tables", _with_drift(f"""
, xs AS (SELECT scenario || ':' || side AS grp, 'text_length' AS feature, CAST(text_length AS DOUBLE) AS x FROM sides
       UNION ALL SELECT scenario || ':' || side, 'word_count', CAST(word_count AS DOUBLE) FROM sides),
edges AS (SELECT feature, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM xs GROUP BY feature),
binned AS (SELECT feature, grp, CAST(least(floor((x - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, lo, hi
           FROM xs JOIN edges USING (feature) WHERE x IS NOT NULL)
SELECT feature, grp, bin, round(lo + bin * ((hi - lo) / 30), {R}) AS bin_start,
       round(lo + (bin + 1) * ((hi - lo) / 30), {R}) AS bin_end, count(*) AS n
FROM binned GROUP BY feature, grp, bin, lo, hi""").replace("\n\n, xs AS", ",\nxs AS").replace("verdicts AS", "verdicts AS", 1))
def j5_distribution_tables(spark, sf_dir):
    """Histograms of text length and word count, reference and current sides on shared bin edges."""
    u = sides(spark, sf_dir).select(F.concat_ws(":", "scenario", "side").alias("grp"), "text_length", "word_count")
    out = [histogram(u, c, 30, ["grp"]).withColumn("feature", F.lit(c)) for c in ("text_length", "word_count")]
    return out[0].unionByName(out[1])
