"""Catalogue: training by epochs, its recorded history, and early stopping over it.

Softmax regression on the TF-IDF weights is trained on the training split, an
epoch from the last one's coefficients, and scored on the validation split after
each.  The weighted F1 per epoch is recorded with its step (A10); E7's patience
rule reads the records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions import arrays as A
from ticketlens.operators import evaluate as V
from ticketlens.operators import packed as P
from ticketlens.operators import runs as RU
from ticketlens.operators import training as TR
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.q_features import SPLIT, TFIDF_SQL, _packed
from ticketlens.plans.registry import query
from ticketlens.session import scratch_path, stored

EPOCHS, RATE, PATIENCE = 6, 12.0, 2
CLASSES = len(K.CATEGORIES)
RUN = "softmax"


def recorded_history(spark, sf_dir):
    """The run's records, as written to the sink and read again (once per application)."""
    def build():
        st, (rows, vocab, _) = FX.split_tickets(spark, sf_dir), _packed(spark, sf_dir)
        part = lambda s: st.filter(F.col("split") == s).select("ticket_id", "category_id")
        marked = lambda s: P.with_marks(rows, "ticket_id", "category_id", CLASSES, F.col("split") == s, squared=True)
        val, mine = part("val"), marked("val")
        found = []
        for epoch, coef in TR.epochs(marked("train"), part("train"), "ticket_id", "category_id", CLASSES, EPOCHS, RATE, vocab.count()):
            scores = TR.class_scores(mine, coef, val, "ticket_id", CLASSES)
            found.append(scores.select("ticket_id", F.lit(epoch).alias("step"), A.argmax("scores").alias("pred")))
        scored = reduce(lambda a, b: a.unionByName(b), found).join(val, "ticket_id")
        f1 = stored(V.grouped_weighted_f1(scored, "step", "category_id", "pred"), "f1")
        path = scratch_path(spark, "runs")
        for _ in range(2):  # a retried job leaves its records once
            RU.record_run(spark, RUN, {"rate": RATE, "epochs": EPOCHS},
                          f1.select(F.lit("val_f1").alias("key"), F.round("weighted_f1", 9).alias("value"), "step"), path)
        return RU.read_runs(spark, path)
    return FX.materialized(spark, ("history", sf_dir), build)


def _history_sql() -> str:
    cs = range(CLASSES)
    out = [TFIDF_SQL, """
tr AS MATERIALIZED (SELECT ticket_id, category_id FROM split_tickets WHERE split = 'train'),
va AS MATERIALIZED (SELECT ticket_id, category_id FROM split_tickets WHERE split = 'val'),
tw AS MATERIALIZED (SELECT w.* FROM weights w JOIN tr USING (ticket_id)),
vw AS MATERIALIZED (SELECT w.* FROM weights w JOIN va USING (ticket_id))"""]
    zeros = "[" + ", ".join("0.0" for _ in cs) + "]"
    for e in range(1, EPOCHS + 1):
        if e == 1:
            out.append(f"s1 AS (SELECT ticket_id, CAST({zeros} AS DOUBLE[]) AS s FROM tr)")
        else:
            sums = ", ".join(f"sum(weight * coef[{c + 1}])" for c in cs)
            out.append(f"s{e} AS MATERIALIZED (SELECT tr.ticket_id, coalesce(x.s, CAST({zeros} AS DOUBLE[])) AS s FROM tr LEFT JOIN ("
                       f"SELECT ticket_id, [{sums}] AS s FROM tw JOIN c{e - 1} USING (term) GROUP BY ticket_id) x USING (ticket_id))")
        out.append(f"p{e} AS MATERIALIZED (SELECT ticket_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM ("
                   f"SELECT ticket_id, list_transform(s, lambda x: exp(x - m)) AS ex FROM (SELECT *, list_max(s) AS m FROM s{e}) a) b)")
        res = ", ".join(f"sum(weight * (p[{c + 1}] - CASE WHEN category_id = {c} THEN 1.0 ELSE 0.0 END))" for c in cs)
        out.append(f"g{e} AS (SELECT term, [{res}] AS g FROM tw JOIN p{e} USING (ticket_id) JOIN tr USING (ticket_id) GROUP BY term)")
        step = f"* ({RATE} / (SELECT count(*) FROM tr))"
        if e == 1:
            new = ", ".join(f"-g[{c + 1}] {step}" for c in cs)
            out.append(f"c1 AS MATERIALIZED (SELECT term, [{new}] AS coef FROM g1)")
        else:
            new = ", ".join(f"coef[{c + 1}] - g[{c + 1}] {step}" for c in cs)
            out.append(f"c{e} AS MATERIALIZED (SELECT term, [{new}] AS coef FROM c{e - 1} JOIN g{e} USING (term))")
        sums = ", ".join(f"sum(weight * coef[{c + 1}])" for c in cs)
        out.append(f"v{e} AS (SELECT va.ticket_id, category_id, {e} AS epoch, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred "
                   f"FROM (SELECT va.ticket_id, va.category_id, coalesce(x.s, CAST({zeros} AS DOUBLE[])) AS s FROM va LEFT JOIN ("
                   f"SELECT ticket_id, [{sums}] AS s FROM vw JOIN c{e} USING (term) GROUP BY ticket_id) x USING (ticket_id)) va)")
    out.append("vp AS (" + " UNION ALL ".join(f"SELECT * FROM v{e}" for e in range(1, EPOCHS + 1)) + ")")
    out.append("""
hconf AS (SELECT epoch, category_id AS t, pred AS p, count(*) AS n FROM vp GROUP BY ALL),
hm AS (
  SELECT coalesce(s.epoch, q.epoch) AS epoch, coalesce(tp.n, 0) AS tp, coalesce(s.support, 0) AS support,
         coalesce(q.predicted, 0) AS predicted
  FROM (SELECT epoch, t AS c, sum(n) AS support FROM hconf GROUP BY ALL) s
  FULL OUTER JOIN (SELECT epoch, p AS c, sum(n) AS predicted FROM hconf GROUP BY ALL) q
    ON s.epoch = q.epoch AND s.c = q.c
  LEFT JOIN (SELECT epoch, t AS c, n FROM hconf WHERE t = p) tp
    ON tp.epoch = coalesce(s.epoch, q.epoch) AND tp.c = coalesce(s.c, q.c))""")
    out.append(f"""
hist AS (
  SELECT '{RUN}' AS run_id, CAST(epoch AS INTEGER) AS epoch,
         round(sum(CASE WHEN support + predicted > 0 THEN (2 * tp) / (support + predicted) ELSE 0.0 END * support)
               / sum(support), 9) AS val_f1
  FROM hm GROUP BY epoch)""")
    return ",\n".join(out)


HISTORY_SQL = _history_sql()


@query("e7_validation_history", O.with_tickets("SELECT run_id, epoch, val_f1 FROM hist", SPLIT, HISTORY_SQL))
def e7_validation_history(spark, sf_dir):
    """The recorded validation F1 of each epoch (input of E7)."""
    h = recorded_history(spark, sf_dir).where("kind = 'metric'")
    return h.select("run_id", F.col("step").alias("epoch"), F.col("value").alias("val_f1"))


@query("a10_stepped_records", O.with_tickets(f"""
SELECT run_id, 'metric' AS kind, 'val_f1' AS key, val_f1 AS value, CAST(NULL AS VARCHAR) AS text, epoch AS step FROM hist
UNION ALL SELECT * FROM (VALUES ('{RUN}', 'param', 'rate', CAST({RATE} AS DOUBLE), '{RATE}', CAST(NULL AS INTEGER)),
  ('{RUN}', 'param', 'epochs', CAST({EPOCHS} AS DOUBLE), '{EPOCHS}', CAST(NULL AS INTEGER))) p""", SPLIT, HISTORY_SQL))
def a10_stepped_records(spark, sf_dir):
    """A10: params and stepped metrics of the run, written twice (a retry) and read once."""
    return recorded_history(spark, sf_dir)


@query("e7_early_stopping", O.with_tickets(f"""
, h2 AS (SELECT *, coalesce(val_f1 > max(val_f1) OVER (PARTITION BY run_id ORDER BY epoch
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM hist),
h3 AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)
                 AS island FROM h2),
h4 AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY epoch) - 1 AS misses FROM h3),
stp AS (SELECT run_id, min(epoch) AS stop_epoch FROM h4 WHERE misses >= {PATIENCE} GROUP BY run_id),
seen AS (SELECT h4.*, stp.stop_epoch FROM h4 LEFT JOIN stp USING (run_id)
         WHERE stp.stop_epoch IS NULL OR epoch <= stp.stop_epoch)
SELECT run_id, max(epoch) FILTER (WHERE improved) AS best_epoch, max(val_f1) FILTER (WHERE improved) AS best_value,
       any_value(stop_epoch) AS stop_epoch, max(epoch) AS last_epoch_seen
FROM seen GROUP BY run_id""".replace("\n, h2 AS", "h2 AS"), SPLIT, HISTORY_SQL).replace(
    "\nh2 AS (SELECT *, coalesce", ",\nh2 AS (SELECT *, coalesce", 1))
def e7_early_stopping(spark, sf_dir):
    """Best epoch (strict improvement) and the patience stop over the history."""
    return RU.early_stopping(e7_validation_history(spark, sf_dir), patience=PATIENCE)
