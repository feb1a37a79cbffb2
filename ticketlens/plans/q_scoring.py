"""Catalogue: scoring outputs (I10, H8-H11, B8, B12, A13, C6, D27, K4 batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions import arrays as A
from ticketlens.operators import labels as L
from ticketlens.operators import scoring as S
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.registry import query
from ticketlens.sources import tables as T

R = 6
THR = K.AUTO_ROUTE_THRESHOLD


def reason_sql(conf: str, thr: float = THR) -> str:
    return (f"printf('Low confidence (%.1f%% < %.0f%% threshold)', "
            f"CAST({conf} AS DOUBLE) * 100.0, {float(thr) * 100.0})")


def gate_sql(conf: str, cat: str, thr: float = THR) -> str:
    team = O.case_map(cat, K.CATEGORY_TO_TEAM, O.q(K.FALLBACK_TEAM))
    return (f"CASE WHEN {conf} < {thr} THEN {O.q(K.STATUS_REVIEW)} ELSE {O.q(K.STATUS_AUTO)} END AS review_status, "
            f"CASE WHEN {conf} < {thr} THEN {reason_sql(conf, thr)} END AS review_reason, "
            f"CASE WHEN {conf} < {thr} THEN {O.q(K.REVIEW_TEAM)} ELSE {team} END AS routing_team")


def _id_name_sql(col: str, names) -> str:
    whens = " ".join(f"WHEN {col} = {i} THEN {O.q(n)}" for i, n in enumerate(names))
    return f"(CASE {whens} END)"


# DuckDB form of I10: softmax (max subtracted), first argmax, names, gate.
DECODED = f"""lg AS (
  SELECT vec_id AS ticket_id,
         list_transform(list_slice(embedding, 1, 10), lambda x: CAST(x AS DOUBLE)) AS cl,
         list_transform(list_slice(embedding, 11, 14), lambda x: CAST(x AS DOUBLE)) AS pl
  FROM embeddings),
ex AS (
  SELECT ticket_id, list_transform(cl, lambda x: exp(x - cm)) AS ce, list_transform(pl, lambda x: exp(x - pm)) AS pe
  FROM (SELECT *, list_max(cl) AS cm, list_max(pl) AS pm FROM lg) _m),
pr AS (
  SELECT ticket_id, list_transform(ce, lambda x: x / cs) AS cp, list_transform(pe, lambda x: x / ps) AS pp
  FROM (SELECT *, list_sum(ce) AS cs, list_sum(pe) AS ps FROM ex) _s),
am AS (
  SELECT ticket_id, cp, pp,
         CAST(list_position(cp, list_max(cp)) - 1 AS INTEGER) AS category_id,
         CAST(list_position(pp, list_max(pp)) - 1 AS INTEGER) AS priority_id,
         list_max(cp) AS cconf, list_max(pp) AS pconf FROM pr),
decoded AS (
  SELECT ticket_id, category_id, {_id_name_sql('category_id', K.CATEGORIES)} AS category,
         round(cconf, 4) AS category_confidence, priority_id,
         {_id_name_sql('priority_id', K.PRIORITIES)} AS priority, round(pconf, 4) AS priority_confidence,
         {gate_sql('cconf', _id_name_sql('category_id', K.CATEGORIES))}
  FROM am)"""


def _decoded(spark, sf_dir):
    emb = T.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return S.decode_logits(S.logits_from_embeddings(emb))


_I10_COLS = ["ticket_id", "category_id", "category", "category_confidence", "priority_id", "priority",
             "priority_confidence", "review_status", "review_reason", "routing_team"]


@query("i10_decode_logits", f"WITH {DECODED} SELECT {', '.join(_I10_COLS)} FROM decoded")
def i10_decode_logits(spark, sf_dir):
    return _decoded(spark, sf_dir).select(*_I10_COLS)


@query("h10_softmax", f"""WITH {DECODED}
SELECT ticket_id, list_transform(cp, lambda x: round(x, {R})) AS category_probs,
       round(list_sum(cp), {R}) AS prob_sum, category_id AS argmax, round(cconf, 4) AS max_prob FROM am""")
def h10_softmax(spark, sf_dir):
    e = S.logits_from_embeddings(T.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    p = e.select("ticket_id", A.softmax("category_logits").alias("p"))
    return p.select("ticket_id", F.transform("p", lambda x: F.round(x, R)).alias("category_probs"),
                    F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), R).alias("prob_sum"),
                    A.argmax("p").alias("argmax"), A.round4(A.array_max("p")).alias("max_prob"))


@query("b8_confidence_gate", O.with_predictions(f"""
SELECT ticket_id, category, round(category_confidence, 4) AS category_confidence, {gate_sql('category_confidence', 'category')}
FROM predictions"""))
def b8_confidence_gate(spark, sf_dir):
    p = L.confidence_gate(FX.predictions(spark, sf_dir))
    return p.select("ticket_id", "category", A.round4("category_confidence").alias("category_confidence"),
                    "review_status", "review_reason", "routing_team")


@query("b12_failure_sentinel", O.with_tickets(f"""
SELECT t.ticket_id, coalesce(d.category, 'Error') AS category, coalesce(d.priority, 'Unknown') AS priority,
       CASE WHEN d.ticket_id IS NULL THEN 0.0 ELSE d.category_confidence END AS confidence,
       CASE WHEN d.ticket_id IS NULL THEN 'N/A' ELSE d.routing_team END AS routing_team
FROM tickets t LEFT JOIN decoded d ON t.ticket_id = d.ticket_id""", DECODED))
def b12_failure_sentinel(spark, sf_dir):
    t = FX.tickets(spark, sf_dir).select("ticket_id")
    return S.with_failure_sentinel(t, _decoded(spark, sf_dir)).select(
        "ticket_id", "category", "priority", "confidence", "routing_team")


@query("a13_batch_output", O.with_tickets("""
SELECT t.ticket_id, t.text, coalesce(d.category, 'Error') AS category, coalesce(d.priority, 'Unknown') AS priority,
       CASE WHEN d.ticket_id IS NULL THEN 0.0 ELSE d.category_confidence END AS confidence,
       CASE WHEN d.ticket_id IS NULL THEN 'N/A' ELSE d.routing_team END AS routing_team
FROM tickets t LEFT JOIN decoded d ON t.ticket_id = d.ticket_id""", DECODED))
def a13_batch_output(spark, sf_dir):
    """A13 as a plan: every ticket comes out, scored or with the failure record."""
    t = FX.tickets(spark, sf_dir).select("ticket_id", "text")
    return S.with_failure_sentinel(t, _decoded(spark, sf_dir)).select(
        "ticket_id", "text", "category", "priority", "confidence", "routing_team")


@query("d27_routed_counts", f"""WITH {DECODED}
SELECT 'category' AS dimension, category AS value, count(*) AS n FROM decoded GROUP BY category
UNION ALL SELECT 'priority', priority, count(*) FROM decoded GROUP BY priority
UNION ALL SELECT 'routing_team', routing_team, count(*) FROM decoded GROUP BY routing_team
UNION ALL SELECT 'review_status', review_status, count(*) FROM decoded GROUP BY review_status""")
def d27_routed_counts(spark, sf_dir):
    """Tickets per category / priority / team / status of a scored batch, one pass."""
    d = _decoded(spark, sf_dir)
    dims = ["category", "priority", "routing_team", "review_status"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in dims]))
    return (d.select(pairs.alias("x")).select("x.dimension", "x.value")
             .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")))


_SLA = O.values([(p, lbl, m) for p, (lbl, m) in K.PRIORITY_SLA.items()],
                ["priority", "sla_label", "sla_minutes"])


@query("c6_priority_sla", O.with_tickets(f"""
SELECT t.ticket_id, t.priority, s.sla_label, CAST(s.sla_minutes AS INTEGER) AS sla_minutes
FROM tickets t LEFT JOIN {_SLA} s ON t.priority = s.priority"""))
def c6_priority_sla(spark, sf_dir):
    return L.priority_sla(FX.tickets(spark, sf_dir)).select("ticket_id", "priority", "sla_label", "sla_minutes")


# Events as a ticket stream: event type -> priority, response time = value * 10 minutes.
EVENT_PRIORITY = {"error": "P0-Critical", "purchase": "P1-High", "signup": "P2-Medium",
                  "click": "P3-Low", "view": "P3-Low"}


def event_tickets(spark, sf_dir, source=None):
    ev = source if source is not None else T.read_table(
        spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    pri = None
    for t, p in EVENT_PRIORITY.items():
        pri = F.when(F.col("event_type") == t, F.lit(p)) if pri is None else pri.when(F.col("event_type") == t, F.lit(p))
    return ev.select(F.col("event_id").alias("ticket_id"), F.col("ts").alias("opened_at"), "event_type",
                     pri.alias("priority"), (F.col("value") * 10.0).alias("response_minutes"))


K4_SQL = f"""
SELECT e.event_id AS ticket_id, e.ts AS opened_at, p.priority, s.sla_label, CAST(s.sla_minutes AS INTEGER) AS sla_minutes,
       e.ts + to_minutes(CAST(s.sla_minutes AS BIGINT)) AS sla_deadline,
       round(e.value * 10.0, {R}) AS response_minutes, e.value * 10.0 > s.sla_minutes AS sla_breached
FROM events e
JOIN {O.values(EVENT_PRIORITY.items(), ['event_type', 'priority'])} p ON e.event_type = p.event_type
LEFT JOIN {_SLA} s ON p.priority = s.priority"""


@query("k4_sla_deadlines", K4_SQL)
def k4_sla_deadlines(spark, sf_dir):
    """K4 (batch form) / C6 on event time: deadline = opened + target, breach flag."""
    t = L.priority_sla(event_tickets(spark, sf_dir), opened_col="opened_at")
    return t.select("ticket_id", "opened_at", "priority", "sla_label", "sla_minutes", "sla_deadline",
                    F.round("response_minutes", R).alias("response_minutes"),
                    (F.col("response_minutes") > F.col("sla_minutes")).alias("sla_breached"))
