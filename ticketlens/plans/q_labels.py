"""Catalogue: sources, consolidation, priority rules and routing (A, B, C, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions import text as H
from ticketlens.operators import labels as L
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.operators.joins import lookup
from ticketlens.plans.registry import query
from ticketlens.sources import tables as T

R = 6  # decimals kept for doubles in both engines


# -- flagship: tickets -> category -> priority -> team -> counts ------------

def routing_summary(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    t = L.route_team(t)
    return (t.groupBy("category", "priority", "routing_team")
             .agg(F.count(F.lit(1)).alias("n_tickets")))


query("routing_summary", O.with_tickets(f"""
SELECT category, priority, {O.case_map('category', K.CATEGORY_TO_TEAM, O.q(K.FALLBACK_TEAM))} AS routing_team,
       count(*) AS n_tickets
FROM tickets GROUP BY ALL"""))(routing_summary)


# -- A: sources --------------------------------------------------------------

@query("a1_corpus_a", "SELECT doc_id AS ticket_id, text, source AS label_name FROM documents")
def a1_corpus_a(spark, sf_dir):
    return T.load_corpus_a(spark, sf_dir)


@query("a3_corpus_b", f"WITH {O.CORPUS_B} SELECT item_key, turn, text, intent_name FROM corpus_b")
def a3_corpus_b(spark, sf_dir):
    return T.load_corpus_b(spark, sf_dir)


@query("a4_corpus_stats", f"""WITH {O.CORPUS_B},
both_corpora AS (
  SELECT 'A' AS corpus, source AS label, text FROM documents
  UNION ALL SELECT 'B', intent_name, text FROM corpus_b)
SELECT corpus, count(*) AS n_rows, count(DISTINCT label) AS n_labels,
       round(avg({O.word_count('text')}), {R}) AS mean_words
FROM both_corpora GROUP BY corpus""")
def a4_corpus_stats(spark, sf_dir):
    a = T.load_corpus_a(spark, sf_dir).select(F.lit("A").alias("corpus"),
                                              F.col("label_name").alias("label"), "text")
    b = T.load_corpus_b(spark, sf_dir).select(F.lit("B").alias("corpus"),
                                              F.col("intent_name").alias("label"), "text")
    both = a.unionByName(b)
    return both.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("label").alias("n_labels"),
        F.round(F.avg(H.word_count("text")), R).alias("mean_words"))


@query("a4_first_rows", """
SELECT doc_id AS ticket_id, source AS label_name,
       CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_preview
FROM documents ORDER BY doc_id LIMIT 5""")
def a4_first_rows(spark, sf_dir):
    a = T.load_corpus_a(spark, sf_dir)
    return (a.orderBy("ticket_id").limit(5)
             .select("ticket_id", "label_name", H.preview("text").alias("text_preview")))


# -- B: projections, filters, predicates ------------------------------------

@query("b3_out_of_scope", f"""WITH {O.CORPUS_B}
SELECT item_key, turn, intent_name, intent_name = 'oos' AS out_of_scope FROM corpus_b""")
def b3_out_of_scope(spark, sf_dir):
    b = T.load_corpus_b(spark, sf_dir)
    oos = T.out_of_scope(b, True).withColumn("out_of_scope", F.lit(True))
    ins = T.out_of_scope(b, False).withColumn("out_of_scope", F.lit(False))
    return oos.unionByName(ins).select("item_key", "turn", "intent_name", "out_of_scope")


@query("b4_unmapped_labels", f"""WITH label_dim AS {O.values(FX.FIXTURE_LABEL_MAP.items(), ['label_name', 'category'])}
SELECT DISTINCT source AS label_name FROM documents
WHERE source NOT IN (SELECT label_name FROM label_dim)""")
def b4_unmapped_labels(spark, sf_dir):
    return L.unmapped_labels(T.load_corpus_a(spark, sf_dir), FX.FIXTURE_LABEL_MAP)


@query("b6_keyword_hits", O.with_tickets(f"""
SELECT count_if({O.any_keyword('text', FX.FIXTURE_P0)}) AS p0_hits,
       count_if({O.any_keyword('text', FX.FIXTURE_P1)}) AS p1_hits,
       count_if({O.any_keyword('text', FX.FIXTURE_P0 + FX.FIXTURE_P1)}) AS any_hits,
       count(*) AS n_tickets
FROM tickets"""))
def b6_keyword_hits(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    hit = lambda kws: F.coalesce(H.contains_any("text", kws), F.lit(False))
    return t.agg(F.count_if(hit(FX.FIXTURE_P0)).alias("p0_hits"),
                 F.count_if(hit(FX.FIXTURE_P1)).alias("p1_hits"),
                 F.count_if(hit(FX.FIXTURE_P0 + FX.FIXTURE_P1)).alias("any_hits"),
                 F.count(F.lit(1)).alias("n_tickets"))


@query("b7_priority", O.with_tickets(
    "SELECT ticket_id, label_name, category, priority FROM tickets"))
def b7_priority(spark, sf_dir):
    return FX.tickets(spark, sf_dir).select("ticket_id", "label_name", "category", "priority")


@query("b9_text_validation", O.with_tickets(f"""
SELECT ticket_id, CAST(length(text) AS INTEGER) AS n_chars,
       coalesce(length(text) BETWEEN {K.TEXT_MIN_LEN} AND {K.TEXT_MAX_LEN}, false) AS accepted,
       CASE WHEN text IS NULL THEN 'missing text'
            WHEN length(text) < {K.TEXT_MIN_LEN} THEN 'text too short'
            WHEN length(text) > {K.TEXT_MAX_LEN} THEN 'text too long' END AS reject_reason
FROM tickets"""))
def b9_text_validation(spark, sf_dir):
    from ticketlens.operators.scoring import validate_text
    t = validate_text(FX.tickets(spark, sf_dir))
    return t.select("ticket_id", F.length("text").alias("n_chars"), "accepted", "reject_reason")


@query("b11_blank_skip", O.with_tickets(
    f"SELECT ticket_id FROM tickets WHERE {O.strip('text')} <> ''"))
def b11_blank_skip(spark, sf_dir):
    from ticketlens.operators.scoring import skip_blank
    return skip_blank(FX.tickets(spark, sf_dir)).select("ticket_id")


# -- C: lookups ---------------------------------------------------------------

@query("c1_label_category", O.with_tickets(
    "SELECT ticket_id, label_name, category FROM tickets"))
def c1_label_category(spark, sf_dir):
    return FX.tickets(spark, sf_dir).select("ticket_id", "label_name", "category")


@query("c3_ids", O.with_tickets(
    "SELECT ticket_id, category_id, priority_id FROM tickets"))
def c3_ids(spark, sf_dir):
    return FX.tickets(spark, sf_dir).select("ticket_id", "category_id", "priority_id")


@query("c4_id_to_name", O.with_predictions(f"""
SELECT p.ticket_id, p.pred_category_id, n.name AS pred_category
FROM predictions p LEFT JOIN cat_names n ON p.pred_category_id = n.id""", O.cat_names_cte()))
def c4_id_to_name(spark, sf_dir):
    p = FX.predictions(spark, sf_dir)
    p = L.id_to_name(p, "pred_category_id", "pred_category", K.CATEGORIES)
    return p.select("ticket_id", "pred_category_id", "pred_category")


@query("c5_routing_team", O.with_tickets(f"""
SELECT ticket_id, category,
       {O.case_map('category', K.CATEGORY_TO_TEAM, O.q(K.FALLBACK_TEAM))} AS routing_team
FROM tickets"""))
def c5_routing_team(spark, sf_dir):
    return L.route_team(FX.tickets(spark, sf_dir)).select("ticket_id", "category", "routing_team")


@query("g1_consolidated", O.with_tickets(
    "SELECT ticket_id, text, label_name, category, category_id, priority, priority_id FROM tickets"))
def g1_consolidated(spark, sf_dir):
    return FX.tickets(spark, sf_dir)


@query("d13_label_dimensions", O.with_tickets("""
SELECT 'category' AS kind, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS id, category AS name
FROM (SELECT DISTINCT category FROM tickets) c
UNION ALL
SELECT 'priority', CAST(dense_rank() OVER (ORDER BY priority) - 1 AS INTEGER), priority
FROM (SELECT DISTINCT priority FROM tickets) p"""))
def d13_label_dimensions(spark, sf_dir):
    """Category and priority dimensions from the data, one table."""
    t = FX.tickets(spark, sf_dir)
    c = L.dense_ids(t, "category", "id").select(F.lit("category").alias("kind"), "id",
                                                 F.col("category").alias("name"))
    p = L.dense_ids(t, "priority", "id").select(F.lit("priority").alias("kind"), "id",
                                                 F.col("priority").alias("name"))
    return c.unionByName(p)


@query("a2_label_id_names", """
WITH dim AS (SELECT source AS label_name, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label
             FROM (SELECT DISTINCT source FROM documents) s),
coded AS (SELECT d.doc_id, m.label FROM documents d JOIN dim m ON d.source = m.label_name)
SELECT c.doc_id AS ticket_id, c.label, m.label_name FROM coded c JOIN dim m ON c.label = m.label""")
def a2_label_id_names(spark, sf_dir):
    """A2: corpora ship integer label ids; names come back by a lookup in the
    label dimension (here built from the distinct raw labels, sorted), which is
    broadcast if it is measured small and met in salted parts beyond."""
    a = T.load_corpus_a(spark, sf_dir)
    dim = L.dense_ids(a, "label_name", "label")
    coded = lookup(a, dim, "label_name", "inner").select("ticket_id", "label")
    return lookup(coded, dim, "label", "inner").select("ticket_id", "label", "label_name")
