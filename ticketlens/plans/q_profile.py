"""Catalogue: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.functions import text as H
from ticketlens.operators import profile as P
from ticketlens.operators.split import seeded_sample
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.registry import query
from ticketlens.sources import tables as T

R = 6
WC = O.word_count("text")


def _corpus_a(spark, sf_dir):
    return T.load_corpus_a(spark, sf_dir)


# -- D1-D4 ---------------------------------------------------------------------

@query("d1_category_counts", O.with_tickets("SELECT category, count(*) AS n FROM tickets GROUP BY 1"))
def d1_category_counts(spark, sf_dir):
    return P.value_counts(FX.tickets(spark, sf_dir), "category")


@query("d1_label_counts", "SELECT source AS label_name, count(*) AS n FROM documents GROUP BY 1")
def d1_label_counts(spark, sf_dir):
    return P.value_counts(_corpus_a(spark, sf_dir), "label_name")


@query("d2_priority_counts", O.with_tickets("SELECT priority, count(*) AS n FROM tickets GROUP BY 1"))
def d2_priority_counts(spark, sf_dir):
    return P.value_counts(FX.tickets(spark, sf_dir), "priority")


@query("d3_category_share", O.with_tickets(f"""
SELECT category, n, round(n * 100.0 / sum(n) OVER (), {R}) AS pct
FROM (SELECT category, count(*) AS n FROM tickets GROUP BY 1) c"""))
def d3_category_share(spark, sf_dir):
    return P.with_share(P.value_counts(FX.tickets(spark, sf_dir), "category"))


@query("d3_priority_share", O.with_tickets(f"""
SELECT priority, n, round(n * 100.0 / sum(n) OVER (), {R}) AS pct
FROM (SELECT priority, count(*) AS n FROM tickets GROUP BY 1) c"""))
def d3_priority_share(spark, sf_dir):
    return P.with_share(P.value_counts(FX.tickets(spark, sf_dir), "priority"))


@query("d4_distinct_counts", O.with_tickets("""
SELECT count(*) AS n_rows, count(DISTINCT label_name) AS n_labels,
       count(DISTINCT category) AS n_categories, count(DISTINCT text) AS n_texts FROM tickets"""))
def d4_distinct_counts(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label_name").alias("n_labels"),
                 F.countDistinct("category").alias("n_categories"),
                 F.countDistinct(P.text_digest("text")).alias("n_texts"))


# -- D5-D10 --------------------------------------------------------------------

@query("d5_length_stats", f"""WITH {O.CORPUS_B},
wc AS (SELECT 'A' AS corpus, {WC} AS word_count FROM documents
       UNION ALL SELECT 'B', {WC} FROM corpus_b)
SELECT corpus, round(avg(word_count), {R}) AS mean, round(quantile_cont(word_count, 0.5), {R}) AS median,
       min(word_count) AS min, max(word_count) AS max, round(quantile_cont(word_count, 0.95), {R}) AS p95
FROM wc GROUP BY corpus""")
def d5_length_stats(spark, sf_dir):
    a = _corpus_a(spark, sf_dir).select(F.lit("A").alias("corpus"), H.word_count("text").alias("word_count"))
    b = T.load_corpus_b(spark, sf_dir).select(F.lit("B").alias("corpus"),
                                              H.word_count("text").alias("word_count"))
    return P.length_stats(a.unionByName(b), "word_count", ["corpus"])


@query("d6_class_imbalance", f"""
SELECT first(source ORDER BY n DESC, source) AS largest_label, max(n) AS largest_n,
       first(source ORDER BY n, source) AS smallest_label, min(n) AS smallest_n,
       round(max(n) / min(n), {R}) AS imbalance_ratio
FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) c""")
def d6_class_imbalance(spark, sf_dir):
    return P.class_imbalance(_corpus_a(spark, sf_dir), "label_name")


@query("d7_duplicates", O.with_tickets(f"""
SELECT n_rows, n_rows - d AS n_duplicates, round((n_rows - d) * 100.0 / n_rows, {R}) AS duplicate_pct
FROM (SELECT count(*) AS n_rows,
             count(DISTINCT text) + CASE WHEN count_if(text IS NULL) > 0 THEN 1 ELSE 0 END AS d
      FROM tickets) s"""))
def d7_duplicates(spark, sf_dir):
    return P.duplicate_stats(FX.tickets(spark, sf_dir))


@query("d8_quality_counts", O.with_tickets(f"""
SELECT count_if({O.strip('text')} = '') AS n_empty, count_if(text IS NULL) AS n_null FROM tickets"""))
def d8_quality_counts(spark, sf_dir):
    return P.quality_counts(FX.tickets(spark, sf_dir))


WORDS_A = f"""words AS (
  SELECT unnest(list_filter(regexp_split_to_array(lower(text), '{O.WS}+'), lambda w: w <> '')) AS word
  FROM documents),
freq AS (SELECT word, count(*) AS n FROM words GROUP BY word)"""


@query("d9_vocabulary", f"WITH {WORDS_A} SELECT CAST(sum(n) AS BIGINT) AS total_words, count(*) AS unique_words FROM freq")
def d9_vocabulary(spark, sf_dir):
    return P.vocabulary_summary(P.word_frequencies(_corpus_a(spark, sf_dir)))


@query("d9_top20_words", f"WITH {WORDS_A} SELECT word, n FROM freq ORDER BY n DESC, word LIMIT 20")
def d9_top20_words(spark, sf_dir):
    return P.top_k(P.word_frequencies(_corpus_a(spark, sf_dir)), "word", 20)


@query("f3_top30_words", f"WITH {WORDS_A} SELECT word, n FROM freq ORDER BY n DESC, word LIMIT 30")
def f3_top30_words(spark, sf_dir):
    return P.top_k(P.word_frequencies(_corpus_a(spark, sf_dir)), "word", 30)


@query("d10_oos_ratio", f"""WITH {O.CORPUS_B}
SELECT count_if(intent_name = 'oos') AS n_oos, count_if(intent_name <> 'oos') AS n_in_scope,
       round(count_if(intent_name = 'oos') * 100.0 / count(*), {R}) AS oos_pct FROM corpus_b""")
def d10_oos_ratio(spark, sf_dir):
    b = T.load_corpus_b(spark, sf_dir)
    oos = F.col("intent_name") == "oos"
    return b.agg(F.count_if(oos).alias("n_oos"), F.count_if(~oos).alias("n_in_scope"),
                 F.round(F.count_if(oos) * 100.0 / F.count(F.lit(1)), R).alias("oos_pct"))


# -- D24 histograms ------------------------------------------------------------

def _hist_sql(source: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""
edges AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM {source}),
binned AS (SELECT {g}CAST(least(floor((x - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, lo, hi
           FROM {source}, edges WHERE x IS NOT NULL)
SELECT {g}bin, round(lo + bin * ((hi - lo) / 30), {R}) AS bin_start,
       round(lo + (bin + 1) * ((hi - lo) / 30), {R}) AS bin_end, count(*) AS n
FROM binned GROUP BY {g}bin, lo, hi"""


@query("d24_word_histogram",
       f"WITH xs AS (SELECT CAST({WC} AS DOUBLE) AS x FROM documents),{_hist_sql('xs')}")
def d24_word_histogram(spark, sf_dir):
    a = _corpus_a(spark, sf_dir).select(H.word_count("text").alias("word_count"))
    return P.histogram(a, "word_count", 30)


@query("d24_length_histogram_by_lang",
       f"WITH xs AS (SELECT lang, CAST(length(text) AS DOUBLE) AS x FROM documents),{_hist_sql('xs', 'lang')}")
def d24_length_histogram_by_lang(spark, sf_dir):
    d = T.read_table(spark, sf_dir, "documents", ["lang", "text"]).select(
        "lang", F.length("text").alias("n_chars"))
    return P.histogram(d, "n_chars", 30, ["lang"])


# -- E3, E5, E6, F2 ---------------------------------------------------------------

@query("e3_first_rows_per_label", """
WITH firsts AS (SELECT source FROM documents GROUP BY source ORDER BY min(doc_id), source LIMIT 10)
SELECT label_name, ticket_id, row_in_group FROM (
  SELECT source AS label_name, doc_id AS ticket_id,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS row_in_group
  FROM documents WHERE source IN (SELECT source FROM firsts)) r
WHERE row_in_group <= 2""")
def e3_first_rows_per_label(spark, sf_dir):
    a = _corpus_a(spark, sf_dir)
    out = P.first_rows_per_group(a, "label_name", "ticket_id", 2, first_groups=10)
    return out.select("label_name", "ticket_id", F.col("row_in_group").cast("long"))


@query("e5_seeded_sample", O.with_tickets(
    "SELECT ticket_id, category FROM tickets ORDER BY md5('42:' || ticket_id), ticket_id LIMIT 10"))
def e5_seeded_sample(spark, sf_dir):
    return seeded_sample(FX.tickets(spark, sf_dir), "ticket_id", 10).select("ticket_id", "category")


@query("e6_mark_duplicates", O.with_tickets("""
SELECT ticket_id, row_number() OVER (PARTITION BY text ORDER BY ticket_id) > 1 AS is_duplicate FROM tickets"""))
def e6_mark_duplicates(spark, sf_dir):
    return P.mark_duplicates(FX.tickets(spark, sf_dir), "text", "ticket_id").select(
        "ticket_id", "is_duplicate")


@query("f2_top_labels", "SELECT source AS label_name, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, label_name LIMIT 20")
def f2_top_labels(spark, sf_dir):
    return P.top_k(P.value_counts(_corpus_a(spark, sf_dir), "label_name"), "label_name", 20)


@query("f2_bottom_labels", "SELECT source AS label_name, count(*) AS n FROM documents GROUP BY 1 ORDER BY n, label_name LIMIT 20")
def f2_bottom_labels(spark, sf_dir):
    return P.top_k(P.value_counts(_corpus_a(spark, sf_dir), "label_name"), "label_name", 20,
                   largest=False)


# -- H: scalar text functions --------------------------------------------------------

@query("h2_h3_text_measures", O.with_tickets(f"""
SELECT ticket_id, {WC} AS word_count, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(length({O.strip('text')}) AS INTEGER) AS n_chars_stripped, lower(text) = text AS is_lower FROM tickets"""))
def h2_h3_text_measures(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.select("ticket_id", H.word_count("text").alias("word_count"),
                    H.char_length("text").alias("n_chars"),
                    F.length(H.strip("text")).alias("n_chars_stripped"),
                    (H.lower("text") == F.col("text")).alias("is_lower"))


@query("h7_preview", O.with_tickets("""
SELECT ticket_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS text_preview,
       CAST(ticket_id AS VARCHAR) AS ticket_key FROM tickets"""))
def h7_preview(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.select("ticket_id", H.preview("text").alias("text_preview"),
                    H.as_string("ticket_id").alias("ticket_key"))
