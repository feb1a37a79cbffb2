"""Catalogue: text features and relational linear scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions import arrays as A
from ticketlens.functions import text as H
from ticketlens.operators import features as FE
from ticketlens.operators import packed as P
from ticketlens.plans import fixtures as FX
from ticketlens.plans import oracle as O
from ticketlens.plans.registry import query
from ticketlens.session import stored

R = 6
SPLIT = O.split_cte()
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
WS = O.WS

# ---- DuckDB building blocks -------------------------------------------------------

TOK_SQL = f"""tok AS (
  SELECT ticket_id, regexp_extract_all(strip_accents(lower(text)), '{TOKEN_RE}') AS t FROM split_tickets),
grams AS (
  SELECT ticket_id, t || CASE WHEN len(t) >= 2
                              THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                              ELSE [] END AS g FROM tok)"""

TFIDF_SQL = TOK_SQL + f""",
counts AS (SELECT ticket_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest(g) AS term FROM grams) x GROUP BY ALL),
train_counts AS (SELECT c.* FROM counts c JOIN split_tickets s USING (ticket_id) WHERE s.split = 'train'),
vocab AS (SELECT term, sum(tf) AS corpus_count FROM train_counts GROUP BY term
          ORDER BY corpus_count DESC, term LIMIT {K.MAX_FEATURES}),
ndocs AS (SELECT count(*) AS n_docs FROM split_tickets WHERE split = 'train'),
idf AS (SELECT term, count(*) AS df, ln((1 + any_value(n_docs)) / (1 + count(*))) + 1 AS idf
        FROM train_counts JOIN vocab USING (term), ndocs GROUP BY term),
wraw AS (SELECT c.ticket_id, c.term, (1 + ln(c.tf)) * i.idf AS w FROM counts c JOIN idf i USING (term)),
weights AS (SELECT ticket_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY ticket_id)) AS weight FROM wraw)"""


def _packed(spark, sf_dir):
    """The fitted vectoriser's weights with a row a ticket, its vocabulary and idf,
    written once (the vocabulary is a small lookup, the weights are computed once)."""
    st = FX.split_tickets(spark, sf_dir)
    return FX.materialized(spark, ("tfidf", sf_dir), lambda: FE.fit_transform_tfidf(
        st, "ticket_id", F.col("split") == "train", stage=lambda d: stored(d, "tfidf"),
        keep=["ticket_id", "split", "category_id", "priority_id"]))


def _tfidf(spark, sf_dir):
    """The split tickets and the fitted vectoriser's tables (weights, vocabulary, idf)."""
    rows, vocab, idf = _packed(spark, sf_dir)
    return FX.split_tickets(spark, sf_dir), FE.unpacked(rows, vocab, "ticket_id"), vocab, idf


# ---- H12-H14 ---------------------------------------------------------------------

@query("h12_strip_accents", O.with_tickets("SELECT ticket_id, strip_accents(lower(text)) AS folded FROM tickets"))
def h12_strip_accents(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    return t.select("ticket_id", H.strip_accents(F.lower("text")).alias("folded"))


@query("h13_h14_tokens", O.with_tickets(f"""
SELECT ticket_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(g) AS INTEGER) AS n_terms, md5(array_to_string(t, ' ')) AS tokens_md5,
       md5(array_to_string(g, '|')) AS terms_md5 FROM tok JOIN grams USING (ticket_id)""", SPLIT, TOK_SQL))
def h13_h14_tokens(spark, sf_dir):
    t = FX.tickets(spark, sf_dir)
    # explode of one array (outer: no filter that makes it again): its terms are made once a row, not once for each use
    t = t.select("ticket_id", F.explode_outer(F.array(H.tokens("text"))).alias("tok"))
    t = t.select("ticket_id", "tok", F.explode_outer(F.array(H.ngrams_1_2("tok"))).alias("grams"))
    return t.select("ticket_id", F.size("tok").alias("n_tokens"), F.size("grams").alias("n_terms"),
                    F.md5(F.array_join("tok", " ")).alias("tokens_md5"),
                    F.md5(F.array_join("grams", "|")).alias("terms_md5"))


# ---- I1-I3 -----------------------------------------------------------------------

@query("i1_vocabulary", O.with_tickets(
    "SELECT term, corpus_count, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_index FROM vocab",
    SPLIT, TFIDF_SQL))
def i1_vocabulary(spark, sf_dir):
    return _tfidf(spark, sf_dir)[2]


@query("i2_idf", O.with_tickets(f"SELECT term, df, round(idf, {R}) AS idf FROM idf", SPLIT, TFIDF_SQL))
def i2_idf(spark, sf_dir):
    idf = _tfidf(spark, sf_dir)[3]
    return idf.select("term", "df", F.round("idf", R).alias("idf"))


@query("i2_tfidf_weights", O.with_tickets(
    f"SELECT ticket_id, term, round(weight, {R}) AS weight FROM weights", SPLIT, TFIDF_SQL))
def i2_tfidf_weights(spark, sf_dir):
    w = _tfidf(spark, sf_dir)[1]
    return w.select("ticket_id", "term", F.round("weight", R).alias("weight"))


@query("i3_feature_samples", O.with_tickets("""
SELECT * FROM (SELECT 'feature' AS kind, term FROM vocab ORDER BY term LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'bigram', term FROM vocab WHERE contains(term, ' ') ORDER BY term LIMIT 10)
UNION ALL SELECT 'count_unigrams', CAST(count_if(NOT contains(term, ' ')) AS VARCHAR) FROM vocab
UNION ALL SELECT 'count_bigrams', CAST(count_if(contains(term, ' ')) AS VARCHAR) FROM vocab""", SPLIT, TFIDF_SQL))
def i3_feature_samples(spark, sf_dir):
    """First feature names, first bigram names, and uni/bigram counts of the vocabulary."""
    v = _tfidf(spark, sf_dir)[2].select("term")
    big = F.col("term").contains(" ")
    first = v.orderBy("term").limit(10).select(F.lit("feature").alias("kind"), "term")
    bigr = v.filter(big).orderBy("term").limit(10).select(F.lit("bigram").alias("kind"), "term")
    counts = v.agg(F.count_if(~big).alias("u"), F.count_if(big).alias("b"))
    c = counts.select(F.explode(F.array(
        F.struct(F.lit("count_unigrams").alias("kind"), F.col("u").cast("string").alias("term")),
        F.struct(F.lit("count_bigrams").alias("kind"), F.col("b").cast("string").alias("term")))).alias("x"))
    return first.unionByName(bigr).unionByName(c.select("x.kind", "x.term"))


# ---- I8: relational linear scoring with centroid coefficients ----------------------

_DENSE = ", ".join(f"coalesce(max(score) FILTER (WHERE class_id = {c}), 0.0)" for c in range(10))

I8_SQL = TFIDF_SQL + f""",
csize AS (SELECT category_id AS class_id, count(*) AS n FROM split_tickets WHERE split = 'train' GROUP BY 1),
coef AS (SELECT w.term, s.category_id AS class_id, sum(w.weight) / any_value(z.n) AS coef
         FROM weights w JOIN split_tickets s USING (ticket_id) JOIN csize z ON z.class_id = s.category_id
         WHERE s.split = 'train' GROUP BY 1, 2),
sc AS (SELECT w.ticket_id, c.class_id, sum(w.weight * c.coef) AS score
       FROM weights w JOIN coef c USING (term) GROUP BY 1, 2),
dense AS (SELECT t.ticket_id, [{_DENSE}] AS scores
          FROM split_tickets t LEFT JOIN sc ON t.ticket_id = sc.ticket_id GROUP BY t.ticket_id),
probs AS (SELECT ticket_id, list_transform(e, lambda x: x / list_sum(e)) AS p
          FROM (SELECT ticket_id, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e FROM dense) d),
i8 AS (SELECT p2.ticket_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred_category_id,
              round(list_max(p), 4) AS confidence, s.category_id, s.split
       FROM probs p2 JOIN split_tickets s USING (ticket_id))"""


def centroid_scored(spark, sf_dir):
    st, (rows, vocab, _), n = FX.split_tickets(spark, sf_dir), _packed(spark, sf_dir), len(K.CATEGORIES)
    train = st.filter(F.col("split") == "train").select("ticket_id", "category_id")
    marked = P.with_marks(rows, "ticket_id", "category_id", n, F.col("split") == "train")
    coef = FE.centroid_coefficients(marked, train, "ticket_id", "category_id", vocab, n)
    scores = FE.linear_scores(rows, coef, "ticket_id", n, ids=st, vocab=vocab)
    p = scores.select("ticket_id", A.softmax("scores").alias("p"))
    p = p.select("ticket_id", A.argmax("p").alias("pred_category_id"),
                 A.round4(A.array_max("p")).alias("confidence"))
    return p.join(st.select("ticket_id", "category_id", "split"), "ticket_id", "inner")


@query("i8_linear_scoring", O.with_tickets(
    "SELECT ticket_id, pred_category_id, confidence FROM i8", SPLIT, I8_SQL))
def i8_linear_scoring(spark, sf_dir):
    return centroid_scored(spark, sf_dir).select("ticket_id", "pred_category_id", "confidence")


@query("i8_accuracy_by_split", O.with_tickets(f"""
SELECT split, round(avg(CAST(category_id = pred_category_id AS INTEGER)), {R}) AS accuracy, count(*) AS n
FROM i8 GROUP BY split""", SPLIT, I8_SQL))
def i8_accuracy_by_split(spark, sf_dir):
    from ticketlens.operators.evaluate import accuracy_by
    return accuracy_by(centroid_scored(spark, sf_dir), "category_id", "pred_category_id", "split")


# ---- I9 / H15: word vocabulary and fixed-length sequences -------------------------

WORDS = f"list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda w: w <> '')"
VOCAB_W = f"""wv AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM split_tickets WHERE split = 'train') x
       GROUP BY word HAVING count(*) >= {K.VOCAB_MIN_COUNT}),
vocab_w AS (SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 1 AS INTEGER) AS word_id FROM wv)"""


def _word_vocab(spark, sf_dir):
    st = FX.split_tickets(spark, sf_dir)
    return st, FE.word_vocabulary(st.filter(F.col("split") == "train"))


@query("i9_word_vocabulary", O.with_tickets("SELECT word, n, word_id FROM vocab_w", SPLIT, VOCAB_W))
def i9_word_vocabulary(spark, sf_dir):
    return _word_vocab(spark, sf_dir)[1]


@query("h15_sequences", O.with_tickets(f"""
SELECT t.ticket_id, list_resize(coalesce(e.ids, []::INTEGER[]), {K.MAX_SEQ_LENGTH}, 0) AS sequence
FROM split_tickets t LEFT JOIN (
  SELECT ticket_id, list(coalesce(v.word_id, {K.UNK_ID}) ORDER BY pos) AS ids
  FROM (SELECT tw.ticket_id, r.pos, tw.w[r.pos + 1] AS word
        FROM (SELECT ticket_id, {WORDS} AS w FROM split_tickets) tw,
             range(0, least(len(tw.w), {K.MAX_SEQ_LENGTH})) r(pos)) p
  LEFT JOIN vocab_w v USING (word) GROUP BY ticket_id) e ON t.ticket_id = e.ticket_id""", SPLIT, VOCAB_W))
def h15_sequences(spark, sf_dir):
    st, vocab = _word_vocab(spark, sf_dir)
    return FE.encode_sequences(st, vocab, "ticket_id")
