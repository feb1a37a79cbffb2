"""Text features as relations.

TF-IDF plan (fit on the training rows, transform all rows)::

    text[train] --tokens (projection)--> counts per term of many rows (Arrow)
                --groupBy(term)--> corpus count and document frequency
                --top k--> vocabulary (<= max_features rows) with idf
    text --tokens--> counts, weights and norm in the row (Arrow) --> (id, indices, values)
                     --explode--> (id, term, weight)

* A row holds a whole document, so its counts and its norm need no shuffle; the
  only one is that of the vocabulary, combined per term over many tokens before it.
* The vocabulary (and idf / coefficient tables keyed by it) is bounded by
  ``max_features`` -- that bound is what makes broadcasting it safe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import constants as K
from ticketlens.functions import text as H
from ticketlens.operators import packed as P
from ticketlens.operators.joins import lookup
from ticketlens.session import ship

R = 6
#: Tokens counted at once in a task (or one row): some 60 MB with their bigrams.
_TOKENS = 1 << 18


def _terms(tokens: pa.ListArray, first: int, last: int) -> tuple[pa.Array, np.ndarray]:
    """The n-grams of the rows (as they come, unigrams first), and the row of each."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, doc = tokens.flatten(), np.repeat(np.arange(len(tokens)), lengths)
    terms, docs = ([flat], [doc]) if first <= 1 else ([], [])
    if last >= 2 and len(flat) > 1:
        same = doc[1:] == doc[:-1]
        terms.append(pc.binary_join_element_wise(flat[:-1], flat[1:], " ").filter(pa.array(same)))
        docs.append(doc[1:][same])
    return (pa.concat_arrays([t.cast(pa.string()) for t in terms] or [pa.array([], pa.string())]),
            np.concatenate([*docs, np.zeros(0, np.int64)]))


def _slices(batches):
    """Parts of the batches with about ``_TOKENS`` tokens (the last column) each."""
    for batch in batches:
        tokens = batch.column(batch.num_columns - 1)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        for a, b in P.chunks(lengths, _TOKENS):
            yield batch.slice(a, b - a)


def _corpus_counts(first: int, last: int):
    """tokens -> term, its occurrences and its documents among many rows."""
    def run(batches):
        for part in _slices(batches):
            terms, doc = _terms(part.column(0), first, last)
            coded = terms.dictionary_encode()
            m = max(len(coded.dictionary), 1)
            code = coded.indices.to_numpy().astype(np.int64)
            in_docs = np.unique(doc * m + code) % m
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary, pa.array(np.bincount(code, minlength=m)[:len(coded.dictionary)].astype(np.int64)),
                 pa.array(np.bincount(in_docs, minlength=m)[:len(coded.dictionary)].astype(np.int64))], names=["term", "tf", "df"])
    return run


def vocabulary(df: DataFrame, text_col: str = "text", max_features: int = K.MAX_FEATURES, ngram_range=K.NGRAM_RANGE) -> DataFrame:
    """I1 + I2: the ``max_features`` uni- (and bi-) grams with the highest corpus
    count (ties by term), numbered in term order like a fitted vectoriser's feature
    index, with document frequency and smoothed idf = ln((1 + n) / (1 + df)) + 1."""
    ship(df.sparkSession)
    n_docs = df.count()
    counts = df.select(H.tokens(text_col).alias("_tok")).mapInArrow(_corpus_counts(*ngram_range), "term string, tf long, df long")
    total = counts.groupBy("term").agg(F.sum("tf").alias("corpus_count"), F.sum("df").alias("df"))
    top = total.orderBy(F.desc("corpus_count"), F.asc("term")).limit(max_features)
    # At most max_features rows: the window over them is bounded.
    from pyspark.sql import Window
    return top.select("term", "corpus_count", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("feature_index"),
                      "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _weigh(words: list[str], idf: np.ndarray, first: int, last: int):
    """(columns, tokens) -> the columns, the row's terms (rising) and their weights."""
    known, m = pa.array(words, pa.string()), max(len(words), 1)

    def run(batches):
        for part in _slices(batches):
            terms, doc = _terms(part.columns[-1], first, last)
            at = pc.index_in(terms, value_set=known)
            here = pc.is_valid(at).to_numpy(zero_copy_only=False)
            found, tf = np.unique(doc[here] * m + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            doc, at = found // m, found % m
            w = (1.0 + np.log(tf.astype(np.float64))) * idf[at]
            norm = np.sqrt(np.bincount(doc, w * w, minlength=part.num_rows))
            ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), w / norm[doc])]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], names=[*part.schema.names[:-1], "indices", "values"])
    return run


def tfidf_rows(df: DataFrame, vocab: DataFrame, text_col: str = "text", keep=(), ngram_range=K.NGRAM_RANGE) -> DataFrame:
    """I2 with a row a document: the columns of ``keep``, ``indices`` (feature numbers,
    rising) and ``values`` (sublinear tf times idf, L2 norm 1)."""
    ship(df.sparkSession)
    rows = vocab.select("term", "idf").orderBy("term").collect()  # max_features rows
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("indices", T.ArrayType(T.IntegerType())),
                           T.StructField("values", T.ArrayType(T.DoubleType()))])
    weigh = _weigh([r["term"] for r in rows], np.array([r["idf"] for r in rows], dtype=np.float64), *ngram_range)
    return df.select(*keep, H.tokens(text_col).alias("_tok")).mapInArrow(weigh, schema)


def unpacked(rows: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """``(id, term, weight)`` of rows with ``indices`` and ``values``."""
    each = rows.select(id_col, F.explode(F.arrays_zip("indices", "values")).alias("_e"))
    each = each.select(id_col, F.col("_e.indices").alias("feature_index"), F.col("_e.values").alias("weight"))
    return each.join(F.broadcast(vocab.select("term", "feature_index")), "feature_index").select(id_col, "term", "weight")


def tfidf(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text", ngram_range=K.NGRAM_RANGE) -> DataFrame:
    """``(id, term, weight)`` with sublinear tf and the L2 norm of each row, for
    the terms of the (bounded) vocabulary."""
    return unpacked(tfidf_rows(df, vocab, text_col, [id_col], ngram_range), vocab, id_col)


def fit_transform_tfidf(df: DataFrame, id_col: str, train_filter, text_col: str = "text",
                        max_features: int = K.MAX_FEATURES, stage=None, keep=None):
    """I1 + I2: returns ``(weights, vocabulary, idf)`` fitted on ``train_filter`` rows.
    ``stage`` (e.g. writing a table, ``session.stored``) is applied to the
    vocabulary before it is used.  With ``keep`` (columns) the weights are packed,
    a row a document (``tfidf_rows``)."""
    stage = stage or (lambda x: x)
    vocab = stage(vocabulary(df.where(train_filter), text_col, max_features))
    weights = tfidf(df, vocab, id_col, text_col) if keep is None else tfidf_rows(df, vocab, text_col, keep)
    return (weights, vocab.select("term", "corpus_count", "feature_index"), vocab.select("term", "df", "idf"))


def centroid_coefficients(weights: DataFrame, labels: DataFrame, id_col: str, label_col: str, vocab: DataFrame | None = None,
                          num_classes: int | None = None) -> DataFrame:
    """A linear weight table ``(term, class_id, coef)`` fitted relationally:
    the mean tf-idf vector of each class (nearest-centroid by dot product).

    Used as a data-derived stand-in for learned coefficients in I8; a fitted
    logistic-regression model exports the same table shape (``models``).
    ``weights`` may be packed rows with the marks of ``labels`` (then with ``vocab``).
    """
    sizes = labels.groupBy(F.col(label_col).alias("class_id")).agg(F.count(F.lit(1)).alias("_n"))
    if P.is_packed(weights):
        sums = P.class_sums(weights, vocab.count(), num_classes)
        c, at = np.nonzero(sums)
        s = weights.sparkSession.createDataFrame(pa.table({"feature_index": at.astype(np.int32), "class_id": c.astype(np.int32), "_s": sums[c, at]}))
        s = s.join(F.broadcast(vocab.select("term", "feature_index")), "feature_index").select("term", "class_id", "_s")
    else:
        j = weights.join(labels.select(id_col, F.col(label_col).alias("class_id")), id_col, "inner")
        s = j.groupBy("term", "class_id").agg(F.sum("weight").alias("_s"))
    return (s.join(F.broadcast(sizes), "class_id", "inner")
             .select("term", "class_id", (F.col("_s") / F.col("_n")).alias("coef")))


def coefficient_matrix(coef: DataFrame, vocab: DataFrame, num_classes: int) -> np.ndarray:
    """``(term, class_id, coef)`` as an array (class, term), bounded by the vocabulary."""
    out = np.zeros((num_classes, vocab.count()))
    found = (coef.join(F.broadcast(vocab.select("term", "feature_index")), "term").where(F.col("class_id").between(0, num_classes - 1))
             .groupBy("class_id", "feature_index").agg(F.sum("coef").alias("coef")).toArrow())
    out[found.column("class_id").to_numpy(), found.column("feature_index").to_numpy()] = found.column("coef").to_numpy()
    return out


def linear_scores(weights: DataFrame, coef: DataFrame, id_col: str, num_classes: int,
                  bias=None, ids: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """I8: ``score[id, class] = sum_t weight[id, t] * coef[t, class] + bias[class]``,
    returned as a dense ``scores`` array per id.

    Packed ``weights`` (with ``vocab``) are scored where they lie, and one aggregate per
    id sums rows that share it.  Long ones meet ``coef``, a row per vocabulary term
    (bounded) with a column per class, in a join.  Ids in ``ids`` with no vocabulary
    term get bias-only scores.
    """
    classes = list(range(num_classes))
    b = list(bias) if bias is not None else [0.0] * num_classes
    none = (ids if ids is not None else weights).select(id_col, *[F.lit(0.0).alias(f"_s{c}") for c in classes])
    if P.is_packed(weights):
        s = P.scored(weights, coefficient_matrix(coef, vocab, num_classes), id_col)
        j = s.select(id_col, *[F.col("scores")[c].alias(f"_s{c}") for c in classes])
    else:
        wide = coef.groupBy("term").pivot("class_id", classes).agg(F.sum("coef"))
        wide = wide.select("term", *[F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"_c{c}") for c in classes])
        j = weights.join(F.broadcast(wide), "term", "inner").select(
            id_col, *[(F.col("weight") * F.col(f"_c{c}")).alias(f"_s{c}") for c in classes])
    s = j.unionByName(none).groupBy(id_col).agg(*[F.sum(f"_s{c}").alias(f"_s{c}") for c in classes])
    return s.select(id_col, F.array(*[F.col(f"_s{c}") + F.lit(float(b[c])) for c in classes]).alias("scores"))


def word_vocabulary(df: DataFrame, text_col: str = "text", min_count: int = K.VOCAB_MIN_COUNT) -> DataFrame:
    """Lowered whitespace words seen at least ``min_count`` times, ids from 2
    by (count desc, word); 0 is padding and 1 unknown.

    The id is a position in a global order (``ordering.ranked``): words are
    sorted over ranges, no task sorts the whole vocabulary.
    """
    from ticketlens.operators.ordering import ranked
    from ticketlens.operators.profile import word_frequencies
    freq = word_frequencies(df, text_col).filter(F.col("n") >= min_count)
    return ranked(freq, [F.desc("n"), F.asc("word")], "_rank").select("word", "n", (F.col("_rank") + 1).cast("int").alias("word_id"))


def encode_sequences(df: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text",
                     max_len: int = K.MAX_SEQ_LENGTH) -> DataFrame:
    """Word ids (unknown -> 1), cut to ``max_len`` and right-padded with 0.

    The whole text is split into words; only the first ``max_len`` positions
    can appear in the output, so the array is cut before the vocabulary join.
    """
    pos = df.select(id_col, F.posexplode(F.slice(H.words(F.lower(text_col)), 1, max_len)).alias("pos", "word"))
    j = lookup(pos, vocab.select("word", "word_id"), "word")
    j = j.withColumn("word_id", F.coalesce(F.col("word_id"), F.lit(K.UNK_ID)))
    seq = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "word_id"))).alias("_s"))
    seq = seq.select(id_col, F.transform("_s", lambda x: x["word_id"]).alias("_ids"))
    allids = df.select(id_col)
    out = allids.join(seq, id_col, "left").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<int>")))
    pad = F.array_repeat(F.lit(K.PAD_ID), F.lit(max_len) - F.size("_ids"))
    return out.select(id_col, F.concat("_ids", pad).alias("sequence"))
