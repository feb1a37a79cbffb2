"""Corpus preparation: quality, near-duplicates, repeated passages, mixing, tokens.

``run`` applies the stages to ``documents``; a driver may also write and reread
the table between them.  All stages but the last return the columns they got.

Every stage takes null, empty and very long texts, null ids, repeated rows and an
empty table (which gives an empty one); further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import bpe, mixing, passages, quality, simhash
from ticketlens.llm.common import WORD, crc_mod, read, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  It learns from the
    labelled documents that are still there, less the held-out fold.  A null text is
    scored as an empty one; rows with a null id are scored but not learned from;
    equal texts get equal scores, so repeated rows stay or go together."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(docs, labels, F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False)))
    scored = quality.score(docs, model, keep=docs.columns, out=("__score", "__good"))
    return scored.where("__good = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: shingles of three words, two bits.
    The smallest id stays (null last, then by text); texts without words, null ones
    among them, are one component; of rows that repeat id and text one stays."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier, whole lines or spans of
    words.  A document of which nothing is left goes; ``n_chars`` follows the text.
    Earlier is by id (null last), then text; null and empty texts stay as they are;
    rows that repeat id and text keep or lose the same passages."""
    out = passages.without_passages(docs)
    changed = F.col("passages_removed") > 0
    out = out.where(~changed | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times).  A null source is
    a source, the last; a null text counts no words; equal rows share their copies."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of what they decode to.
    A null text is encoded as an empty one; repeated rows come as often as they are."""
    path, pattern = bpe._tokenizer()
    out = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text"), path, pattern, chunks=bpe.CHUNKS)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats),
          ("mixing", mix_sources), ("encoding", encode)]

#: The stages are no SQL: they learn, hash and sample.  tests/llm checks each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
