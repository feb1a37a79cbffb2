"""Readers for the ticket corpora (A1-A4, G1) and generic table access.

The driver tables stand in for the ticket corpora:

* corpus A (labelled tickets): ``documents`` -- ``doc_id`` is the ticket id,
  ``source`` is the raw intent label;
* corpus B (intent corpus with an out-of-scope class): ``benchmark`` rows are
  the out-of-scope intent, user turns of ``conversations`` are in scope.

Readers only select the columns they need, so the parquet scan prunes
columns; filters written after them are pushed into the scan by Catalyst.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.constants import OUT_OF_SCOPE_LABEL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def union_all(frames) -> DataFrame:
    """G1: union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def load_corpus_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1/A2: labelled tickets ``(ticket_id, text, label_name)``."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return docs.select(F.col("doc_id").alias("ticket_id"), "text", F.col("source").alias("label_name"))


# Corpus-B rows are told apart by two columns: benchmark rows have their
# ``item_id`` and a null turn, conversation turns ``conv_id`` and ``turn``.
def load_corpus_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: ``(item_key, turn, text, intent_name)``; out-of-scope intent is ``oos``."""
    bench = read_table(spark, sf_dir, "benchmark", ["item_id", "text"]).select(
        F.col("item_id").alias("item_key"), F.lit(None).cast("long").alias("turn"), "text",
        F.lit(OUT_OF_SCOPE_LABEL).alias("intent_name"))
    conv = (read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
            .filter(F.col("role") == "user")
            .select(F.col("conv_id").alias("item_key"), F.col("turn").cast("long").alias("turn"), "text",
                    F.lit("user_turn").alias("intent_name")))
    return union_all([bench, conv])


def out_of_scope(corpus_b: DataFrame, keep: bool = True) -> DataFrame:
    """The out-of-scope rows (``keep=True``) or their complement."""
    cond = F.col("intent_name") == OUT_OF_SCOPE_LABEL
    return corpus_b.filter(cond if keep else ~cond)


def oos_as_tickets(corpus_b: DataFrame) -> DataFrame:
    """Out-of-scope rows as tickets: negative ids keep them apart from corpus A."""
    return out_of_scope(corpus_b).select(
        (-F.col("item_key") - 1).alias("ticket_id"), "text",
        F.col("intent_name").alias("label_name"))


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail fast when a required column is missing (schema-only check)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"input must have column(s): {', '.join(missing)}")
    return df
