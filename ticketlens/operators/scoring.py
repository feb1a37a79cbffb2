"""Scoring outputs: logits decoding, validation, confidence gate and the batch job
(I10, B8, B9, B11, B12, A13, C9).

Every operator here is a projection (plus broadcast joins on fixed, tiny
dimensions), so a scored table keeps the partitioning of its input and
never shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.functions import arrays as A
from ticketlens.functions import text as H
from ticketlens.operators import labels as L


def validate_text(df: DataFrame, text_col: str = "text", min_len: int = K.TEXT_MIN_LEN,
                  max_len: int = K.TEXT_MAX_LEN) -> DataFrame:
    """Flag rows whose text length is outside [min_len, max_len]; rejects are kept."""
    n = F.length(text_col)
    reason = (F.when(F.col(text_col).isNull(), F.lit("missing text"))
               .when(n < min_len, F.lit("text too short"))
               .when(n > max_len, F.lit("text too long")))
    return (df.withColumn("accepted", F.coalesce(n.between(min_len, max_len), F.lit(False)))
              .withColumn("reject_reason", reason))


def skip_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop rows whose text is empty after stripping (null is dropped too)."""
    return df.filter(H.strip(text_col) != F.lit(""))


def decode_logits(df: DataFrame, cat_logits: str = "category_logits",
                  pri_logits: str = "priority_logits",
                  threshold: float = K.AUTO_ROUTE_THRESHOLD) -> DataFrame:
    """Softmax, argmax, names, rounded confidences and the confidence gate.

    The gate compares the unrounded confidence; the output is rounded to 4 dp.
    """
    df = (df.withColumn("_cp", A.softmax(cat_logits))
            .withColumn("_pp", A.softmax(pri_logits))
            .withColumn("category_id", A.argmax("_cp"))
            .withColumn("priority_id", A.argmax("_pp"))
            .withColumn("_cconf", F.array_max("_cp"))
            .withColumn("_pconf", F.array_max("_pp")))
    df = L.id_to_name(df, "category_id", "category", K.CATEGORIES)
    df = L.id_to_name(df, "priority_id", "priority", K.PRIORITIES)
    df = L.confidence_gate(df, "_cconf", "category", threshold)
    return (df.withColumn("category_confidence", A.round4("_cconf"))
              .withColumn("priority_confidence", A.round4("_pconf"))
              .drop("_cp", "_pp", "_cconf", "_pconf"))


def logits_from_embeddings(emb: DataFrame) -> DataFrame:
    """Stand-in model output: elements 1-10 are category logits, 11-14 priority logits."""
    return emb.select(
        F.col("vec_id").alias("ticket_id"),
        F.slice("embedding", 1, len(K.CATEGORIES)).alias("category_logits"),
        F.slice("embedding", len(K.CATEGORIES) + 1, len(K.PRIORITIES)).alias("priority_logits"))


def with_failure_sentinel(inputs: DataFrame, scored: DataFrame, key: str = "ticket_id") -> DataFrame:
    """B12 + C9: attach scores to inputs; rows without a score get the error record."""
    s = scored.select(key, F.lit(True).alias("_ok"), "category", "priority",
                      "category_confidence", "routing_team")
    out = inputs.join(s, key, "left")
    ok = F.col("_ok").isNotNull()
    return (out.withColumn("category", F.when(ok, F.col("category")).otherwise(F.lit("Error")))
               .withColumn("priority", F.when(ok, F.col("priority")).otherwise(F.lit("Unknown")))
               .withColumn("confidence", F.when(ok, F.col("category_confidence")).otherwise(F.lit(0.0)))
               .withColumn("routing_team", F.when(ok, F.col("routing_team")).otherwise(F.lit("N/A")))
               .drop("_ok", "category_confidence"))


def batch_output(scored: DataFrame, input_cols) -> DataFrame:
    """Input columns plus category, priority, confidence, routing_team."""
    return scored.select(*input_cols, "category", "priority",
                         F.col("category_confidence").alias("confidence"), "routing_team")


def run_batch_job(spark, in_path: str, out_path: str, score_fn, schema=None, reject_path: str | None = None):
    """Read CSV -> require ``text`` -> score -> write CSV; returns the row count.

    Files are read by splits; records that do not parse are no reason to stop, they
    are written to ``reject_path`` (path, record, reason) if it is given.  The count
    comes from an ``observe`` metric collected while writing.
    """
    from pyspark.sql import Observation
    from ticketlens.sources.csv_records import read_csv_rejecting
    from ticketlens.sources.files import write_csv, write_table
    from ticketlens.sources.tables import require_columns

    read = read_csv_rejecting(spark, in_path, schema=schema)
    df = require_columns(read.rows, ["text"])
    obs = Observation("batch")
    scored = score_fn(df).observe(obs, F.count(F.lit(1)).alias("tickets"))
    write_csv(batch_output(scored, df.columns), out_path)
    if reject_path:
        write_table(read.rejects, reject_path)
    return obs.get["tickets"]
