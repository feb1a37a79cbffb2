"""How the driver tables play the ticket roles, on the Spark side.

The keyword lists and the label map are parameters whose defaults are the
pipeline's fixed values; the invented test text contains none of those
keywords, so the catalogue passes substrings that do occur.  The same
parameters feed the DuckDB oracle text in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.operators import labels as L
from ticketlens.operators.split import stratified_split
from ticketlens.session import stored
from ticketlens.sources import tables as T

# Raw labels src0..src17 map to categories by position; src18, src19 stay
# unmapped so the unmapped-label path (B4, B5) is exercised.
FIXTURE_LABEL_MAP = {f"src{i}": K.CATEGORIES[i % len(K.CATEGORIES)] for i in range(18)}
FIXTURE_P0 = ["nicht", "the with"]
FIXTURE_P1 = ["pour", "ing the"]


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated tickets: ticket_id, text, label_name, category, priority, ids."""
    a = T.load_corpus_a(spark, sf_dir)
    oos = T.oos_as_tickets(T.load_corpus_b(spark, sf_dir))
    t = L.consolidate(a, oos, FIXTURE_LABEL_MAP)
    t = L.assign_priority(t, FIXTURE_P0, FIXTURE_P1)
    return L.add_ids(t).select("ticket_id", "text", "label_name", "category", "category_id",
                               "priority", "priority_id")


def _h(id_col, mult: int, add: int):
    return F.abs(id_col * F.lit(mult) + F.lit(add)) % 1000


def with_predictions(t: DataFrame) -> DataFrame:
    """Deterministic two-head predictions from ids (same arithmetic in the oracle).

    ``pred_*`` is the truth for most rows; confidences are exact ratios so
    both engines produce the same doubles.
    """
    tid = F.col("ticket_id")
    h1 = _h(tid, 7919, 13)
    h2 = _h(tid, 104729, 7)
    ok1 = (h1 >= 200) & (h1 % 7 != 0)
    ok2 = (h2 >= 150) & (h2 % 11 != 0)
    return (t.withColumn("pred_category_id", F.when(ok1, F.col("category_id")).otherwise(
                ((F.col("category_id") + 1 + F.abs(tid) % 9) % 10).cast("int")))
             .withColumn("category_confidence", (F.lit(3000) + h1 * 7) / F.lit(10000.0))
             .withColumn("pred_priority_id", F.when(ok2, F.col("priority_id")).otherwise(
                ((F.col("priority_id") + 1 + F.abs(tid) % 3) % 4).cast("int")))
             .withColumn("priority_confidence", (F.lit(2500) + h2 * 7) / F.lit(10000.0)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_predictions(tickets(spark, sf_dir))


def named_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with category / predicted category names (C4)."""
    p = predictions(spark, sf_dir)
    p = L.id_to_name(p, "pred_category_id", "pred_category", K.CATEGORIES)
    return p


_MATERIALIZED: dict = {}


def materialized(spark: SparkSession, key, build):
    """Build a table (or a tuple of tables) once per application and keep it as
    Parquet in the shared folder; a table with a ``split`` column is laid out
    by split.  Later queries read only the columns and splits they use."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _MATERIALIZED:
        out = build()
        _MATERIALIZED[k] = tuple(map(_store, out)) if isinstance(out, tuple) else _store(out)
    return _MATERIALIZED[k]


def _store(df: DataFrame) -> DataFrame:
    return stored(df, "table", "split" if "split" in df.columns and len(df.columns) > 1 else None)


def split_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on the consolidated tickets: adds ``split``.  Written once per
    application, like the train/val/test files of the pipeline."""
    return materialized(spark, ("split_tickets", sf_dir), lambda: stratified_split(
        tickets(spark, sf_dir), "category_id", "ticket_id", K.SPLIT_RATIOS, K.SPLIT_SEED))
