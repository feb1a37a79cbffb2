"""Corpus profiling.

Aggregations rely on map-side partial aggregation, so a hot value (one
label or word holding a third of all rows) is combined inside every map
task before the shuffle.  Top-k uses ``orderBy().limit()`` (a per-partition
top-k merged on one task, k rows each); first-n-per-group uses a
``row_number() <= n`` filter, which Spark turns into a WindowGroupLimit
that trims each group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions import text as H

R = 6


def value_counts(df: DataFrame, col: str, count_col: str = "n") -> DataFrame:
    """Rows per value (order with ``.orderBy(F.desc(count_col), col)``)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))


def with_share(counts: DataFrame, count_col: str = "n", out_col: str = "pct") -> DataFrame:
    """D3: percent of the total; the global window runs over the (small) count table."""
    return counts.withColumn(out_col, F.round(F.col(count_col) * 100.0 /
                                              F.sum(count_col).over(Window.partitionBy()), R))


def class_imbalance(df: DataFrame, label_col: str) -> DataFrame:
    """Largest and smallest class (ties: smallest name) and their ratio."""
    c = value_counts(df, label_col)
    big = F.min_by(F.col(label_col), F.struct(-F.col("n"), F.col(label_col)))
    small = F.min_by(F.col(label_col), F.struct(F.col("n"), F.col(label_col)))
    return c.agg(big.alias("largest_label"), F.max("n").alias("largest_n"),
                 small.alias("smallest_label"), F.min("n").alias("smallest_n"),
                 F.round(F.max("n") / F.min("n"), R).alias("imbalance_ratio"))


def length_stats(df: DataFrame, value_col: str, group_cols=(), approx: bool = False) -> DataFrame:
    """Mean, median, min, max and 95th percentile of a numeric column.

    ``approx=True`` swaps the exact percentiles for ``percentile_approx``
    (bounded memory per group, for very high-cardinality values).
    """
    v = F.col(value_col)
    if approx:
        med, p95 = F.percentile_approx(v, 0.5, 10000), F.percentile_approx(v, 0.95, 10000)
    else:
        med, p95 = F.percentile(v, F.lit(0.5)), F.percentile(v, F.lit(0.95))
    return df.groupBy(*group_cols).agg(
        F.round(F.avg(v), R).alias("mean"), F.round(med, R).alias("median"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.round(p95, R).alias("p95"))


def text_digest(c) -> Column:
    """16-byte MD5 digest of a text, as a compact grouping key for long texts
    (null stays null).  Two different texts share a digest with negligible
    probability (about n^2 / 2^129 for n distinct texts)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.md5(c))


def duplicate_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows beyond the first copy of each text (null counts as one value).

    Distinct texts are counted by digest, so the shuffle carries 16 bytes per
    distinct text instead of the text itself.
    """
    t = text_digest(text_col)
    distinct_incl_null = F.countDistinct(t) + F.when(F.count_if(t.isNull()) > 0, 1).otherwise(0)
    return (df.agg(F.count(F.lit(1)).alias("n_rows"), distinct_incl_null.alias("_d"))
              .withColumn("n_duplicates", F.col("n_rows") - F.col("_d"))
              .withColumn("duplicate_pct", F.round(F.col("n_duplicates") * 100.0 / F.col("n_rows"), R))
              .drop("_d"))


def quality_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Empty-after-strip and null counts."""
    return df.agg(F.count_if(H.strip(text_col) == F.lit("")).alias("n_empty"),
                  F.count_if(F.col(text_col).isNull()).alias("n_null"))


def word_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over lowered whitespace words."""
    w = df.select(F.explode(H.words(F.lower(text_col))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_summary(freq: DataFrame) -> DataFrame:
    """Total and unique words from a frequency table."""
    return freq.agg(F.sum("n").cast("long").alias("total_words"),
                    F.count(F.lit(1)).alias("unique_words"))


def top_k(counts: DataFrame, key: str, k: int, count_col: str = "n", largest: bool = True) -> DataFrame:
    """k largest (or smallest) counts, ties by key."""
    c = F.desc(count_col) if largest else F.asc(count_col)
    return counts.orderBy(c, F.asc(key)).limit(k)


def histogram(df: DataFrame, value_col: str, bins: int = 30, group_cols=()) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed.

    Edges come from one global aggregate used as a scalar subquery, so all
    groups share them; binning is a projection and counting is map-side
    combined.
    """
    v = F.col(value_col).cast("double")
    edges = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    edges = edges.select(F.struct(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi")))
    e = edges.scalar()
    x = df.select(*group_cols, v.alias("_x")).where(F.col("_x").isNotNull())
    j = x.withColumn("_lo", e["lo"]).withColumn("_hi", e["hi"])
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)).cast("int")
    j = j.withColumn("bin", b)
    out = j.groupBy(*group_cols, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*group_cols, "bin",
                      F.round(F.col("_lo") + F.col("bin") * width, R).alias("bin_start"),
                      F.round(F.col("_lo") + (F.col("bin") + 1) * width, R).alias("bin_end"), "n")


def first_rows_per_group(df: DataFrame, group_col: str, order_col: str, n: int,
                         first_groups: int | None = None) -> DataFrame:
    """First ``n`` rows of each group by ``order_col``; optionally only the
    first ``first_groups`` groups in order of appearance (by their first row)."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    out = df.withColumn("row_in_group", F.row_number().over(w)).filter(F.col("row_in_group") <= n)
    if first_groups:
        firsts = (df.groupBy(group_col).agg(F.min(order_col).alias("_first"))
                    .orderBy("_first", group_col).limit(first_groups))
        out = out.join(F.broadcast(firsts.select(group_col)), group_col, "left_semi")
    return out


def mark_duplicates(df: DataFrame, key_col: str, id_col: str, out_col: str = "is_duplicate",
                    digest: bool = True) -> DataFrame:
    """True for every row after the first (by id) with the same key.

    Uses a min-id aggregate joined back (null-safe), not a window over the
    key: a hot key is pre-combined map-side and the join-back is split by
    AQE's skew-join handling instead of landing in one task.  With
    ``digest`` the key is the text's 16-byte digest (see ``text_digest``).
    """
    key = text_digest(key_col) if digest else F.col(key_col)
    d = df.withColumn("_k", key)
    firsts = d.groupBy(F.col("_k").alias("_fk")).agg(F.min(id_col).alias("_first_id"))
    j = d.join(firsts, d["_k"].eqNullSafe(firsts["_fk"]), "inner").drop("_k", "_fk")
    return j.withColumn(out_col, F.col(id_col) > F.col("_first_id")).drop("_first_id")


def count_if_share(df: DataFrame, cond: Column, name: str) -> DataFrame:
    """D10/D25/D26 building block: count and percent of rows meeting ``cond``."""
    return (df.agg(F.count_if(cond).alias(f"n_{name}"), F.count(F.lit(1)).alias("n_rows"))
              .withColumn(f"{name}_pct", F.round(F.col(f"n_{name}") * 100.0 / F.col("n_rows"), R)))
