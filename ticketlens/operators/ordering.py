"""Positions in a global order without a global window.

Rows are range-partitioned by the order, so partition i holds what comes before
partition i + 1, and sorted inside; a value that most rows share is spread over
partitions by the further columns of the order.  The driver adds up one number a
partition; inside, a row's place is its count from the partition's first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import stored

_LOW = 33  # monotonically_increasing_id: the partition above these bits, the place in it below


def in_ranges(df: DataFrame, order: list[Column], name: str = "ordered") -> DataFrame:
    """``df`` stored in order, with ``_part`` (int, rising with the order) and
    ``_place`` (long, from 0 in each part)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_id", _LOW).cast("int"))
    return stored(rows.withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << _LOW) - 1))).drop("_id"), name)


def ranked(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with the 1-based position of each row in the order (which should be
    total, so that reruns agree)."""
    rows = in_ranges(df, order)
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0  # a row a partition, as many as the driver plans tasks
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return (rows.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_place") + 1)
            .drop("_part", "_place", "_before"))
