"""Joins with a lookup table whose size comes from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import stored

#: A lookup table is broadcast up to this many bytes, as counted, and joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20


def lookup(rows: DataFrame, table: DataFrame, on: str, how: str = "left", limit: int | None = None, salts: int = 16) -> DataFrame:
    """``rows`` and the columns of ``table`` (unique in ``on``).  A key that is a
    third of all rows is met by many tasks either way: by broadcast, or in
    ``salts`` parts, for each of which the table is repeated."""
    table = stored(table, "lookup")
    size = sum((F.octet_length(F.col(f"`{c}`").cast("string")) for c in table.columns), F.lit(16 * len(table.columns)))
    bytes_ = table.agg(F.sum(F.coalesce(size, F.lit(256)))).first()[0] or 0
    if bytes_ <= (BROADCAST_BYTES if limit is None else limit):
        return rows.join(F.broadcast(table), on, how)
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
            .join(spread, [on, "_salt"], how).drop("_salt"))
