"""File sources and sinks (A5-A7, A11, A14): CSV with header, label-mapping
dimension as JSON, parquet tables.

Schemas are always explicit (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import constants as K

TICKET_CSV_SCHEMA = ("text string, label_name string, category string, category_id int, "
                     "priority string, priority_id int")
MAPPING_SCHEMA = "kind string, id int, name string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, csv_only: bool = True,
             multi_line: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """A5 + A11 by Spark's reader: CSV with a header row; only ``*.csv`` files are
    picked up from a folder.  Without a schema every column is a string.  With
    ``multi_line`` a file is one task and, in FAILFAST mode, a bad row ends the
    job: ``csv_records.read_csv_rejecting`` reads by splits and sets such rows apart."""
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
         .option("mode", mode))
    if csv_only:
        r = r.option("pathGlobFilter", "*.csv")
    if schema:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """CSV with header, no index; optionally one folder per split."""
    w = df.write.mode(mode).option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def label_mappings(spark: SparkSession, categories=K.CATEGORIES, priorities=K.PRIORITIES) -> DataFrame:
    """The mapping as one dimension table ``(kind, id, name)`` -- both
    directions are joins on it (name -> id, id -> name)."""
    rows = [("category", i, c) for i, c in enumerate(categories)] + \
           [("priority", i, p) for i, p in enumerate(priorities)]
    return spark.createDataFrame(rows, MAPPING_SCHEMA)


def write_mappings(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # a handful of rows


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPING_SCHEMA).json(path)


def mapping_as_maps(mappings: DataFrame) -> DataFrame:
    """The four maps of the JSON mapping file as MapType columns (one row)."""
    agg = []
    for kind in ("category", "priority"):
        entries = F.filter(F.collect_list(F.struct("kind", "id", "name")), lambda e: e["kind"] == kind)
        agg += [F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["id"])))
                .alias(f"{kind}_to_id"),
                F.map_from_entries(F.transform(entries, lambda e: F.struct(e["id"].cast("string"), e["name"])))
                .alias(f"id_to_{kind}")]
    return mappings.agg(*agg)


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
