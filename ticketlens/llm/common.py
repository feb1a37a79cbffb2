"""Shared helpers of the training-data operators.

All text work runs in Arrow batches inside Spark tasks.  Batches are cut by
bytes of text, not by rows, so one very long document never drags thousands
of others into the same Python buffer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import shared_dir, ship

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` for which the executors have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array holding at most ``limit`` bytes each (or one row)."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size.astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def map_text(df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, str]],
             make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``keep`` columns of ``df`` plus new columns computed from ``text``.

    ``make()`` runs once per task and returns ``fn(texts) -> [values per
    field]``.  A kept column whose name equals a new one is replaced by it; the
    text itself may be kept too.
    """
    names = [n for n, _ in fields]
    keep = [c for c in keep if c not in names]
    source = F.col(f"`{text}`").cast("string")
    narrow = df.select(*[source.alias(c) if c == text else F.col(f"`{c}`") for c in keep],
                       *([] if text in keep else [source.alias("__text")]))
    at = keep.index(text) if text in keep else len(keep)
    new = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([*narrow.schema.fields[:len(keep)], *new.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        types = [to_arrow_type(f.dataType) for f in new.fields]
        fn = make()
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                cols = [part.column(i) for i in range(len(keep))]
                made = fn(part.column(at).to_pylist())
                cols += [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return arrow(narrow, run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    is cut, later reads prune columns and survive lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


class Steps:
    """Tables written on the way to one result, dropped once that is written.

    ``keep(df, name)`` is ``written(df, name)``; leaving the block (or ``drop``)
    deletes all tables but the frames given to ``spare``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.paths.append(out.table_path)
        return out

    def spare(self, df: DataFrame) -> DataFrame:
        self.paths.remove(df.table_path)
        return df

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables of the frames, or all that are left."""
        for path in [f.table_path for f in frames] or self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = [p for p in self.paths if frames and p not in {f.table_path for f in frames}]
        self.spark._jvm.System.gc()  # Spark deletes the shuffle files of plans that nothing refers to

    def __enter__(self) -> "Steps":
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def tasks(spark: SparkSession) -> int:
    """Partitions for an exchange, as the session says."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def uniform(column, seed: int):
    """A number in [0, 1) from a column's hash: the same on every run and machine."""
    return (F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11)).cast("double") / F.lit(float(1 << 53))


def crc_mod(column, m: int):
    """crc32 of the id as text, modulo ``m``: the folds of the contracts."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(m)


def bounded_sample(df: DataFrame, row_id: str, by: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows ``(row_id, by)``, as evenly over the values of ``by``
    as they allow, picked by a hash of the id (so the same ones every time).
    Rows with a null in either column are left out."""
    rows = df.select(F.col(row_id), F.col(by)).where(F.col(row_id).isNotNull() & F.col(by).isNotNull())
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    order = F.lit(0.0)
    for value, count in counts.items():
        order = F.when(F.col(by) == F.lit(value), uniform(F.col(row_id), seed) * float(count)).otherwise(order)
    # a class has about x rows with order below x: few enough rows are sorted
    picked = rows.withColumn("__o", order).where(F.col("__o") < 2.0 * n)
    return picked.orderBy("__o", row_id).limit(n).select(row_id, by)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, fold, n: int, seed: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, y)``: at most ``n`` labelled documents of the ``fold``
    (a condition on the id), written to the shared folder.  A repeated id counts once."""
    picked = bounded_sample(labels.where(fold), doc_id, column, n, seed).dropDuplicates([doc_id])
    picked = F.broadcast(picked.select(F.col(doc_id), F.col(column).alias("y")))  # n rows at most
    rows = docs.select(doc_id, F.col(text).alias("text")).join(picked, doc_id).limit(n)
    return written(rows, "labelled")
