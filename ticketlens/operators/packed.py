"""Term weights with a row a document (I2, I8, E7): sums over them without moving them.

A packed table has ``indices`` and ``values`` arrays a row.  Scores are made where the row lies; sums per term and class leave a
task as at most a row a term of the bounded vocabulary.  The coefficients, a row a
term, are on the driver and go to the tasks with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators.joins import lookup
from ticketlens.session import ship

#: Entries worked on at once in a task (or one row).
_ENTRIES = 1 << 19


def is_packed(weights: DataFrame) -> bool:
    return "indices" in weights.columns


def chunks(lengths: np.ndarray, most: int):
    """Row ranges of at most ``most`` elements each (or one row)."""
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, stop
        at = stop


def _parts(batches):
    """(rows, index and value of their entries, entries a row), some rows at a time."""
    for batch in batches:
        idx, val = batch.column("indices"), batch.column("values")
        lengths = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in chunks(lengths, _ENTRIES):
            yield (batch.slice(a, b - a), idx.slice(a, b - a).flatten().to_numpy(zero_copy_only=False),
                   val.slice(a, b - a).flatten().to_numpy(zero_copy_only=False), lengths[a:b])


def _scores(idx, val, lengths, coef: np.ndarray) -> np.ndarray:
    """A row's score per class; ``coef`` is (class, term)."""
    out, some = np.zeros((len(lengths), len(coef))), lengths > 0
    starts = (np.cumsum(lengths) - lengths)[some]
    if len(starts):
        for c, w in enumerate(coef):
            out[some, c] = np.add.reduceat(w[idx] * val, starts)
    return out


def scored(rows: DataFrame, coef: np.ndarray, id_col: str) -> DataFrame:
    """``(id, scores)``, summed over the rows of an id."""
    ship(rows.sparkSession)
    k = len(coef)

    def run(batches):
        for part, idx, val, lengths in _parts(batches):
            s = _scores(idx, val, lengths, coef)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(s[:, c]) for c in range(k)]],
                                             names=[id_col, *[f"_s{c}" for c in range(k)]])

    fields = [rows.schema[id_col], *[T.StructField(f"_s{c}", T.DoubleType()) for c in range(k)]]
    each = rows.select(id_col, "indices", "values").mapInArrow(run, T.StructType(fields))
    total = each.groupBy(id_col).agg(*[F.sum(f"_s{c}").alias(f"_s{c}") for c in range(k)])
    return total.select(id_col, F.array(*[F.col(f"_s{c}") for c in range(k)]).alias("scores"))


def one_hot(label, num_classes: int) -> Column:
    """``marks`` of a row: how often it counts as one of each class."""
    return F.array(*[F.when(F.col(label) == c, 1.0).otherwise(0.0) for c in range(num_classes)])


def with_marks(rows: DataFrame, id_col: str, label_col: str, num_classes: int, part: Column, squared: bool = False) -> DataFrame:
    """``(id, indices, values, marks)`` of the ids with a row in ``part``, as joins by
    id give them: rows that repeat an id are one with all their entries, and each of
    its labels in ``part`` counts (``squared``: as often as the id comes there).

    Rows carry their label, so only repeated ids are looked up."""
    rows = rows.where(F.col(id_col).isNotNull()).withColumn("_in", F.coalesce(part, F.lit(False)).cast("int"))
    hot = [F.when((F.col(label_col) == c) & (F.col("_in") == 1), 1.0).otherwise(0.0) for c in range(num_classes)]
    per = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.sum("_in").alias("_t"), *[F.sum(h).alias(f"_m{c}") for c, h in enumerate(hot)])
    times = F.col("_t") if squared else F.lit(1)
    per = per.where("_n > 1").select(id_col, "_t", F.array(*[F.col(f"_m{c}") * times for c in range(num_classes)]).alias("marks"))
    found = lookup(rows.select(id_col, "indices", "values", "_in", one_hot(label_col, num_classes).alias("_own")), per, id_col)
    own = found.where("_t IS NULL AND _in = 1").select(id_col, "indices", "values", F.col("_own").alias("marks"))
    more = found.where("_t > 0").groupBy(id_col).agg(F.flatten(F.collect_list("indices")).alias("indices"),
                                                     F.flatten(F.collect_list("values")).alias("values"), F.first("marks").alias("marks"))
    return own.unionByName(more)


def class_sums(rows: DataFrame, num_features: int, num_classes: int, coef: np.ndarray | None = None) -> np.ndarray:
    """The sums (class, term) over the rows of value times mark: without ``coef`` of the
    marks themselves; with it of softmax less marks, which is the gradient."""
    ship(rows.sparkSession)
    m, k = num_features, num_classes

    def run(batches):
        total = np.zeros((k, m))
        for part, idx, val, lengths in _parts(batches):
            marks = part.column("marks").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if coef is not None:
                s = _scores(idx, val, lengths, coef)
                e = np.exp(s - s.max(axis=1, keepdims=True))
                marks = marks.sum(axis=1, keepdims=True) * e / e.sum(axis=1, keepdims=True) - marks
            for c in range(k):
                total[c] += np.bincount(idx, val * np.repeat(marks[:, c], lengths), minlength=m)
        here = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), *[pa.array(t[here]) for t in total]],
                                         names=["feature", *[f"_g{c}" for c in range(k)]])

    schema = "feature int, " + ", ".join(f"_g{c} double" for c in range(k))
    each = rows.select("indices", "values", "marks").mapInArrow(run, schema)
    sums = each.groupBy("feature").agg(*[F.sum(f"_g{c}").alias(f"_g{c}") for c in range(k)]).toArrow()
    out, at = np.zeros((k, m)), sums.column("feature").to_numpy()  # a row a term of the vocabulary
    for c in range(k):
        out[c, at] = sums.column(f"_g{c}").to_numpy()
    return out
