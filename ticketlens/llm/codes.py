"""Vector code compression: product codes by slice-and-intersect bitmasks.

Vectors are cut into equal parts and each part is replaced by the index of the
nearest entry of its codebook, which a few rounds of averaging have fitted.  The
nearest entry is found without measuring all of them:

* Each dimension of a codebook keeps its coordinates sorted, and for every prefix
  of that order a uint64 mask of the entries in it.
* The distance to one entry, which has the nearest coordinate in the dimension
  where the book is widest, gives an initial radius: the nearest entry differs by
  no more in any dimension.
* Two binary searches a dimension give the slice of entries within the radius,
  two prefix masks its bits; the bits of all dimensions are ANDed.  What is left
  holds the nearest entry for certain, and only that is measured.

A round is one pass of the table: each task sums its vectors per part and entry,
Spark adds these sums, and the driver keeps the books (parts x entries vectors),
whatever the number of vectors.

Vectors that are null or hold null or non-finite components are dropped, and so
are those whose length is not a multiple of the parts, or not that of the vector
with the smallest id.  All others count and come back, rows with a null id (after
all ids in the order) and repeated rows too; equal ids are ordered by their
vectors.  With fewer vectors than entries, the books are as short as that.
Components whose floor lies beyond 2^27 count as 2^27, so that every distance fits
a long.  No vector gives no row.  Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import arrow, read, tasks, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096.0, 8, 16, 6
LIMIT = 1 << 27
#: Totals of labels are broadcast up to this many bytes, and joined beyond.
BROADCAST_BYTES = 4 << 20
_U = np.uint64
#: Vectors coded at once.
_AT_ONCE = 8192


def vectors_of(column: pa.ListArray, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and floor(scale * vector) of the vectors of length ``dim`` that take part."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    good = np.isfinite(x).all(axis=1)  # a null component reads as not a number
    with np.errstate(over="ignore"):
        return rows[good], np.clip(np.floor(scale * x[good]), -LIMIT, LIMIT).astype(np.int64)


class Slices:
    """One codebook of at most 64 entries: sorted coordinates and prefix masks."""

    def __init__(self, book: np.ndarray):
        n, self.dim = book.shape
        if n > 64:
            raise ValueError("a mask holds 64 entries")
        order = np.argsort(book, axis=0, kind="stable")
        self.book, self.order = book, order
        self.coordinates = np.ascontiguousarray(np.take_along_axis(book, order, axis=0).T)
        bits = np.bitwise_or.accumulate(_U(1) << order.astype(_U), axis=0)
        self.prefix = np.ascontiguousarray(np.concatenate([np.zeros((1, self.dim), _U), bits]).T)
        self.widest = int((self.coordinates[:, -1] - self.coordinates[:, 0]).argmax())

    def radius(self, x: np.ndarray) -> np.ndarray:
        """No less than the distance to the nearest entry."""
        line, along = self.coordinates[self.widest], x[:, self.widest]
        at = np.clip(np.searchsorted(line, along), 1, max(len(line) - 1, 1))
        at = np.minimum(at, len(line) - 1)
        before = np.maximum(at - 1, 0)
        guess = np.where(along - line[before] <= line[at] - along, before, at)
        off = x - self.book[self.order[guess, self.widest]]
        return np.sqrt((off * off).sum(axis=1).astype(np.float64)).astype(np.int64) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Mask of the entries within the radius in every dimension."""
        r, mask = self.radius(x), np.full(len(x), 0xFFFFFFFFFFFFFFFF, _U)
        for line, prefix, along in zip(self.coordinates, self.prefix, x.T):
            low = np.searchsorted(line, along - r)
            high = np.searchsorted(line, along + r, side="right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (the first of equally near ones) and squared distance."""
        held = self.candidates(x)[:, None] >> np.arange(len(self.book), dtype=_U) & _U(1)
        rows, entries = np.nonzero(held)
        off = x[rows] - self.book[entries]
        d = (off * off).sum(axis=1)
        starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1]) if len(rows) else rows
        least = np.minimum.reduceat(d, starts) if len(rows) else d
        hits = np.flatnonzero(d == least[rows])
        first = hits[np.concatenate([[True], rows[hits[1:]] != rows[hits[:-1]]])] if len(hits) else hits
        return entries[first], least


def _coded(slices: list[Slices], x: np.ndarray):
    """Blocks (vectors by part, entries, squared distances) of the vectors."""
    for at in range(0, len(x), _AT_ONCE):
        v = x[at:at + _AT_ONCE].reshape(-1, len(slices), slices[0].dim)
        found = [s.nearest(np.ascontiguousarray(v[:, p])) for p, s in enumerate(slices)]
        yield at, v, [f[0] for f in found], [f[1] for f in found]


def _seeds(parts: int, entries: int, scale: float):
    """(id, vector) -> the rows of a task that may begin a codebook: of each length the ``entries`` first."""
    def run(batches):
        best: dict[int, list] = {}
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for dim in pc.unique(pc.list_value_length(column)).drop_null().to_pylist():
                if dim == 0 or dim % parts:
                    continue
                rows, x = vectors_of(column, dim, scale)
                mine = ids.take(pa.array(rows))
                order = pc.sort_indices(mine, null_placement="at_end").to_numpy()
                if len(order) > entries:  # ties at the border stay
                    edge = mine[int(order[entries - 1])]
                    order = np.flatnonzero(pc.less_equal(mine, edge).fill_null(False)) if edge.is_valid else order
                rest = [(i is None, i or 0, v.tolist()) for i, v in zip(mine.take(pa.array(order)).to_pylist(), x[order])]
                best[dim] = sorted(best.get(dim, []) + rest)[:entries]
        out = [(None if z else i, v) for rows in best.values() for z, i, v in rows]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()),
                                          pa.array([v for _, v in out], pa.list_(pa.int64()))], names=["id", "v"])
    return run


def _sums(books: np.ndarray, scale: float):
    """(id, vector) -> per part and entry the number and the sum of a task's vectors."""
    parts, entries, d = books.shape

    def run(batches):
        slices = [Slices(b) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in batches:
            for _, v, found, _ in _coded(slices, vectors_of(batch.column(1), parts * d, scale)[1]):
                for p, e in enumerate(found):
                    order = np.argsort(e, kind="stable")
                    used, starts = np.unique(e[order], return_index=True)
                    n[p, used] += np.diff(np.append(starts, len(e)))
                    total[p, used] += np.add.reduceat(v[order, p], starts, axis=0)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]),
                                          pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])
    return run


def _codes(books: np.ndarray, scale: float):
    """(id, vector, label) -> id, label, code in hex and error."""
    parts, _, d = books.shape

    def run(batches):
        slices = [Slices(b) for b in books]
        for batch in batches:
            rows, x = vectors_of(batch.column(1), parts * d, scale)
            code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for at, v, found, far in _coded(slices, x):
                code[at:at + len(v)] = np.stack(found, axis=1)
                error[at:at + len(v)] = np.sum(far, axis=0)
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows),
                                              pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                                             names=["id", "label", "code", "error"])
    return run


def _rows(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))


def codebooks(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS,
              entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> np.ndarray | None:
    """Fitted books, ``parts x entries x dimensions of a part``; None without a vector."""
    rows = _rows(df, vec_id, embedding).where("v is not null")
    seeds = written(arrow(rows, _seeds(parts, entries, scale), "id long, v array<long>"), "seeds")
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = seeds.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dim = len(first[0]["v"])
    start = seeds.where(F.size("v") == dim).orderBy(*order).limit(entries).collect()
    books = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), parts, dim // parts).swapaxes(0, 1)
    for _ in range(rounds):
        sums = arrow(rows, _sums(books, scale), "p int, e int, n long, s array<long>")
        each = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(books.shape[2])]
        books = books.copy()
        for r in sums.groupBy("p", "e").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows
            books[r["p"], r["e"]] = [int(r[f"s{j}"]) // r["n"] for j in range(books.shape[2])]
    return books


def encode(df: DataFrame, books: np.ndarray | None, vec_id: str = "vec_id", embedding: str = "embedding",
           label: str = "label", scale: float = SCALE) -> DataFrame:
    """``id, label, code, error`` of every vector that takes part."""
    narrow = df.select(*[F.col(f"`{c}`").alias(a) for c, a in ((vec_id, "id"), (embedding, "v"), (label, "label"))])
    narrow = narrow.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), "label").where("v is not null")
    kind = narrow.schema["label"].dataType
    schema = f"id long, label {kind.simpleString()}, code string, error long"
    if books is None:
        return narrow.where("false").selectExpr("id", "label", "'' as code", "0L as error")
    return arrow(narrow, _codes(books, scale), schema)


def with_totals(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``rows`` and the sum of ``value`` over their value of ``by`` (nulls are
    one).  A value that most rows share is met by every task on its own."""
    totals = written(rows.groupBy(by).agg(F.sum(value).alias(out)).withColumnRenamed(by, "__by"), "totals")
    size = totals.agg(F.sum(F.coalesce(F.length(F.col("__by").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    same = F.col(by).eqNullSafe(F.col("__by"))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(totals), same).drop("__by")
    n = min(32, tasks(rows.sparkSession))
    salted = totals.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return (rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int"))
            .join(salted, same & (F.col("__s") == F.col("__t"))).drop("__by", "__s", "__t"))


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and position."""
    return sha256(",".join(map(str, books.ravel().tolist() if books is not None else ())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    books = codebooks(df)
    rows = with_totals(written(encode(df, books), "codes"), "label", "error", "label_error")
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                       F.lit(digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    ctes = [f"""
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // {PARTS} AS w, embedding
     FROM embeddings
     WHERE embedding IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
x AS MATERIALIZED (SELECT r, CAST((j - 1) // w AS INTEGER) AS p, CAST((j - 1) % w AS INTEGER) AS j,
            CAST(floor({SCALE} * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x
     FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS j FROM v)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, j, x AS c FROM x WHERE r <= {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        ctes.append(f"""
a{i} AS MATERIALIZED (SELECT r, p, k, d FROM (
       SELECT r, p, k, d, row_number() OVER (PARTITION BY r, p ORDER BY d, k) AS n
       FROM (SELECT r, p, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{i} USING (p, j) GROUP BY r, p, k))
     WHERE n = 1)""")
        if i < ROUNDS:
            ctes.append(f"""
m{i} AS (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (r, p) GROUP BY p, k, j),
b{i + 1} AS MATERIALIZED (SELECT p, k, j, coalesce((s - ((s % n) + n) % n) // n, c) AS c
     FROM b{i} LEFT JOIN m{i} USING (p, k, j))""")
    ctes.append(f"""
e AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a{ROUNDS} GROUP BY r)""")
    return f"""WITH {",".join(ctes)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN e USING (r)
"""


OP12_SQL = _op12_sql()
