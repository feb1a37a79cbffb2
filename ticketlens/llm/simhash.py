"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i of a fingerprint has a non-zero vector m(i) of r + 1 bits.
For each non-zero v, the mask of v keeps the positions with m(i).v odd.  Any r
positions span fewer than r + 1 dimensions, so some v is orthogonal to all of
them: fingerprints that differ in at most r bits agree under the mask of v and
meet in its table.  No pair within the radius is lost, whatever the data.

A bucket with many distinct fingerprints is split by the same construction
over the bits that its mask leaves open (again without losing a pair); after
three splits a bucket holds at most a few dozen values.

Null texts and texts without words have fingerprint zero and link like any
other.  Rows with a null id keep their fingerprint; the component's id is the
smallest non-null one.  Repeated rows share fingerprint and component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import map_text, read, written
from ticketlens.llm.components import connected_components

#: A bucket with more distinct fingerprints than this is split again.
BUCKET = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the word shingles."""
    import xxhash
    ws = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space alone
    if not ws:
        return 0
    flat, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return digest(flat, 42)
    starts = np.zeros(len(ws) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1, out=starts[1:])
    hashes = np.array([digest(flat[s:e], 42) for s, e in
                       zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the text by default) plus ``fp``, the 64 bits as a long."""
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def make():
        def fn(texts):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            return [pa.array(fps.view(np.int64))]
        return fn

    return map_text(df, keep, text, [("fp", "long")], make)


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit positions, one for each non-zero v."""
    n = (1 << radius + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if (1 + i % n & v).bit_count() % 2) for v in range(1, n + 1)]


def mask_levels(radius: int, levels: int = 3) -> list[list[int]]:
    """Masks per level; those of parent k at the next level are k * n ... k * n + n - 1."""
    out = [covering_masks(radius, list(range(64)))]
    for _ in range(levels - 1):
        out.append([parent | m for parent in out[-1]
                    for m in covering_masks(radius, [b for b in range(64) if not parent >> b & 1])])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(radius: int):
    """Links inside one bucket, as a spanning forest: at most one per value."""
    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0).to_pylist():
                if len(fps) == 2:
                    if ((fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= radius:
                        a.append(min(fps))
                        b.append(max(fps))
                    continue
                left = np.sort(np.array(fps, dtype=np.int64))
                while len(left):
                    todo, left = [left[0]], left[1:]
                    while todo and len(left):
                        x = todo.pop()
                        near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
                        if near.any():
                            hit = left[near]
                            left = left[~near]
                            a += [int(x)] * len(hit)
                            b += hit.tolist()
                            todo += list(hit)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def links(values: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that join the distinct ``fp`` values within the radius:
    a spanning forest of each bucket, so the components are exact."""
    levels = mask_levels(radius)
    rows = values.select("fp").select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in levels[0]])))
    rows = rows.select("fp", F.col("pos").alias("mask"), F.col("fp").bitwiseAND(F.col("col")).alias("key"))
    parts = []
    for level, masks in enumerate(levels):
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = written(rows.join(sizes, ["mask", "key"]), "buckets")
        last = level == len(levels) - 1
        small = rows if last else rows.where(F.col("n") <= BUCKET)
        parts.append(small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
                     .mapInArrow(_spanning(radius), "a long, b long"))
        big = rows.where(F.col("n") > BUCKET)
        if last or big.isEmpty():
            break
        n = len(levels[0])
        nxt = F.array(*[F.lit(_signed(m)) for m in levels[level + 1]])
        rows = (big.withColumn("sub", F.explode(F.sequence(F.col("mask") * n, F.col("mask") * n + (n - 1))))
                .select("fp", F.col("sub").alias("mask"),
                        F.col("fp").bitwiseAND(F.element_at(nxt, F.col("sub") + 1)).alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
                    keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id by default) plus ``fp``, ``group_fp`` (the
    smallest fingerprint of the component) and ``component_id``: the smallest
    id that can be reached by links of at most ``radius`` bits."""
    keep = keep or [doc_id]
    docs = written(fingerprints(df, text, shingle, keep), "fingerprints")
    values = written(docs.groupBy("fp").agg(F.min(doc_id).alias("first")), "values")
    roots = connected_components(links(values, radius)).select(F.col("node").alias("fp"), F.col("root").alias("group_fp"))
    values = values.join(roots, "fp", "left").withColumn("group_fp", F.coalesce("group_fp", "fp"))
    firsts = values.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    ids = values.join(firsts, "group_fp").select("fp", "group_fp", "component_id")
    return docs.join(ids, "fp").select(*keep, "fp", "group_fp", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component the row with
    the smallest id stays (null ids last; of rows that repeat it, one)."""
    keyed = df.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("t"),
                      F.col(f"`{text}`").alias("x"))
    found = near_duplicates(keyed, "id", "x", shingle, radius, ["id", "t"])
    alike = found.groupBy("group_fp", "id", "t").agg(F.count(F.lit(1)).alias("n"))
    stay = alike.groupBy("group_fp").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "t", "n")).alias("f"))
    stay = written(stay.select(F.col("f.id").alias("__i"), F.col("f.t").alias("__t"), F.col("f.n").alias("__n")), "stay")
    here = (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("__t")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("__i"))
    out = df.join(stay, here)
    if not stay.where("__n > 1").isEmpty():
        out = out.dropDuplicates(["__t", "__i"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
