"""MinHash near-duplicates by min-max hashing.

A document's set are its distinct word shingles (the whole sequence, if it has
fewer words).  Documents with the same words are one item, found by a 128-bit
digest.  Each hash function over the shingles gives two values of the signature,
its least and its greatest, so half the evaluations make a signature of the same
length; either value is equal for two sets with the chance of their Jaccard
similarity, and they vary against each other, so their mean varies less.  Four
values make a band, and the bands are as many as find a pair at the limit with
the wanted recall.  What shares a band is verified on the full sets and linked
(see ``linking``); classes are the components of the links.

Null texts and texts without words have the empty set and link with nothing, not
even with each other.  Rows with a null id take part; the class is named by its
smallest non-null id, and a row is kept if its id is that name (null equals null,
so a class without any id keeps all its rows).  Rows that repeat an id are kept or
go together, unless their texts differ.  No row gives no row; other columns are
not read.  Long texts are one set, whatever their length.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import linking
from ticketlens.llm.common import Steps, arrow, read, slices

SHINGLE, PERCENT, ROWS = 4, 80, 4
_U = np.uint64
_FACTORS = np.random.default_rng(47).integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)


class WordHashes(dict):
    """word -> 64-bit hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of ``k`` words."""
    n = len(h) - k + 1
    s = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        s += h[j:j + n] * _FACTORS[j]
    return linking.mix(s)


def shingle_set(words: list[bytes], shingle: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingles, sorted; none for no word."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.unique(windows(h, min(shingle, len(h)))) if len(h) else h


_ITEMS = "row long, doc_id long, key binary, n long, bands array<long>"


def _signatures(shingle: int, bands: int, rows: int):
    """(row, doc_id, text) -> row, doc_id, digest of the words, size of the set, bands."""
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for a, b in slices(batch.column(2), 2 << 20):
                part = batch.slice(a, b - a)
                words = [(t or "").encode().lower().split() for t in part.column(2).to_pylist()]
                sets = [shingle_set(ws, shingle, hashes) for ws in words]
                values: list = [[] for _ in sets]
                full = [i for i, ws in enumerate(words) if len(ws) >= shingle]  # a shorter one is alike to its copies only
                if full:
                    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
                    found = linking.min_max_bands(np.concatenate([sets[i] for i in full]), starts, bands, rows)
                    for i, v in zip(full, found.view(np.int64).tolist()):
                        values[i] = v
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([md5(b" ".join(ws)).digest() for ws in words], pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(values, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "key", "n", "bands"])
    return run


def _sets(shingle: int):
    """(text, key) -> key and its set."""
    def run(batches):
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for a, b in slices(batch.column(0), 2 << 20):
                keys, sets = [], []
                for text, key in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))):
                    ws = text.encode().lower().split()
                    if key in seen or md5(b" ".join(ws)).digest() != key:  # a repeated row, or another text of the same hash and id
                        continue
                    if len(seen) > 10_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    sets.append(shingle_set(ws, shingle, hashes).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), values)], names=["key", "set"])
    return run


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, rows: int = ROWS, recall: float = linking.RECALL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, for links of
    ``100 * intersection >= percent * union``; written to the shared folder."""
    spark = df.sparkSession
    docs = df.select(F.xxhash64(F.col(f"`{text}`").cast("string")).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    with Steps(spark) as keep:
        found = keep(arrow(docs, _signatures(shingle, linking.bands_for(percent, rows, recall), rows), _ITEMS), "signatures")
        place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
        items = keep(found.where("n > 0").groupBy("key").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("size"),
            F.first("bands").alias("bands")), "items")

        def sets_of(keys):
            wanted = items.join(keys, "key").select("key", F.col("first.row").alias("__r"), F.col("first.doc_id").alias("__d"))
            here = (F.col("row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d"))
            return arrow(docs.join(wanted, here).select("text", "key"), _sets(shingle), "key binary, set array<long>")

        linked = linking.links(items.select("key", "size", "bands"), sets_of, percent, keep)
        roots = linking.connected_components(linked, keep=keep).withColumnRenamed("node", "key")
        whole = items.select("key", "first", "copies").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        groups = (whole.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
                  .select("root", F.col("first.doc_id").alias("component_id")))
        # a text that most documents share is met by 16 tasks
        named = (whole.select("key", "root").join(groups, "root").withColumn("grouped", F.lit(True))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).drop("root"))
        out = (found.select("doc_id", "n", "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
               .join(named, ["key", "salt"], "left"))
        name = F.when(F.col("grouped") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"),
                         F.col("doc_id").eqNullSafe(name).alias("kept"))
        return keep.spare(keep(out, "near-duplicates"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN []
                          WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) END AS sh
      FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m
         FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
              AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * m >= 80 * (na + nb - m)),
edges AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, k.b FROM reach r JOIN edges k ON r.b = k.a),
lowest AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT s.doc_id, len(sh) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(low, s.doc_id) AS kept
FROM s LEFT JOIN lowest USING (doc_id)
"""
