"""Substring dedup: repeated paragraphs by MinHash banding.

A paragraph is a line of at least ``min_words`` words (in lower case for A-Z).
Equal ones are found by a 128-bit digest and counted once from then on.  Each
distinct paragraph gets MinHash values over its five-word shingles, cut into
bands that are tuned so that a pair at the similarity limit is found with the
wanted recall.  Paragraphs that share a band are verified by exact Jaccard,
with centres first, then, where a bucket holds several components, what lies
outside the largest one against all others (see ``linking``).  No group is turned
into all its pairs, and a bucket with a third of all paragraphs is met by many
tasks.  Components of the links, over all occurrences, give the removals: the
first occurrence (by id, then place) stays.

Null and empty texts have no paragraph.  Rows with a null id take part and come
last in the order.  Rows that repeat both id and text count as occurrences, but
are one document: all of them keep or lose the same paragraphs.  Texts of any
length are cut into lines as a stream of slices.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import linking
from ticketlens.llm.common import Steps, arrow, slices
from ticketlens.llm.components import connected_components

MIN_WORDS, SHINGLE, SIMILARITY, RECALL = 20, 5, 0.8, 0.999
_U = np.uint64
_FACTORS = np.random.default_rng(31).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_ADDS = np.random.default_rng(32).integers(0, 1 << 63, 64, dtype=np.uint64)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, chance: float = 0.5) -> tuple[int, int]:
    """(bands, rows): the fewest rows a band for which a pair at half the
    similarity collides with at most ``chance``, and the bands that give the
    recall at the similarity itself."""
    rows = 1
    while True:
        bands = ceil(log(1 - recall) / log(1 - similarity ** rows))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= chance:
            return bands, rows
        rows += 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: a table of those seen costs more than hashing."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _mix_into(x: np.ndarray, y: np.ndarray) -> None:
    """``_mix`` in place, with ``y`` as room."""
    np.right_shift(x, _U(31), out=y)
    np.bitwise_xor(x, y, out=x)
    np.multiply(x, _U(0x9E3779B97F4A7C15), out=x)
    np.right_shift(x, _U(29), out=y)
    np.bitwise_xor(x, y, out=x)


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    s = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        s += h[j:j + n] * _FACTORS[63 - j]
    return _mix(s)


def minhash_bands(h: np.ndarray, begins: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit value per paragraph and band; paragraphs of at least SHINGLE
    words, in order, among the hashed words ``h``."""
    s = np.zeros(len(h) - SHINGLE + 2, dtype=np.uint64)  # one more, for the end of the last
    s[:-1] = _windows(h, SHINGLE)
    ranges = np.stack([begins, begins + sizes - SHINGLE + 1], axis=1).ravel()
    out = np.zeros((len(sizes), bands), dtype=np.uint64)
    x, y = np.empty_like(s), np.empty_like(s)  # used again: new ones cost more than the sums
    for band in range(bands):
        value = np.full(len(sizes), band, dtype=np.uint64)
        for row in range(rows):
            j = band * rows + row
            np.multiply(s, _FACTORS[j % 59], out=x)
            np.add(x, _ADDS[j], out=x)
            _mix_into(x, y)
            value = _mix(value * _FACTORS[62] + np.minimum.reduceat(x, ranges)[::2])
        out[:, band] = value
    return out


#: Words of the paragraphs whose sets a task gives out at once.
_TOGETHER = 1 << 17
_SCHEMA = ("row long, doc_id long, line int, start long, stop long, n_words long, key binary, bands array<long>, "
           "h array<long>, at array<int>")
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()),
          pa.list_(pa.int64()), pa.list_(pa.int32()))


def _units(min_words: int, bands: int, rows: int, anchors: Callable | None = None):
    """(row, doc_id, text) -> a row a paragraph and, if ``anchors`` finds them among
    the hashed words of several documents, a row (without ``key``) with the
    hashes and places of its anchors a document; texts are cut into words once."""
    least = max(min_words, 1)

    def batch_of(n: int, **cols) -> pa.RecordBatch:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, _TYPES)], names=names)

    def of_lines(h, found):
        size = np.array([f[5] for f in found])
        long = np.flatnonzero(size >= SHINGLE)
        begin = np.array([f[7] for f in found])
        values = np.zeros((len(long), bands), dtype=np.uint64)
        for at in range(0, len(long), 2000):
            some = long[at:at + 2000]
            a, b = begin[some[0]], begin[some[-1]] + size[some[-1]]
            values[at:at + 2000] = minhash_bands(h[a:b], begin[some] - a, size[some], bands, rows)
        ends = np.concatenate([[0], np.cumsum(size >= SHINGLE) * bands]).astype(np.int32)
        cols = list(zip(*found))
        names = ("row", "doc_id", "line", "start", "stop", "n_words", "key")
        return batch_of(len(found), **{c: pa.array(v, t) for c, v, t in zip(names, cols, _TYPES)},
                        bands=pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64).ravel())))

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), 2 << 20):
                part, found, hashed, n = batch.slice(a, b - a), [], [], 0
                for row, doc, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    at, words = 0, []
                    for i, line in enumerate(text.split("\n") if text else ()):
                        ws = line.encode().lower().split()
                        if len(ws) >= least:
                            found.append((row, doc, i, at, at + len(line), len(ws), md5(b" ".join(ws)).digest(), n + len(words)))
                        words += ws
                        at += len(line) + 1
                    hashed.append(word_hashes(words))
                    n += len(words)
                h = np.concatenate(hashed)
                if found:
                    yield of_lines(h, found)
                if anchors:
                    sizes = [len(x) for x in hashed]
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    at, v = anchors(h, doc)
                    of = doc[at]
                    ends = pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)).astype(np.int32))
                    starts = np.concatenate([[0], np.cumsum(sizes)])
                    out = batch_of(len(sizes), row=part.column(0), doc_id=part.column(1),
                                   h=pa.ListArray.from_arrays(ends, pa.array(v.view(np.int64))),
                                   at=pa.ListArray.from_arrays(ends, pa.array((at - starts[of]).astype(np.int32))))
                    yield out.filter(pa.array(np.diff(ends.to_numpy()) > 0))
    return run


def units(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, anchors: Callable | None = None) -> DataFrame:
    """What ``_units`` makes of ``docs`` (row, doc_id, text)."""
    return arrow(docs, _units(min_words, *tune(similarity), anchors), _SCHEMA)


def _sets(batches):
    """(text, [(line, key)]) -> key and the sorted distinct shingles of that line
    (fewer words than a shingle: the whole as one)."""
    def table(keys, words, sizes):
        h = word_hashes(words)
        s, sets, at = _windows(h, SHINGLE) if len(h) >= SHINGLE else None, [], 0
        for n in sizes:
            sets.append(np.unique(s[at:at + n - SHINGLE + 1] if n >= SHINGLE else _windows(h[at:at + n], n)).view(np.int64))
            at += n
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(
            ends, pa.array(np.concatenate(sets)))], names=["key", "set"])

    keys, words, sizes = [], [], []
    for batch in batches:
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = text.split("\n")
            for w in wanted:
                ws = lines[w["line"]].encode().lower().split() if w["line"] < len(lines) else []
                if md5(b" ".join(ws)).digest() == w["key"]:  # else another text of the same hash and id
                    keys.append(w["key"])
                    sizes.append(len(ws))
                    words += ws
            if len(words) > _TOGETHER:
                yield table(keys, words, sizes)
                keys, words, sizes = [], [], []
    if keys:
        yield table(keys, words, sizes)


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
             similarity: float = SIMILARITY, row: bool = False, found: DataFrame | None = None) -> DataFrame:
    """One row per occurrence of a paragraph that occurs twice or more, exactly
    or nearly: ``doc_id``, ``line`` (from 0), ``start`` and ``stop`` in
    characters, ``n_words``, ``kept_doc_id``, ``kept_line`` (the occurrence
    that stays), ``occurrences`` in its component and ``removed``; with ``row``
    also the hash of the text.  ``found`` may give the paragraphs, as ``units`` makes them."""
    docs = df.select(F.xxhash64(F.col(f"`{text}`").cast("string")).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    with Steps(df.sparkSession) as keep:
        found = keep(units(docs, min_words, similarity), "paragraphs") if found is None else found
        found = found.where("key is not null").drop("h", "at")
        place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "line")
        distinct = keep(found.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"),
                                                 F.first("n_words").alias("size")), "distinct")

        def sets_of(keys):
            wanted = (distinct.join(keys, "key").groupBy(F.col("first.row").alias("__r"), F.col("first.doc_id").alias("__d"))
                      .agg(F.collect_list(F.struct("first.line", "key")).alias("wanted")))
            here = (F.col("row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d"))
            return arrow(docs.join(wanted, here).select("text", "wanted"), _sets, "key binary, set array<long>")

        linked = linking.links(distinct.select("key", "size", "bands"), sets_of, round(100 * similarity), keep, exact_sizes=False)
        roots = connected_components(linked, keep=keep).withColumnRenamed("node", "key")
        # what occurs once and has no link repeats nothing
        whole = (distinct.select("key", "n", "first").join(roots, "key", "left").where("n > 1 or root is not null")
                 .withColumn("root", F.coalesce("root", "key")))
        groups = whole.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("occurrences")).where("occurrences > 1")
        # a line that most documents share is met by 16 tasks
        of_key = (whole.select("key", "root").join(groups, "root").select("key", "keep", "occurrences")
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))))
        out = (found.drop("bands").withColumn("salt", F.pmod(F.xxhash64("row", "doc_id", "line"), F.lit(16)).cast("int"))
               .join(of_key, ["key", "salt"]))
        mine = (F.col("row") == F.col("keep.row")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line") == F.col("keep.line"))
        out = out.select("row", "doc_id", "line", "start", "stop", "n_words", F.col("keep.doc_id").alias("kept_doc_id"),
                         F.col("keep.line").alias("kept_line"), "occurrences", (~mine).alias("removed"))
        return keep.spare(keep(out, "lines")).select(*(["row"] if row else []), *out.columns[1:])
