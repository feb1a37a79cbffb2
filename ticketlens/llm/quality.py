"""Quality classifier: random-indexing word vectors and a small network.

Every word (a run of word characters, or of other visible characters) falls
into one of ``BUCKETS`` rows by its hash and has a sparse random index vector.
A word's vector is the sum of the index vectors seen around it in all
documents; no vocabulary is kept and the table has the same size for any
input.  A document pools its words' vectors and index vectors; a two-layer
network scores the pool, with a temperature and class shift fitted on rows
held out of its training.

Null and empty texts have an empty pool and get the network's score for it.
Texts of any length are pooled in chunks.  Repeated rows score alike.  Without
labels of both classes every score is the share of label 1 (1 if no label).  Rows
with a null id are scored, never learned from nor held out; an empty table gives
no row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import crc_mod, labelled_sample, map_text, read, slices, tasks, written

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 2, 2
#: Labelled documents that the network learns from, at most.
SAMPLE = 6000
_CHUNK = 1 << 16
_ROWS = 512  # bucket rows in one piece of a partial table
_WORDS = re.compile(r"\w+|[^\w\s]+").findall


class _Ids(dict):
    """word -> bucket; emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


def bucket_ids(text: str | None, ids: _Ids) -> np.ndarray:
    found = _WORDS(text) if text else []
    return np.fromiter(map(ids.__getitem__, found), dtype=np.int64, count=len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's index vector (the same everywhere);
    the last row is the border between documents, with sign 0."""
    rng = np.random.default_rng(20)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    sign = rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
    return np.vstack([at, np.zeros((1, NONZERO))]).astype(np.int64), np.vstack([sign, np.zeros((1, NONZERO))])


def add_contexts(ids: np.ndarray, table: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Adds to each word's row the index vectors of the words up to WINDOW away."""
    for d in range(1, WINDOW + 1):
        for word, near in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
            for k in range(NONZERO):
                table += np.bincount(word * DIM + at[near, k], weights=sign[near, k], minlength=len(table))


def _contexts(batches):
    at, sign = index_vectors()
    table, ids = np.zeros((BUCKETS + 1) * DIM), _Ids()
    border = np.full(WINDOW, BUCKETS, dtype=np.int64)
    waiting, size = [], 0
    for batch in batches:
        for a, b in slices(batch.column(0)):
            for text in batch.column(0).slice(a, b - a).to_pylist():
                waiting += [bucket_ids(text, ids), border]
                size += len(waiting[-2]) + WINDOW
                if size > 8 * _CHUNK:
                    add_contexts(np.concatenate(waiting), table, at, sign)
                    waiting, size = [], 0
    if waiting:
        add_contexts(np.concatenate(waiting), table, at, sign)
    rows = table[:-DIM].reshape(BUCKETS, DIM)
    for piece in range(0, BUCKETS, _ROWS):
        part = rows[piece:piece + _ROWS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([piece // _ROWS], pa.int32()),
                                              pa.array([part.astype(np.float32).tobytes()], pa.binary())],
                                             names=["piece", "v"])


def _sum_pieces(batches):
    """Sums the pieces that come to this task one by one; holds a row per piece."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(v.as_buffer(), dtype=np.float32)
            total[piece] = total[piece] + x if piece in total else x.astype(np.float64)
    for piece, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()),
                                          pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["piece", "v"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context vectors of all buckets from all documents (BUCKETS x DIM).

    Each task adds up a table of fixed size; tables are summed by piece in two
    steps, the first spread over a salt, so that no task reads all of them."""
    spark = docs.sparkSession
    n, schema = tasks(spark), "piece int, v binary"
    parts = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(_contexts, schema)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(max(1, n // 8))))
    parts = parts.repartition(n, "piece", "salt").select("piece", "v").mapInArrow(_sum_pieces, schema)
    parts = parts.repartition(min(n, BUCKETS // _ROWS), "piece").mapInArrow(_sum_pieces, schema)
    table = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for piece, v in parts.collect():  # BUCKETS * DIM numbers, whatever the input
        table[piece * _ROWS:(piece + 1) * _ROWS] = np.frombuffer(v, dtype=np.float32).reshape(-1, DIM)
    return table


def embedding(table: np.ndarray) -> np.ndarray:
    """Per bucket: its context vector (length 1, less the mean) and its index vector."""
    size = np.linalg.norm(table, axis=1, keepdims=True)
    unit = table / np.maximum(size, 1e-9)
    seen = size[:, 0] > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(axis=0)
    at, sign = index_vectors()
    own = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.add.at(own, (np.arange(BUCKETS)[:, None], at[:-1]), sign[:-1])
    return np.hstack([unit, own]).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of the words' vectors, the sizes of both halves, the share of words
    whose vector is that of the word before, and the log of the length."""
    total = np.zeros(vectors.shape[1])
    for at in range(0, len(ids), _CHUNK):
        total += vectors[ids[at:at + _CHUNK]].sum(axis=0, dtype=np.float64)
    mean = total / max(1, len(ids))
    same = np.count_nonzero(ids[1:] == ids[:-1]) / max(1, len(ids))
    return np.concatenate([mean, [np.linalg.norm(mean[:DIM]), np.linalg.norm(mean[DIM:]), same,
                                  np.log1p(len(ids)) / 10]])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, epochs: int = 150, seed: int = 3) -> dict:
    """Two layers, tanh then logistic, by Adam on weighted cross-entropy."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / std
    p = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b": np.zeros(hidden),
         "c": rng.normal(0, 1 / np.sqrt(hidden), hidden), "d": np.zeros(1)}
    m, v, step = {k: 0 * w for k, w in p.items()}, {k: 0 * w for k, w in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            i = order[at:at + 256]
            h = np.tanh(z[i] @ p["a"] + p["b"])
            e = (1 / (1 + np.exp(-np.clip(h @ p["c"] + p["d"], -30, 30))) - y[i]) * weight[i] / len(i)
            back = e[:, None] * p["c"] * (1 - h * h)
            g = {"a": z[i].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ e + 1e-4 * p["c"],
                 "d": np.array([e.sum()])}
            step += 1
            for k in p:
                m[k] = .9 * m[k] + .1 * g[k]
                v[k] = .999 * v[k] + .001 * g[k] ** 2
                p[k] -= 4e-3 * (m[k] / (1 - .9 ** step)) / (np.sqrt(v[k] / (1 - .999 ** step)) + 1e-8)
    return p | {"mean": mean, "std": std}


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh((x - model["mean"]) / model["std"] @ model["a"] + model["b"]) @ model["c"] + model["d"]


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(temperature, shift) with the least weighted cross-entropy of sigmoid(z / T + shift)."""
    best = (np.inf, 1.0, 0.0)
    for t in np.geomspace(.5, 20, 30):
        for s in np.linspace(-4, 4, 33):
            q = np.clip(z / t + s, -30, 30)
            loss = float((weight * (np.logaddexp(0, q) - y * q)).sum())
            best = min(best, (loss, float(t), float(s)))
    return best[1], best[2]


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "quality", doc_id: str = "doc_id",
        text: str = "text", sample: int = SAMPLE) -> dict:
    """Word vectors from all of ``docs``; the network from at most ``sample``
    labelled documents of the ``fold`` (a condition on the id)."""
    vectors = embedding(word_vectors(docs, text))
    rows = labelled_sample(docs, labels, label, fold, sample, 12, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        ids, e = _Ids(), shared.value
        return lambda texts: [[pool(bucket_ids(t, ids), e).astype(np.float64).tobytes() for t in texts]]

    got = map_text(rows, [doc_id, "y"], "text", [("x", "binary")], make).orderBy(doc_id).collect()
    counts = {r["y"]: r["n"] for r in labels.where(fold).where(F.col(label).isin(0, 1))
              .groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = [r for r in got if r["y"] in (0, 1)]
    y = np.array([r["y"] for r in got], dtype=np.float64)
    if len(set(y)) < 2:
        share = y.mean() if len(y) else 1.0
        return {"vectors": vectors, "share": float(share)}
    x = np.stack([np.frombuffer(r["x"]) for r in got])
    held = np.arange(len(x)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(x), dtype=bool)
    even = np.where(y > 0, .5 / y.mean(), .5 / (1 - y.mean()))
    net = train(x[~held] if not held.all() else x, y[~held] if not held.all() else y, even[~held] if not held.all() else even)
    # the sample is evened out over the classes; the shares of all labels count for the probabilities
    true = np.where(y > 0, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    t, s = calibrate(logits(net, x[held]), y[held], true[held])
    return {"vectors": vectors, "net": net, "temperature": t, "shift": s}


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None, threshold: float = 0.7,
          out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input

    def make():
        m, ids = shared.value, _Ids()

        def fn(texts):
            if "net" in m:
                x = np.stack([pool(bucket_ids(t, ids), m["vectors"]) for t in texts])
                z = np.clip(logits(m["net"], x) / m["temperature"] + m["shift"], -30, 30)
                s = 1 / (1 + np.exp(-z))
            else:
                s = np.full(len(texts), m["share"])
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
        return fn

    return map_text(docs, keep, text, [(out[0], "double"), (out[1], "int")], make)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    fold = crc_mod(F.col("doc_id"), 4)
    model = fit(docs, labels, F.coalesce(fold != 2, F.lit(False)))
    return score(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")
