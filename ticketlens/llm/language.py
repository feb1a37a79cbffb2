"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  One binary classifier per bit, over
hashed byte n-grams of the folded text, predicts that bit; decoding picks the
language whose codeword loses least against the predicted margins, each bit
weighted by how well its classifier did on rows held out of its training.  A
document whose best two codewords lose nearly the same is flagged.

Null texts, and texts without a letter, are ``und`` with score 0.  Without any
labelled row everything is ``und``.  Repeated rows are scored alike.  Rows with a
null id are scored, never learned from nor held out; an empty table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import bounded_sample, crc_mod, map_text, read, written

#: Hash buckets of the n-grams; at most this many documents are learned from.
BUCKETS, SAMPLE = 1 << 13, 2400
_CHUNK = 1 << 20
_OTHER = re.compile(r"[\W\d_]+").sub


def letters(text: str | None) -> str:
    """The text in lower case, all runs of other than letters as one space."""
    flat = f" {_OTHER(' ', text.lower()).strip()} " if text else " "
    return flat if any(map(str.isalpha, flat)) else ""


def ngrams(flat: str) -> np.ndarray:
    """Counts of the hashed 2-, 3- and 4-byte runs of a folded text."""
    data, total = np.frombuffer(flat.encode(), dtype=np.uint8), np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), _CHUNK):
        b = data[at:at + _CHUNK + 3].astype(np.uint32)
        two = b[:-1] | b[1:] << 8
        three = two[:-1] | b[2:] << 16
        four = three[:-1] | b[3:] << 24
        for n, grams in ((2, two), (3, three), (4, four)):
            grams = grams[:_CHUNK] if len(b) > _CHUNK else grams
            total += np.bincount((grams * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(19),
                                 minlength=BUCKETS)
    return total


def features(flat: str) -> np.ndarray:
    counts = ngrams(flat).astype(np.float32)
    return np.sqrt(counts / max(1.0, counts.sum()))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 / -1: every split of the classes while there are few, else
    random columns with the largest least distance between two rows."""
    if k <= 7:
        cols = [[1 if not c or v >> (c - 1) & 1 else -1 for c in range(k)] for v in range((1 << k - 1) - 1)]
        return np.array(cols, dtype=np.float64).reshape(len(cols), k).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k))), None
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (k, bits))
        split = np.abs(code.sum(axis=0)) < k
        distance = bits - (code @ code.T)
        np.fill_diagonal(distance, np.inf)
        if split.all() and (best is None or distance.min() > best[0]):
            best = distance.min(), code
    return best[1]


def fit_bits(x: np.ndarray, targets: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Ridge-regularised linear classifiers (a column per bit; last row: bias)."""
    n = len(x)
    mean = x.mean(axis=0)
    c = x - mean
    gram = (c @ c.T).astype(np.float64)
    scale = np.trace(gram) / n + 1e-12
    bias = targets.mean(axis=0)
    dual = np.linalg.solve(gram / scale + l2 / n * np.eye(n) * 10, (targets - bias) / scale)
    w = c.T @ dual.astype(c.dtype)
    return np.vstack([w, bias - mean @ w])


def fit(docs: DataFrame, fold: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE) -> dict:
    """Learns from at most ``sample`` documents of the ``fold`` with a language."""
    rows = docs.where(fold)
    picked = F.broadcast(bounded_sample(rows, doc_id, lang, sample, 11).dropDuplicates([doc_id]))
    rows = rows.select(doc_id, text).join(picked, doc_id).limit(sample)

    def make():
        def fn(texts):
            flats = [letters(t) for t in texts]
            return [[features(f).astype(np.float16).tobytes() if f else None for f in flats]]
        return fn

    got = written(map_text(rows, [doc_id, lang], text, [("x", "binary")], make), "grams").where("x is not null")
    got = got.orderBy(doc_id, lang).select(lang, "x").collect()
    langs = sorted({r[0] for r in got})
    if len(langs) < 2:
        return {"langs": langs, "w": np.zeros((BUCKETS + 1, 0)), "code": np.zeros((len(langs), 0)), "bits": np.zeros(0)}
    x = np.stack([np.frombuffer(r[1], dtype=np.float16).astype(np.float32) for r in got])
    y = np.array([langs.index(r[0]) for r in got])
    code = codewords(len(langs))
    held = np.arange(len(x)) % 4 == 3
    if held.all() or not held.any():
        held = np.zeros(len(x), dtype=bool)
    w = fit_bits(x[~held], code[y[~held]])
    margins = x[held] @ w[:-1] + w[-1]
    error = np.mean(np.sign(margins) != code[y[held]], axis=0) if held.any() else np.zeros(code.shape[1])
    bits = np.clip(.5 * np.log((1 - error + .01) / (error + .01)), .05, None)
    return {"langs": langs, "w": fit_bits(x, code[y]), "code": code, "bits": bits / bits.sum()}


def decode(model: dict, margins: np.ndarray) -> tuple[int, float, float]:
    """(language, probability-like score, lead over the second) by weighted logistic loss."""
    loss = (model["bits"] * np.log1p(np.exp(-4.0 * margins * model["code"]))).sum(axis=1)
    p = np.exp(-6.0 * (loss - loss.min()))
    p /= p.sum()
    best = int(np.argmin(loss))
    two = np.sort(p)[-2:]
    return best, float(p[best]), float(two[1] - two[0])


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None,
             ambiguous_below: float = 0.2) -> DataFrame:
    """``keep`` columns plus ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits, whatever the input

    def make():
        m = shared.value
        langs, w, bias = m["langs"], m["w"][:-1].astype(np.float32), m["w"][-1]

        def one(t):
            flat = letters(t)
            if not flat or not langs:
                return "und", 0.0, False
            if len(langs) == 1:
                return langs[0], 1.0, False
            best, score, lead = decode(m, features(flat) @ w + bias)
            return langs[best], score, lead < ambiguous_below

        def fn(texts):
            a, b, c = zip(*map(one, texts)) if texts else ((), (), ())
            return [pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())]
        return fn

    return map_text(docs, keep, text, [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")], make)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = crc_mod(F.col("doc_id"), 3)
    model = fit(docs, F.coalesce(fold != 1, F.lit(False)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
