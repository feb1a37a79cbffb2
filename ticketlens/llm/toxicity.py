"""Toxicity by a weighted lexicon matched with Aho-Corasick.

A text is folded first: compatibility forms, look-alike letters of other
scripts and digits or symbols inside words become plain letters, invisible
characters go.  The lexicon holds whole words and beginnings of words with
weights; one automaton finds all of them, and the exception phrases in which
they do not count.  Each matched word adds its heaviest entry.  The sum, the
sum per length and the heaviest hit give the score.

Words, weights, exceptions and the score's coefficients are learned from a
bounded sample of labelled documents; every text is matched whole.  Null and
empty texts have no hit and get the lowest score of all.  Repeated rows score
alike.  Without labels of both classes there is no lexicon and every score is
the share of label 1 (0 if no label).  Rows with a null id are scored, never
learned from nor held out; an empty table gives no row.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import crc_mod, labelled_sample, map_text, read

#: Labelled documents learned from and entries of the lexicon, at most.
SAMPLE, ENTRIES = 8000, 4000

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһкмтвнαοερτυικν", "aeopcyxijsdhkmtbhaoeptuikv"))
# Digits and symbols written for letters.
SUBSTITUTES = dict(zip("013457@$!|", "oieastasil"))

_ODD = re.compile("[" + "".join(LOOK_ALIKES) + "­​-‏⁠ﬀ-ﬆ！-～\U0001d400-\U0001d7ff﻿]").search
_FOLD = {ord(a): b for a, b in LOOK_ALIKES.items()} | dict.fromkeys(
    [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\W_])[013457@$](?=[^\W\d_]{2})").sub
_SUB = str.maketrans(SUBSTITUTES)
_HAS_SUB = re.compile(r"[013457@$!|]").search
_GAP = re.compile(r"[\W_]+").sub


def fold(text: str | None) -> str:
    """Lower case, folded, words between single spaces: `` w1 w2 ``."""
    t = (text or "").lower()
    if not t.isascii() and _ODD(t):
        t = unicodedata.normalize("NFKC", t).lower().translate(_FOLD)
    if _HAS_SUB(t):
        t = _INSIDE(lambda m: m.group().translate(_SUB), t)
    return f" {_GAP(' ', t).strip()} "


class Matcher:
    """Entries: `` word `` (whole) or `` begin`` (a beginning), to weights."""

    def __init__(self, entries: dict[str, float], exceptions: list[str]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton() if entries else None
        for e, w in entries.items():
            self.automaton.add_word(e, (len(e), w))
        for e in exceptions if entries else []:
            self.automaton.add_word(f" {e} ", (len(e) + 2, None))
        if entries:
            self.automaton.make_automaton()

    def hits(self, flat: str) -> dict[int, float]:
        """Heaviest weight per start of a matched word, exceptions left out."""
        if self.automaton is None:
            return {}
        found: dict[int, float] = {}
        spared = []
        for end, (n, w) in self.automaton.iter(flat):
            start = end - n + 1
            if w is None:
                spared.append((start, end))
            elif w > found.get(start, 0.0):
                found[start] = w
        for a, b in spared:
            for s in [s for s in found if a <= s < b]:
                del found[s]
        return found


def measures(flat: str, matcher: Matcher) -> list[float]:
    hits = matcher.hits(flat)
    total, words = sum(hits.values()), max(1, flat.count(" ") - 1)
    return [np.log1p(total), np.log1p(100 * total / words), max(hits.values(), default=0.0), np.log1p(words) / 10,
            np.log1p(total) * np.log1p(words) / 10]


def _grow(flat: str, shortest: int, longest: int) -> set[str]:
    out = set()
    for w in set(flat.split()):
        out.add(f" {w} ")
        for n in range(shortest, min(longest, len(w) - 1) + 1):
            out.add(" " + w[:n])
    return out


def learn_lexicon(rows: DataFrame, least: int = 5, z: float = 4.0, shortest: int = 3, longest: int = 10,
                  entries: int = ENTRIES) -> dict[str, float]:
    """Entries that toxic documents of ``rows`` (text, y) hold more often than
    others: smoothed log-odds at least ``z`` of their standard errors above 0."""
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if not pos or not neg:
        return {}

    def make():
        return lambda texts: [[sorted(_grow(fold(t), shortest, longest)) for t in texts]]

    seen = map_text(rows, ["y"], "text", [("entry", "array<string>")], make)
    t = (seen.select("y", F.explode("entry").alias("entry")).groupBy("entry")
         .agg(F.sum(F.col("y").cast("double")).alias("a"), F.sum(1.0 - F.col("y")).alias("b")).where(F.col("a") >= least))
    odds = (F.log((F.col("a") + .5) / (pos - F.col("a") + .5)) - F.log((F.col("b") + .5) / (neg - F.col("b") + .5)))
    error = F.sqrt(1 / (F.col("a") + .5) + 1 / (F.col("b") + .5) + 1 / (pos - F.col("a") + .5) + 1 / (neg - F.col("b") + .5))
    t = t.withColumn("w", odds).withColumn("z", odds / error).where(F.col("z") >= z)
    got = t.orderBy(F.col("z").desc(), "entry").limit(entries).collect()
    return {r["entry"]: float(r["w"]) for r in got}


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], least: int = 5, share: float = .1) -> list[str]:
    """Two-word phrases around matched words that other documents hold at
    least ``least`` times and of whose documents at most ``share`` are toxic."""
    if not lexicon:
        return []

    def make():
        m = Matcher(lexicon, [])

        def phrases(t):
            flat, out = fold(t), set()
            for s in m.hits(flat):
                e = flat.index(" ", s + 1)
                after = flat[s + 1:flat.find(" ", e + 1)] if e + 1 < len(flat) else ""
                before = flat[flat.rfind(" ", 0, s) + 1:e] if s else ""
                out |= {p for p in (before, after) if " " in p}
            return sorted(out)
        return lambda texts: [[phrases(t) for t in texts]]

    seen = map_text(rows, ["y"], "text", [("phrase", "array<string>")], make)
    t = (seen.select("y", F.explode("phrase").alias("phrase")).groupBy("phrase")
         .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("a"))
         .where((F.col("n") - F.col("a") >= least) & (F.col("a") <= share * F.col("n"))))
    return [r["phrase"] for r in t.orderBy(F.col("n").desc(), "phrase").limit(ENTRIES).collect()]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last entry is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fold_: Column, label: str = "toxic", doc_id: str = "doc_id",
        text: str = "text", sample: int = SAMPLE, exceptions: list[str] | None = None) -> dict:
    """Learns from at most ``sample`` labelled documents of the fold.  The
    coefficients come from a third of them, which the lexicon has not seen.
    ``exceptions`` are phrases in which no word counts, beside the learned ones."""
    marked = labels.where(F.col(label).isin(0, 1))
    rows = labelled_sample(docs, marked, label, fold_, sample, 13, doc_id, text)
    part = F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(3))
    learned = learn_lexicon(rows.where(part != 0))
    spared = [" ".join(fold(e).split()) for e in exceptions or []] + learn_exceptions(rows.where(part != 0), learned)
    matcher = {"entries": learned, "exceptions": spared}

    def make():
        m = Matcher(**matcher)
        return lambda texts: [[measures(fold(t), m) for t in texts]]

    got = map_text(rows.where(part == 0) if learned else rows, [doc_id, "y"], "text", [("x", "array<double>")], make)
    got = got.orderBy(doc_id).collect()
    counts = {r["y"]: r["n"] for r in marked.where(fold_).groupBy(F.col(label).alias("y"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    y = np.array([r["y"] for r in got], dtype=np.float64)
    if len(set(y)) < 2 or not learned:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return matcher | {"share": share}
    x = np.array([r["x"] for r in got])
    weight = np.where(y > 0, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    return matcher | {"w": logistic((x - mean) / std, y, weight / weight.mean()), "mean": mean, "std": std}


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1), ``predicted`` and ``n_hits``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES entries at most

    def make():
        m = shared.value
        matcher = Matcher(m["entries"], m["exceptions"])

        def fn(texts):
            flats = [fold(t) for t in texts]
            if "w" in m:
                x = (np.array([measures(f, matcher) for f in flats]) - m["mean"]) / m["std"]
                s = 1 / (1 + np.exp(-np.clip(x @ m["w"][:-1] + m["w"][-1], -30, 30)))
            else:
                s = np.full(len(texts), float(m["share"]))
            n = [len(matcher.hits(f)) for f in flats]
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(n, pa.int64())]
        return fn

    return map_text(docs, keep, text, [("score", "double"), ("predicted", "int"), ("n_hits", "long")], make)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    held = crc_mod(F.col("doc_id"), 5)
    model = fit(docs, labels, F.coalesce(held != 0, F.lit(False)))
    return score(docs, model).select("doc_id", F.coalesce(held == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits")
