"""Mixing sources to target weights by the cube method.

Each source gets a target; every document of it starts with the same expected
number of copies, target / size of the source.  Its whole part is taken, its
fraction is an inclusion probability.  The flight phase walks the vector of
probabilities along directions that change neither the expected number of
documents nor of tokens, until each is 0 or 1; only two per block are left
open.  Blocks hold a bounded share of a source (by hash of id and text), the open
ones of all blocks are walked again, and so on, until one small landing
problem per source remains, which is rounded with the least error.

A null text has size 0, a null source is a source of its own (the last), null
ids are ids like any other.  Repeated rows are documents of their own.  All
randomness comes from hashes of ids and texts, so reruns agree.  Empty tables give no
rows; a source without words has target 0.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticketlens.llm.common import WORD, read, written

#: Documents in a block of the flight phase.
BLOCK = 4000
#: Rows up to which the table of sources is broadcast.
SMALL = 50_000
_EPS = 1e-9


def targets(per: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table with a row per source (``source``, ``source_size``).

    Weights repeat over the sources in code-point order, null last.  Targets
    share ``share`` of all sizes by weight; none exceeds ``cap`` times its
    source, what is above is shared again.  With sources sorted by cap per
    weight, the level of the sharing is the largest of (total - caps so far) /
    (weights to come)."""
    row = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(row) - 1) % len(weights) + 1)
    p = per.withColumn("__w", w).withColumn("__cap", F.col("source_size") * float(cap))
    up = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    everything = up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = up.rowsBetween(W.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
             / F.sum("__w").over(up.rowsBetween(0, W.unboundedFollowing)))
    p = p.withColumn("__l", level).withColumn("__l", F.max("__l").over(everything))
    return (p.withColumn("target", F.least(F.col("__cap"), F.col("__l") * F.col("__w")))
            .drop("__w", "__cap", "__l"))


def flight(p: list[float], z: list[float], rng: random.Random) -> list[int]:
    """Walks ``p`` in place, keeping sum(p) and sum(p * z), until at most two
    entries lie strictly between 0 and 1; returns their positions."""
    open_, n, nxt = [], len(p), 0
    while True:
        while len(open_) < 3 and nxt < n:
            if _EPS < p[nxt] < 1 - _EPS:
                open_.append(nxt)
            else:
                p[nxt] = float(round(p[nxt]))
            nxt += 1
        if len(open_) < 3:
            return open_
        i, j, k = open_
        # the null space of the rows (1, 1, 1) and (z_i, z_j, z_k)
        u = (z[j] - z[k], z[k] - z[i], z[i] - z[j])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, t in zip(open_, u):
            if t > 0:
                up, down = min(up, (1 - p[x]) / t), min(down, p[x] / t)
            elif t < 0:
                up, down = min(up, p[x] / -t), min(down, (1 - p[x]) / -t)
        step = up if rng.random() * (up + down) < down else -down
        for x, t in zip(open_, u):
            p[x] += step * t
        for x in open_:
            if not _EPS < p[x] < 1 - _EPS:
                p[x] = float(round(p[x]))
        open_ = [x for x in open_ if _EPS < p[x] < 1 - _EPS]


def land(p: list[float], z: list[float], open_: list[int]) -> None:
    """Rounds the last open entries so that the token total moves least."""
    best = None
    for bits in range(1 << len(open_)):
        s = [bits >> i & 1 for i in range(len(open_))]
        err = (abs(sum((a - p[x]) * z[x] for a, x in zip(s, open_))), abs(sum(a - p[x] for a, x in zip(s, open_))))
        if best is None or err < best[0]:
            best = err, s
    for a, x in zip(best[1], open_):
        p[x] = float(a)


def _walk(final: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "size"], kind="stable")
        p, z = group["p"].tolist(), group["size"].astype(float).tolist()
        open_ = flight(p, z, random.Random(f"{len(p)}:{group['order'].iloc[0]}:{int(sum(z))}"))
        if final:
            land(p, z, open_)
        return group.assign(p=p)
    return run


def sample(rows: DataFrame, by: str = "source") -> DataFrame:
    """``taken_one`` 0 or 1 for rows with probability ``p``, balanced on the
    number of rows and on ``size`` within each ``by``.  Needs the columns
    ``order`` (a hash) and ``size``; other columns are kept."""
    done, level = [], 0
    todo = written(rows.withColumn("p", F.col("p").cast("double")).withColumn("__b", F.lit(0).cast("long")), "open")
    while True:
        sizes = todo.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
        most = sizes.agg(F.max("__n")).first()[0]
        if most is None:
            break
        final = most <= BLOCK
        if final:
            now = todo.withColumn("__b", F.lit(0).cast("long"))
        else:
            sizes = written(sizes, "counts")
            if sizes.count() <= SMALL:
                sizes = F.broadcast(sizes)
            join = todo[by].eqNullSafe(sizes[by])
            now = todo.join(sizes, join).drop(sizes[by])
            now = now.withColumn("__b", F.pmod(F.xxhash64("order", F.lit(level)), F.ceil(F.col("__n") / BLOCK)))
            now = now.drop("__n").select(*todo.columns)
        walked = written(now.groupBy(by, "__b").applyInPandas(_walk(final), now.schema), "walked")
        if final:
            done.append(walked)
            break
        done.append(walked.where("p = 0 or p = 1"))
        todo, level = walked.where("p > 0 and p < 1"), level + 1
    out = done[0] if done else todo
    for d in done[1:]:
        out = out.unionAll(d)
    return out.withColumn("taken_one", F.round("p").cast("long")).drop("__b", "p")


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=(5, 2, 1),
        share: float = 1.5, cap: float = 2.0, row: str | None = None) -> DataFrame:
    """One row per document (rows that repeat id, text and source share their copies): the id (and ``row`` if given), ``size``,
    ``source_size``, ``target`` of its source, ``copies`` and ``taken``."""
    extra = [F.col(f"`{row}`").alias("row")] if row else []
    docs = written(df.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), *extra,
        F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("order"),
        F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
        .groupBy("id", "source", *(["row"] if row else []), "order", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    per = targets(docs.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, cap)
    per = written(per.select(F.col("source").alias("__s"), "source_size", "target"), "targets")
    if per.count() <= SMALL:
        per = F.broadcast(per)
    pi = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    docs = (docs.join(per, docs["source"].eqNullSafe(per["__s"])).drop("__s")
            .withColumn("__pi", pi * F.col("m")).withColumn("whole", F.floor("__pi")).withColumn("p", F.col("__pi") - F.col("whole"))
            .drop("__pi"))
    # equal rows are one unit, whose copies they share as evenly as they can
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    out = sample(docs).withColumn("__all", F.col("whole") + F.col("taken_one")).withColumn("__i", each)
    copies = F.floor(F.col("__all") / F.col("m")) + F.when(F.col("__i") <= F.col("__all") % F.col("m"), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("long"))
    return out.select(F.col("id").alias(doc_id), *([F.col("row").alias(row)] if row else []), "size", "source_size",
                      "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of the mix: each row of ``df`` as often as :func:`mix` takes it."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])  # no function hashes maps
    plan = mix(df.withColumn("__row", row), doc_id, source, text, row="__row", **options)
    plan = written(plan.groupBy("__row").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__n")), "plan")
    docs = df.withColumn("__row", row)
    if not plan.where("__n > 1").isEmpty():  # rows that are equal throughout share their copies
        docs = docs.dropDuplicates(["__row"])
    taken = docs.join(plan.where("__copies > 0"), "__row")
    return (taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
