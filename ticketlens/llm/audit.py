"""Filter interaction audit by contingency tensor contractions.

Every document fails or passes each of k filters.  Its part's documents are
counted by the 2 x ... x 2 outcomes, one axis a filter, once for all of them and
once for each kind of document that would be a loss.  Whatever happens at a step
of a filter order is then a contraction of that tensor: along each axis one
selects pass, fail or all, and ``einsum`` sums the rest.  The table of counts has
at most 2^k cells a part and kind, whatever the number of documents.

Documents with one text are found by a 128-bit digest.  Rows that repeat id, part
and text are counted together first, and the smallest id of a text is met by id
and digest, so a text or part that holds a third of all rows is no hot group.

Null texts are empty, null parts the empty string.  A row with a null id is
nobody's copy and has no label; of labels that repeat an id, any that says 1
counts.  Rows that repeat id and text are no copies of each other.  No document
gives no row.  Other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import arrow, map_text, read, written

#: The filters of the contract, in the order of their bits.
FILTERS = "ABCDE"
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Parts contracted at once.
_PARTS = 64
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: str | None) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: ASCII white space alone
    n = len(words)
    return ((n < 50) | (100 * len(set(words)) < 65 * n) << 1
            | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text or "")) << 2
            | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, digest, bits, n``: the outcome of the filters on the text
    itself (bit i of ``bits`` for filter i) and the number of equal rows."""
    def make():
        def fn(texts):
            return [[blake2b((t or "").encode(), digest_size=16).digest() for t in texts],
                    [text_failures(t) for t in texts]]
        return fn

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                         F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                         F.col(f"`{text}`").alias("text"))
    rows = map_text(narrow, ["doc_id", "part"], "text", [("digest", "binary"), ("bits", "int")], make)
    return rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))


def cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, bits, n, good, toxic``: documents by outcome of the five filters,
    and how many of them are labelled good or toxic."""
    seen = written(failures(docs, doc_id, text, part), "outcomes")
    known = seen.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    flags = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
             .where("good + toxic > 0"))
    copy = F.when(F.col("first"), F.lit(0)).otherwise(1 << FILTERS.index("E"))
    of_known = (known.join(first, ["digest", "doc_id"], "left").join(flags, "doc_id", "left")
                .select("part", F.col("bits").bitwiseOR(copy).alias("bits"), "n",
                        *[(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")]))
    others = seen.where("doc_id is null").select("part", "bits", "n", F.lit(0).cast("long").alias("good"),
                                                 F.lit(0).cast("long").alias("toxic"))
    return of_known.unionAll(others).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def contract(tensor: np.ndarray, orders: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Counts (part, order, step) from a tensor of counts (part, kind, 2, ..., 2)
    whose index 1 means fail; kinds are all, good and toxic documents."""
    k = tensor.ndim - 2
    passes, fails, every = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])

    def pick(choose) -> np.ndarray:
        """(part, kind, order, step) sums of what ``choose(axis, step, order)`` selects."""
        sel = np.array([[[choose(axis, step, order) for step in range(k)] for order in orders] for axis in range(k)],
                       dtype=np.int64)  # axis, order, step, outcome
        args = [tensor, [0, 1, *range(4, 4 + k)]]
        for axis in range(k):
            args += [sel[axis], [2, 3, 4 + axis]]
        return np.einsum(*args, [0, 1, 2, 3], optimize="greedy")

    removed = pick(lambda a, s, o: fails if a == o[s] else passes if a in o[:s] else every)
    failing = pick(lambda a, s, o: fails if a == o[s] else every)
    shapley = np.zeros((len(tensor), k), dtype=np.int64)
    which = np.array(orders)
    for f in range(k):
        shapley[:, f] = removed[:, 0][:, which == f].sum(axis=1)
    return {"kept": pick(lambda a, s, o: passes if a in o[:s + 1] else every)[:, 0], "removed": removed[:, 0],
            "redundant": failing[:, 0] - removed[:, 0],
            "unique_fails": pick(lambda a, s, o: fails if a == o[s] else passes)[:, 0],
            "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shapley[:, which]}


def _steps(names: str):
    orders = list(permutations(range(len(names))))
    texts = ["".join(names[i] for i in o) for o in orders]
    k, n = len(names), len(orders)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _PARTS):
                parts = batch.slice(at, _PARTS)
                tensor = np.zeros((len(parts), 3, 1 << k), dtype=np.int64)
                for p, found in enumerate(parts.column(1).to_pylist()):
                    for c in found:
                        axes = sum((c["bits"] >> i & 1) << k - 1 - i for i in range(k))  # filter i is axis i
                        tensor[p, :, axes] += (c["n"], c["good"], c["toxic"])
                out = contract(tensor.reshape(len(parts), 3, *[2] * k), orders)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(parts.column(0).to_pylist(), dtype=object), n * k), pa.string()),
                     pa.array([t for t in texts for _ in range(k)] * len(parts), pa.string()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * len(parts))),
                     *[pa.array(out[c].ravel()) for c in _COUNTS]], names=["part", "filter_order", "step", *_COUNTS])
    return run


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``part, bits, n, good, toxic``."""
    packed = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # 2^k at most
    return arrow(packed, _steps(names), "part string, filter_order string, step int, "
                 + ", ".join(f"{c} long" for c in _COUNTS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return audit(cells(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
               max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END)
             || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
             || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
             || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
             || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM w LEFT JOIN lab USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS here, filter_order[:s - 1] AS before
          FROM orders, range(1, 6) r(s)),
m AS (SELECT part, filter_order, step, here, n, good, toxic,
             contains(fails, here) AS failing, translate(before, fails, '') = before AS reached,
             fails = here AS only_this
      FROM cells, steps),
c AS (SELECT part, filter_order, step, here,
             sum(CASE WHEN reached AND NOT failing THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN reached AND failing THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failing AND NOT reached THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN reached AND failing THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN reached AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM m GROUP BY part, filter_order, step, here)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley
FROM c
"""
