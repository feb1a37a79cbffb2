"""Links between alike sets, for operators on near-duplicates.

Given are items with a digest, the size of their set and the values of their
bands, and a way to get the sets of some of them.  Wanted are verified links that
join whatever shares a band and is similar enough (exact Jaccard), as few as
connect the components.

* (bucket, item) rows are sorted over ranges.  A bucket is then a run of rows, in
  one task or, if it is large, over several; no key is dealt to one task.
* Items of a run meet its first item, every ``HUB`` of them one more, and these
  the first; runs of one bucket in several tasks meet through their first items.
  So no centre has many partners, and no group is turned into its pairs.  Of the
  centres an item meets, the least is verified first, then those still apart.
* Buckets that then hold several components have pairs which met no centre.
  Small ones are settled in a task: each item outside the largest component
  against all others.  Items of large ones are banded again, with more rows a
  band, which parts what is not alike; what is large still is cut into blocks by
  hash, and blocks of items outside the largest component meet all blocks.

The number of jobs is fixed, but for the logarithmic rounds of components.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import Steps, arrow
from ticketlens.llm.components import connected_components

#: Items that meet one centre; elements of sets compared in one task.
HUB, SMALL = 1000, 1 << 19
#: Rows a band, and the recall at the limit, for items of large buckets.
NARROW_ROWS, RECALL = 10, 0.9999
_U = np.uint64


def bands_for(percent: int, rows: int, recall: float = RECALL) -> int:
    """The bands of so many rows that meet the recall at the similarity."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def min_max_bands(elements: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 0) -> np.ndarray:
    """A value per set and band from min-max hashes of non-empty sets.

    ``starts`` are the beginnings of the sets among the ``elements``.  Each hash
    function serves twice, by its least and by its greatest value: an even band
    takes the least of its functions, the next one their greatest.  Either is
    shared with the chance of the Jaccard similarity, and they rather miss in
    turns than together, so the recall is no less than with functions of its own.
    """
    rng = np.random.default_rng([7919, seed])
    n = (bands + 1) // 2 * rows
    factors = rng.integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)
    adds = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    for band in range(0, bands, 2):
        low = np.full(len(starts), band, dtype=np.uint64)
        high = np.full(len(starts), band + 1, dtype=np.uint64)
        for j in range(band // 2 * rows, (band // 2 + 1) * rows):
            x = mix(elements * factors[j] + adds[j])
            low = mix(low * _U(0xD6E8FEB86659FD93) + np.minimum.reduceat(x, starts))
            if band + 1 < bands:
                high = mix(high * _U(0xD6E8FEB86659FD93) + np.maximum.reduceat(x, starts))
        out[:, band] = low
        if band + 1 < bands:
            out[:, band + 1] = high
    return out


_MEMBERS = "bucket long, key binary, size long, first binary, first_size long, mark boolean"


def _segments(hub: int):
    """Sorted rows (bucket, key, size) of a task -> those of buckets with two or
    more of them, each with its centre, and ``mark`` rows for the first and last
    bucket of the task, which may go on in others."""
    def run(batches):
        bucket = first = sub = held = None
        begun, n = False, 0

        def table(rows):
            cols = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()))],
                names=["bucket", "key", "size", "first", "first_size", "mark"])
        for batch in batches:
            b = batch.column(0).to_numpy()
            same = b[1:] == b[:-1]
            wanted = np.concatenate([same, [True]]) | np.concatenate([[True], same])
            at, out = pa.array(np.flatnonzero(wanted)), []
            for v, key, size in zip(b[wanted].tolist(), batch.column(1).take(at).to_pylist(), batch.column(2).take(at).to_pylist()):
                if v != bucket or not begun:
                    bucket, first, sub, n, held = v, (key, size), (key, size), 1, (v, key, size, key, size, False)
                    if not begun:
                        out += [held, (*held[:5], True)]
                        begun, held = True, None
                    continue
                if held:
                    out.append(held)
                    held = None
                out.append((v, key, size, *(sub if n % hub else first), False))
                if n % hub == 0:
                    sub = (key, size)
                n += 1
            yield table(out)
        if begun:
            yield table(([held] if held else []) + [(bucket, *first, *first, True)])
    return run


def _overlaps(mine: list[tuple], others: list[tuple], percent: int):
    """Links of ``mine`` to ``others``, both (key, root, set), between roots that are still apart."""
    if not mine:
        return
    sizes = np.array([len(g[2]) for g in others])
    roots, of = np.unique([g[1] for g in [*mine, *others]], return_inverse=True)
    of_mine, comp = of[:len(mine)], of[len(mine):].copy()
    words, ids = np.unique(np.concatenate([g[2] for g in others]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    now = np.arange(len(roots))  # root -> component
    for (key, _, elements), root in zip(mine, of_mine):
        at = np.searchsorted(words, elements)
        at[at == len(words)] = 0
        hit = at[words[at] == elements]
        if not len(hit):
            continue
        mark = np.zeros(len(words), dtype=np.int32)
        mark[hit] = 1
        both = np.add.reduceat(mark[ids], starts)
        near = (100 * both >= percent * (sizes + len(elements) - both)) & (now[comp] != now[root])
        for j in np.flatnonzero(near):
            a, b = now[root], now[comp[j]]
            if a != b:
                now[now == b] = a
                yield key, others[j][0]


def _pairs(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _in_groups(percent: int, fields: int):
    """Rows (``fields`` of the group, side, key, root, set), those of a group
    together -> links of side 0 to all.  Without block numbers side 0 is what
    lies outside the largest component."""
    def settle(group):
        if fields == 1:
            count: dict = {}
            for _, _, root, _ in group:
                count[root] = count.get(root, 0) + 1
            main = max(count, key=lambda r: (count[r], r))
            rows = [g[1:] for g in group]
            return list(_overlaps([g for g in rows if g[1] != main], rows, percent))
        return list(_overlaps([g[1:] for g in group if g[0] == 0], [g[1:] for g in group if g[0] == 1], percent)
                    if any(g[0] == 1 for g in group) else ())

    def run(batches):
        name, group, out = None, [], []
        for batch in batches:
            sets = batch.column(fields + 3)
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(fields + 3)))):
                if row[:fields] != name:
                    out += settle(group) if group else []
                    name, group = row[:fields], []
                group.append((*row[fields:], sets[i].values.to_numpy(zero_copy_only=False)))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out + (settle(group) if group else []))
    return run


def _narrow_bands(bands: int, rows: int):
    """(key, set) -> key, size and the values of longer bands."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = part.column(1)
                sizes = np.diff(sets.offsets.to_numpy())
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                v = min_max_bands(sets.flatten().to_numpy().view(np.uint64), starts, bands, rows, seed=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(
                    v.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["key", "size", "bands"])
    return run


def links(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, keep: Steps,
          exact_sizes: bool = True) -> DataFrame:
    """Links ``(a, b)`` between the keys of ``items`` (key binary, size long,
    bands array<long>); ``sets_of(keys)`` gives ``key, set`` (distinct elements,
    sorted) for a table of keys and may repeat a key.  Sizes that are not exact
    only say what a task can hold."""
    def verified(pairs):
        both = F.size(F.array_intersect("sa", "sb"))
        one = pairs.join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
        return (one.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a")
                .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct())

    def with_roots(rows, column, out, roots):
        found = roots.select(F.col("node").alias(column), F.col("root").alias(out))
        return rows.join(found, column, "left").withColumn(out, F.coalesce(out, column))

    found = None
    for narrow in (False, True):
        rows = items.select("key", "size", F.explode("bands").alias("bucket")).select("bucket", "key", "size")
        rows = rows.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
        members = keep(arrow(rows, _segments(HUB), _MEMBERS), "members")
        of_bucket = members.where("not mark")
        if not narrow:
            sets = keep(sets_of(of_bucket.where("key != first").select(F.explode(F.array("key", "first")).alias("key")).union(
                members.where("mark").select("key")).distinct()), "sets")
        # a bucket in several tasks: two marks a task at most
        marks = members.where("mark").select("bucket", F.col("key").alias("b"), F.col("size").alias("nb")).distinct()
        tops = marks.groupBy("bucket").agg(F.min(F.struct(F.col("b").alias("a"), F.col("nb").alias("na"))).alias("m"))
        over = marks.join(tops, "bucket").select("m.a", "b", "m.na", "nb")
        pairs = of_bucket.select(F.col("first").alias("a"), F.col("key").alias("b"), F.col("first_size").alias("na"),
                                 F.col("size").alias("nb")).unionAll(over)
        pairs = pairs.where("a != b")
        if exact_sizes:
            pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = keep(pairs.select("a", "b").distinct(), "pairs")
        # the least centre of each item, then whatever is still apart
        stars = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        found = keep(stars if found is None else stars.unionAll(found), "links")
        roots = connected_components(found, keep=keep)
        apart = with_roots(with_roots(pairs, "a", "ra", roots), "b", "rb", roots).where("ra != rb").select("a", "b")
        found = keep(verified(apart).unionAll(found), "links")
        # buckets with several components that some pair may still join
        now = keep(with_roots(of_bucket.select("bucket", "key", "size"), "key", "root",
                              connected_components(found, keep=keep)), "rooted")
        by_root = now.groupBy("bucket", "root").agg(
            F.count(F.lit(1)).alias("c"), F.sum("size").alias("w"),
            F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.pmod(F.xxhash64("key"), F.lit(1 << 40))).alias("y"))
        several = (by_root.groupBy("bucket").agg(
            F.max(F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"),
            F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.sum("y").alias("y")).where("k > 1 and c > 2"))
        several = several.groupBy("c", "w", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("main.root").alias("main"))
        several = keep(several.select("bucket", "main", "w"), "open")
        # a bucket with most of the rows is met by 16 tasks
        salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        now = keep(now.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(salted, ["bucket", "salt"])
                   .select("bucket", "key", "root", "main", "w"), "left")
        parts, big = [found], now.where(F.col("w") > SMALL)
        ready = now.where(F.col("w") <= SMALL).join(sets, "key").select("bucket", F.lit(0).alias("side"), "key", "root", "set")
        parts.append(arrow(ready.repartition("bucket").sortWithinPartitions("bucket"), _in_groups(percent, 1), "a binary, b binary"))
        if narrow and not big.isEmpty():
            k = F.ceil(F.col("w") / SMALL).cast("int")
            cut = big.join(sets, "key").withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
            each = F.explode(F.expr("sequence(0, k - 1)"))
            mine = cut.where("root != main").select("bucket", F.col("own").alias("i"), each.alias("j"),
                                                    F.lit(0).alias("side"), "key", "root", "set")
            others = cut.select("bucket", each.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "key", "root", "set")
            met = mine.unionAll(others).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            parts.append(arrow(met, _in_groups(percent, 3), "a binary, b binary"))
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionAll(p)
        found = keep(all_.distinct(), "links")
        if narrow or big.isEmpty():
            return found
        wide = big.select("key").distinct().join(sets, "key").dropDuplicates(["key"]).select("key", "set")
        rows_a_band = NARROW_ROWS
        items = keep(arrow(wide, _narrow_bands(bands_for(percent, rows_a_band), rows_a_band),
                           "key binary, size long, bands array<long>"), "narrow")
