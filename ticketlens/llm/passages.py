"""Repeated passages: whatever repeats, wherever its lines break.

``paragraphs.repeated`` compares whole lines.  Here the paragraphs are all runs of
``min_words`` words of a document (in lower case for A-Z), over any line breaks:

* Banding.  A run's MinHash is the least hash of the shorter runs in it (eleven
  words for twenty), its anchor.  Neighbours mostly share it, so about one place
  in five words is counted.  Equal runs have equal anchors; and a passage with a
  Jaccard similarity of 0.8 over five-word shingles differs in one place per 45
  words at most, so it holds such a run, too: no such pair is lost.
* Joining.  Anchors are sorted over ranges; each meets its first occurrence (by
  id, then text, then place), also if it stands in most documents.  Anchors of two
  documents that follow each other at one distance make an equal run.
* Verifying.  The words beside both ends, of the document and of the first
  occurrence, are compared, which gives the exact borders.  Runs with changed
  words between them are joined as long as the passages on both sides have a
  Jaccard similarity of 0.8, by the shingles known to be equal.  Passages of
  ``min_words`` words or more count.
* Removal.  First occurrences stay; the other occurrences go, overlapping ones as one.

Where the first occurrence of an anchor stands in a shorter passage than later
ones share, up to nine words (of twenty) at an end of these stay.

Runs of one document that overlap are no repeats of each other, and a run of
one word over and over is no passage (unless it is a line).  Equal runs of fewer
than ``min_words`` words stay.  Null ids and repeated rows are taken as in
``paragraphs``.  Tables between steps are dropped as soon as the result is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import Steps, arrow, read, slices
from ticketlens.llm.paragraphs import _FACTORS, _U, MIN_WORDS, SHINGLE, SIMILARITY, _mix, repeated, units, word_hashes

#: A side of a join is broadcast up to so many bytes, as counted.
BROADCAST_BYTES = 8 << 20
#: Rows that a task gives out at once: a batch costs as much as many rows.
ROWS = 5000
#: Rows that meet one row of a join in one task.
SHARE = 2000


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, from those of half the length."""
    n, m, x = len(h) - k + 1, 1, _mix(h * _FACTORS[0] + _FACTORS[1])
    while 2 * m <= k:
        x = _mix(x[:len(x) - m] * _FACTORS[2] + x[m:])
        m *= 2
    return _mix(x[:n] * _FACTORS[3] + x[k - m:k - m + n])


def _anchors(h: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all runs of ``length`` words inside one
    document: of the runs of k words in one, the first with the least hash.
    Neighbouring anchors overlap or touch.  Those of one word over and over are
    left out."""
    k = anchor_words(length)
    if len(h) < length:
        return np.zeros(0, dtype=np.int64), h[:0]
    s = _runs(h, k)
    at = _first_least(s, length - k + 1)[doc[:len(h) - length + 1] == doc[length - 1:]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    if k > 1:
        new = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        at = at[new[at + k - 1] > new[at]]
    return at, s[at]


def _first_least(s: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each ``w`` neighbours, by the high 44 bits (the first
    of equal ones): the place itself fills the low bits."""
    low = _U((1 << 20) - 1)
    if len(s) > 1 << 20:  # places beyond the low bits
        m = (1 << 20) - w + 1
        return np.concatenate([_first_least(s[i:i + m + w - 1], w) + i for i in range(0, len(s) - w + 1, m)])
    n, m, x = len(s) - w + 1, 1, (s & ~low) | np.arange(len(s), dtype=np.uint64)
    while 2 * m <= w:
        x = np.minimum(x[:len(x) - m], x[m:])
        m *= 2
    return (np.minimum(x[:n], x[w - m:w - m + n]) & low).astype(np.int64)


def _of(length: int):
    return lambda h, doc: _anchors(h, doc, length)


def anchor_words(length: int) -> int:
    return (length + 2) // 2


#: For each byte, whether it parts words.
_BLANK = bytes(b == 32 or 9 <= b <= 13 for b in range(256))


def _places(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop (in characters) and line of each word of a text in UTF-8."""
    b = np.frombuffer(raw, dtype=np.uint8)
    blank = np.frombuffer(b"\x01" + raw.translate(_BLANK) + b"\x01", dtype=np.uint8)
    borders = np.flatnonzero(blank[1:] != blank[:-1])
    line = np.searchsorted(np.flatnonzero(b == 10), borders[::2])
    if not raw.isascii():
        borders = borders - np.searchsorted(np.flatnonzero((b & 0xC0) == 0x80), borders)
    return borders[::2], borders[1::2], line


_MATCHES = "h long, row long, doc_id long, at int, row0 long, doc0 long, at0 int, mark boolean"


def _matches():
    """Sorted rows (h, doc_id, row, at) of a task -> each with the first of its
    ``h`` in the task, if there is an earlier one; ``mark`` rows name the first of
    the first and the last ``h``, which may stand in other tasks."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())

    def run(batches):
        now = first = last = None

        def table(rows):
            cols = list(zip(*rows)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=[f.split()[0] for f in _MATCHES.split(", ")])
        for batch in batches:
            h = batch.column(0).to_numpy()
            same = h[1:] == h[:-1]
            wanted = np.concatenate([same, [True]]) | np.concatenate([[True], same])
            part, out = batch.filter(pa.array(wanted)), []
            for v, doc, row, at in zip(*(part.column(c).to_pylist() for c in range(4))):
                place = (row, doc, at)
                if v != now:
                    if now is None:
                        out.append((v, *place, *place, True))
                    now, first = v, place
                elif place != last:
                    out.append((v, *place, *first, False))
                last = place
            yield table(out)
        if now is not None:
            yield table([(now, *first, *first, True)])
    return run


_EQUAL = "row long, doc_id long, s int, e int, row0 long, doc0 long, s0 int, e0 int"


def _within(at: np.ndarray, first: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """For each place, the last earlier one with the same hash in the document
    that is ``length`` words before or more (-1: none).  ``first`` names the hash,
    and is its first place where ``own`` holds."""
    out = np.full(len(at), -1)
    order = np.lexsort((at, first))
    for some in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        here = np.append(first[some[0]], at[some]) if own[some[0]] else at[some]
        if here[-1] - here[0] >= length:
            before = np.searchsorted(here, at[some] - length, side="right") - 1
            out[some] = np.where(before >= 0, here[before], -1)
    return out


def _equal_runs(k: int, length: int):
    """(row, doc_id, [(h, at, row0, doc0, at0)]) -> runs of a document that equal
    runs of others, or earlier ones of its own.  What repeats over and over in a
    document (a period) is compared with itself, at one distance."""
    def runs(m, row, doc):
        h, at, row0, at0, d, null = m
        own = (row0 == row) & (null if doc is None else ~null & (d == doc))
        if own.any() or len(np.unique(h)) < len(h):
            _, first = np.unique(h, return_inverse=True)
            before = _within(at, np.where(own, at0, -1 - first), own, length)
            inside = before >= 0
            row0, at0 = np.where(inside, row, row0), np.where(inside, before, at0)
            null, d = np.where(inside, doc is None, null), np.where(inside, doc or 0, d)
        shift = at - at0
        order = np.lexsort((at, shift, d, null, row0))
        a = at[order]
        begins = np.ones(len(a), dtype=bool)
        begins[1:] = a[1:] > a[:-1] + k
        for key in (row0, d, null, shift):
            x = key[order]
            begins[1:] |= x[1:] != x[:-1]
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(a)) - 1
        f = order[begin]
        return a[begin], a[end] + k, row0[f], d[f], null[f], at0[f], at0[order[end]] + k

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            m = lists.flatten()
            h, at, row0, at0 = (m.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("h", "at", "row0", "at0"))
            null = m.field("doc0").is_null().to_numpy(zero_copy_only=False)
            d = m.field("doc0").fill_null(0).to_numpy(zero_copy_only=False)
            out = []
            for i, (row, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                part = slice(ends[i] - ends[0], ends[i + 1] - ends[0])
                out.append(runs([x[part] for x in (h, at, row0, at0, d, null)], row, doc))
            if not out:
                continue
            rows = pa.array(np.repeat(np.arange(len(out)), [len(x[0]) for x in out]))
            s, e, r0, d0, n0, s0, e0 = (np.concatenate([x[c] for x in out]) for c in range(7))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)),
                 pa.array(r0), pa.array(d0.astype(np.int64), mask=n0.astype(bool)), pa.array(s0.astype(np.int32)),
                 pa.array(e0.astype(np.int32))], names=[x.split()[0] for x in _EQUAL.split(", ")])
    return run


_BORDERS = "row0 long, doc0 long, side boolean, b int, words array<int>, chars array<int>, lines array<int>"


def _borders(reach: int):
    """(row, doc_id, text, [(side, b)]) -> the words before (false) or after (true)
    place b, nearest first, and where a span that takes 0, 1, ... of them would
    begin or stop, in characters, with the line of its outermost word."""
    def table(out):
        row, doc, side, b, words, chars, lines = zip(*out)

        def lists(arrays):
            ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays).astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(side, pa.bool_()), pa.array(b, pa.int32()),
             lists(words), lists(chars), lists(lines)], names=[x.split()[0] for x in _BORDERS.split(", ")])

    def run(batches):
        out = []
        for batch in batches:
            for row, doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4))):
                raw = (text or "").encode()
                h = _short(word_hashes(raw.lower().split()))
                start, stop, line = _places(raw)
                for w in wanted:
                    b, n = w["b"], len(h)
                    if b > n or (not w["side"] and b >= n):  # another text of the same hash and id
                        continue
                    some = np.arange(b, min(b + reach, n)) if w["side"] else np.arange(b - 1, max(b - reach, 0) - 1, -1)
                    edge = np.concatenate([[b - 1 if w["side"] else b], some])
                    out.append((row, doc, w["side"], b, h[some], (stop if w["side"] else start)[edge], line[edge]))
                if len(out) >= ROWS:
                    yield table(out)
                    out = []
        if out:
            yield table(out)
    return run


def _short(h: np.ndarray) -> np.ndarray:
    """Half of each word's hash, for comparing a few words."""
    return (h >> _U(32)).astype(np.uint32).view(np.int32)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first words are the same."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _joined(runs: list[dict], min_words: int, similarity: float) -> list[dict]:
    """Passages from the equal runs (s, e, s0, e0) with one document, in order:
    neighbours are joined while the similarity of both sides holds."""
    out = []
    for r in runs:
        last = out[-1] if out else None
        if last and r["e"] - r["e0"] == last["e"] - last["e0"] and r["s"] <= last["e"]:
            if r["e"] > last["e"]:
                last["same"] += r["e"] - last["e"]
                last.update({x: r[x] for x in ("e", "e0", "stop0")})
            continue
        if last and last["e"] < r["s"] <= last["e"] + min_words and last["e0"] <= r["s0"] <= last["e0"] + min_words:
            same = last["same"] + max(r["same"], 0)
            a, b = r["e"] - last["s"] - SHINGLE + 1, r["e0"] - last["s0"] - SHINGLE + 1
            if same >= similarity * (a + b - same):
                last["same"] = same
                last.update({x: r[x] for x in ("e", "e0", "stop0")})
                continue
        out.append(r)
    return [r for r in out if r["e"] - r["s"] >= min_words]


_SPANS = ("row long, doc_id long, line int, start long, stop long, n_words long, kept_doc_id long, kept_line int, "
          "occurrences long, removed boolean")
_SPAN_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())


def _verified(min_words: int, similarity: float):
    """(row, doc_id, text, gone, equal runs with the words beside their other
    side) -> the passages that go, merged, and for each what it repeats."""
    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SPAN_TYPES)],
                                          names=[x.split()[0] for x in _SPANS.split(", ")])

    def run(batches):
        out = []
        for batch in batches:
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values
            plain = list(zip(*(flat.field(c).to_pylist() for c in ("s", "e", "row0", "doc0", "s0", "e0", "n"))))
            before, after = flat.field("before"), flat.field("after")
            known = (before.is_valid().to_numpy(zero_copy_only=False) & after.is_valid().to_numpy(zero_copy_only=False)).tolist()

            def nested(column, name):
                lists = column.field(name)
                at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                return lambda i: values[at[i]:at[i + 1]]
            words_before, words_after = nested(before, "words"), nested(after, "words")
            starts0, lines0, stops0 = nested(before, "chars"), nested(before, "lines"), nested(after, "chars")
            for i, (row, doc, text, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                mine = [j for j in range(ends[i], ends[i + 1]) if known[j] or (plain[j][2] == row and plain[j][3] == doc)]
                raw = (text or "").encode()
                h = _short(word_hashes(raw.lower().split()))
                if not mine or max(plain[j][1] for j in mine) > len(h):  # another text of the same hash and id
                    continue
                start, stop, line = _places(raw)
                of: dict = {}
                for j in mine:
                    s, e, row0, doc0, s0, e0, n = plain[j]
                    own = row0 == row and doc0 == doc
                    left = _agree(h[:s][::-1], h[:s0][::-1] if own else words_before(j))
                    right = _agree(h[e:], h[e0:] if own else words_after(j))
                    s, e, s0, e0 = s - left, e + right, s0 - left, e0 + right
                    of.setdefault((row0, doc0), []).append(
                        {"s": s, "e": e, "s0": s0, "e0": e0, "same": e - s - SHINGLE + 1, "n": n or 2, "row0": row0, "doc0": doc0,
                         "start0": int(start[s0] if own else starts0(j)[left]), "line0": int(line[s0] if own else lines0(j)[left]),
                         "stop0": int(stop[e0 - 1] if own else stops0(j)[right])})
                found = []
                for some in of.values():
                    found += _joined(sorted(some, key=lambda r: (r["s"], r["s0"])), min_words, similarity)
                merged = []
                for r in sorted(found, key=lambda r: (r["s"], -r["e"], r["doc0"] is None, r["doc0"] or 0, r["row0"], r["s0"])):
                    if gone and line[r["s"]] == line[r["e"] - 1] and int(line[r["s"]]) in gone:
                        continue
                    if len(set(h[r["s"]:r["e"]].tolist())) == 1:
                        continue
                    own = (r["row0"], r["doc0"]) == (row, doc)
                    if own and r["e0"] > r["s"]:  # a period: the words before it stay
                        r["e0"], r["stop0"] = r["s"], int(stop[r["s"] - 1])
                    if not own or not any(m["s"] < r["e0"] and r["s0"] < m["e"] for m in merged):
                        out.append((r["row0"], r["doc0"], r["line0"], r["start0"], r["stop0"], r["e0"] - r["s0"], r["doc0"], r["line0"], r["n"], False))
                    if merged and r["s"] <= merged[-1]["e"]:
                        merged[-1]["e"], merged[-1]["n"] = max(merged[-1]["e"], r["e"]), max(merged[-1]["n"], r["n"])
                    else:
                        merged.append(dict(r))
                out += [(row, doc, int(line[m["s"]]), int(start[m["s"]]), int(stop[m["e"] - 1]), m["e"] - m["s"], m["doc0"], m["line0"], m["n"], True)
                        for m in merged]
                if len(out) >= ROWS:
                    yield table(out)
                    out = []
        if out:
            yield table(out)
    return run


def _settled(batches):
    """(row, doc_id, [spans]) -> the spans that go, and the first occurrences
    that stay: those inside a span that goes are none, contained ones no others."""
    for batch in batches:
        out = []
        for row, doc, found in zip(*(batch.column(c).to_pylist() for c in range(3))):
            last = None  # of a document's spans that go, none overlap
            for x in sorted(found, key=lambda x: (x["start"], not x["removed"], -x["stop"])):
                if last and not x["removed"] and x["stop"] <= last["stop"]:
                    continue
                last = x if not last or x["stop"] > last["stop"] else last
                out.append((row, doc, *x.values()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SPAN_TYPES)],
                                             names=[x.split()[0] for x in _SPANS.split(", ")])


def _attach(run: DataFrame, side: DataFrame, at: str, keep: Steps) -> DataFrame:
    """``run`` with the columns of ``side`` for (row0, doc0, ``at``).  What more than
    ``SHARE`` rows ask for is given to several tasks, a share of the rows each."""
    keys = ["row0", "doc0", at]
    side = side.withColumnsRenamed({c: f"{c}_" for c in keys})
    same = F.col("row0").eqNullSafe(F.col("row0_")) & F.col("doc0").eqNullSafe(F.col("doc0_")) & F.col(at).eqNullSafe(F.col(f"{at}_"))
    drop = [f"{c}_" for c in keys]
    hot = run.groupBy(*[F.col(c).alias(f"{c}_") for c in keys]).agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("k"))
    hot = keep(hot.where("k > 1"), "hot")
    n = hot.count()
    if not n:
        return run.join(side, same, "left").drop(*drop)
    hot = F.broadcast(hot) if n * 32 <= BROADCAST_BYTES else hot
    k = F.coalesce("k", F.lit(1))
    run = run.join(hot, same, "left").drop(*drop).withColumn("_salt", F.pmod(F.xxhash64("row", "doc_id", "s"), k).cast("int")).drop("k")
    hot = hot.withColumnsRenamed({c: f"_{c}" for c in drop})
    there = F.lit(True)
    for c in drop:
        there = there & F.col(c).eqNullSafe(F.col(f"_{c}"))
    side = side.join(hot, there, "left").drop(*[f"_{c}" for c in drop])
    side = side.withColumn("_t", F.explode(F.sequence(F.lit(0), k - 1))).drop("k")
    return run.join(side, same & (F.col("_salt") == F.col("_t")), "left").drop(*drop, "_salt", "_t")


def spans(docs: DataFrame, gone: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
          lists: DataFrame | None = None) -> DataFrame:
    """Spans of ``docs`` (row, doc_id, text) that repeat, in the columns of
    ``paragraphs.repeated``; ``gone`` (row, doc_id, line) are lines that go already;
    ``lists`` may give the anchors, as ``paragraphs.units`` makes them."""
    length = max(min_words, 1)
    k = anchor_words(length)

    def here(row: str, doc: str):
        return (F.col("row") == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(doc))

    with Steps(docs.sparkSession) as keep:
        lists = keep(units(docs, min_words, similarity, _of(length)), "anchors") if lists is None else lists
        each = lists.where("h is not null").select("row", "doc_id", F.posexplode("h").alias("i", "h"), F.col("at").alias("places"))
        order = [F.col("h"), F.asc_nulls_last("doc_id"), F.col("row"), F.col("at")]
        each = each.select("h", "doc_id", "row", F.col("places")[F.col("i")].alias("at"))
        each = each.repartitionByRange(*order).sortWithinPartitions(*order)
        met = keep(arrow(each, _matches(), _MATCHES), "matches")
        # an anchor in several tasks (two a task at most) has one first occurrence
        marks = met.where("mark").select("h", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "at").alias("p")).distinct()
        tops = keep(marks.groupBy("h").agg(F.min("p").alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "tops")
        over = (marks.join(tops, "h").where("p != top").select("h", "p.row", "p.doc_id", "p.at", F.col("top.row").alias("row0"),
                                                               F.col("top.doc_id").alias("doc0"), F.col("top.at").alias("at0")))
        all_ = met.where("not mark").drop("mark").join(F.broadcast(tops), "h", "left")  # 2 rows a task at most
        all_ = all_.select("h", "row", "doc_id", "at", *[F.when(F.col("top").isNull(), F.col(c)).otherwise(F.col(t)).alias(c)
                                                         for c, t in (("row0", "top.row"), ("doc0", "top.doc_id"), ("at0", "top.at"))])
        all_ = all_.unionByName(over)
        near = (F.col("row") == F.col("row0")) & F.col("doc_id").eqNullSafe(F.col("doc0")) & (F.col("at") < F.col("at0") + length)
        all_ = all_.where(~near)
        by_doc = all_.groupBy("row", "doc_id").agg(F.collect_list(F.struct("h", "at", "row0", "doc0", "at0")).alias("m"))
        equal = keep(arrow(by_doc, _equal_runs(k, length), _EQUAL), "equal")
        keep.drop(met, tops)
        # the words beside the first occurrences
        other = equal.where((F.col("row") != F.col("row0")) | ~F.col("doc_id").eqNullSafe(F.col("doc0")))
        counts = other.groupBy(F.col("row0").alias("r"), F.col("doc0").alias("d"), F.col("s0").alias("b")).agg((F.count(F.lit(1)) + 1).alias("n"))
        ends = other.select(F.col("row0").alias("r"), F.col("doc0").alias("d"), F.lit(True).alias("side"), F.col("e0").alias("b")).distinct()
        asked = counts.select("r", "d", F.lit(False).alias("side"), "b").unionAll(ends)
        asked = keep(asked.groupBy("r", "d").agg(F.collect_list(F.struct("side", "b")).alias("wanted")), "asked")
        size = asked.agg(F.sum(F.size("wanted") * 8 + 64)).first()[0] or 0
        asked = F.broadcast(asked) if size <= BROADCAST_BYTES else asked
        beside = keep(arrow(docs.join(asked, here("r", "d")).select("row", "doc_id", "text", "wanted"), _borders(length - k + 1), _BORDERS)
                      .dropDuplicates(["row0", "doc0", "side", "b"]), "beside")
        left = (beside.where("not side").withColumnRenamed("b", "s0")
                .join(counts, (F.col("row0") == F.col("r")) & F.col("doc0").eqNullSafe(F.col("d")) & (F.col("s0") == F.col("b")))
                .select("row0", "doc0", "s0", "n", F.struct("words", "chars", "lines").alias("before")))
        right = beside.where("side").select("row0", "doc0", F.col("b").alias("e0"), F.struct("words", "chars").alias("after"))
        run = _attach(_attach(equal, left, "s0", keep), right, "e0", keep)
        runs = run.groupBy(F.col("row").alias("r"), F.col("doc_id").alias("d")).agg(
            F.collect_list(F.struct("s", "e", "row0", "doc0", "s0", "e0", "n", "before", "after")).alias("runs"))
        lines = gone.groupBy(F.col("row").alias("r2"), F.col("doc_id").alias("d2")).agg(F.collect_set("line").alias("gone"))
        runs = runs.join(lines, (F.col("r") == F.col("r2")) & F.col("d").eqNullSafe(F.col("d2")), "left")
        ready = docs.join(runs, here("r", "d")).select("row", "doc_id", "text", "gone", "runs")
        found = keep(arrow(ready, _verified(length, similarity), _SPANS).distinct(), "found")
        columns = [c for c in found.columns if c not in ("row", "doc_id")]
        of_doc = found.groupBy("row", "doc_id").agg(F.collect_list(F.struct(*columns)).alias("spans"))
        return keep.spare(keep(arrow(of_doc, _settled, _SPANS), "spans"))


def _passages(df: DataFrame, doc_id: str, text: str, min_words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The repeated lines and the spans beside them, both written and with ``row``."""
    docs = df.select(F.xxhash64(F.col(f"`{text}`").cast("string")).alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                     F.col(f"`{text}`").cast("string").alias("text"))
    with Steps(df.sparkSession) as keep:  # texts are cut into words once for both
        found = keep(units(docs, min_words, similarity, _of(max(min_words, 1))), "units")
        lines = repeated(df, doc_id, text, min_words, similarity, row=True, found=found)
        return lines, spans(docs, lines.where("removed").select("row", "doc_id", "line"), min_words, similarity, lists=found)


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                      similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``paragraphs.repeated`` and, beside them, one row per span of
    words that repeats over other borders.  ``line`` and ``kept_line`` of a span
    are those it begins in, its ``occurrences`` those of the most frequent beginning
    in it.  A span may reach into a line that is removed as well."""
    lines, more = _passages(df, doc_id, text, min_words, similarity)
    return lines.unionByName(more).drop("row")


def _without(text: str, gone: set, cut: list[tuple[int, int]]) -> str:
    """``text`` less the lines and the (merged, ordered) spans; a line that
    loses its last word goes, and one separator stays where words are cut."""
    out, at, k = [], 0, 0
    for i, line in enumerate(text.split("\n")):
        stop, here = at + len(line), []
        while k < len(cut) and cut[k][1] <= at:
            k += 1
        j = k
        while j < len(cut) and cut[j][0] < stop:
            here.append((max(cut[j][0] - at, 0), min(cut[j][1] - at, len(line))))
            j += 1
        at = stop + 1
        if i in gone:
            continue
        if here:
            left, done = "", 0
            for a, b in here:
                left += line[done:a]
                done = b + len(line[b:]) - len(line[b:].lstrip(" \t\r\x0b\x0c"))
            line = left + line[done:] if done < len(line) else left.rstrip(" \t\r\x0b\x0c")
            if not line.strip(" \t\r\x0b\x0c"):
                continue
        out.append(line)
    return "\n".join(out)


def without_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                     similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with the removed lines and spans cut from its texts, and
    ``passages_removed`` (int), their number.  Other columns and rows stay as they are."""
    lines, more = _passages(df, doc_id, text, min_words, similarity)
    both = (lines.withColumn("whole", F.lit(True)).unionByName(more.withColumn("whole", F.lit(False))).where("removed"))
    gone = (both.groupBy(F.col("row").alias("__r"), F.col("doc_id").alias("__d"))
            .agg(F.collect_set(F.struct("whole", "line", "start", "stop")).alias("__gone")))
    here = ((F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col("__r"))
            & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__d")))
    joined = df.drop("passages_removed").join(gone, here, "left")
    columns = [c for c in df.columns if c not in (text, "passages_removed")]
    packed = joined.select(*[F.col(f"`{c}`") for c in columns], F.col("__gone"), F.col(f"`{text}`"))
    cut = packed.where(F.col("__gone").isNotNull())

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(len(columns) + 1)):
                part, new, counts = batch.slice(a, b - a), [], []
                for gone, t in zip(part.column(len(columns)).to_pylist(), part.column(len(columns) + 1).to_pylist()):
                    new.append(_without(t, {g["line"] for g in gone if g["whole"]},
                                        sorted((g["start"], g["stop"]) for g in gone if not g["whole"])))
                    counts.append(len(gone))
                yield pa.RecordBatch.from_arrays([*part.columns[:len(columns)], pa.array(new, pa.string()),
                                                  pa.array(counts, pa.int32())], names=[*columns, text, "passages_removed"])

    rest = packed.where(F.col("__gone").isNull()).drop("__gone").withColumn("passages_removed", F.lit(0))
    done = cut.mapInArrow(run, rest.schema).unionByName(rest)
    return done.select(*df.drop("passages_removed").columns, "passages_removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents", "doc_id", "text"))
