"""CSV with line breaks inside quotes, read by splits, bad records set apart.

Spark's own multi-line reader gives a file to one task, and in FAILFAST mode one
bad line ends the job.  Here a file is read as lines, split by split:

1. Every split is scanned once for both cases, that it begins at a record or
   inside quotes: where the record that it begins in ends, whether it ends inside
   quotes, and the text of the records that cross its borders.
2. Per file, the splits' cases follow from each other in order, a few numbers a
   split.  The driver gets one number for each split that begins inside quotes
   (it plans one entry for every split anyway).
3. The splits are read again, each from its known beginning, and give records;
   those that cross a border are joined from the first pass.

Records are parsed by Spark (``from_csv``).  A record that does not fit is set
apart with a reason, and nothing else is lost with it: where a quote is never
closed, the record's first line goes and reading resumes at the next line.  That
is known once a quote is followed by other text than a delimiter (a quoted field
cannot go on so), at the end of the file, or if a whole split lies inside quotes,
so a record is smaller than a split (``spark.sql.files.maxPartitionBytes``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import ship, stored

COMPLETE, OPEN, BAD = range(3)
UNCLOSED, AFTER_QUOTE = "quote never closed", "text after a closing quote"


class CsvRead(NamedTuple):
    """Parsed rows, and the records set apart: ``path, record, reason``."""
    rows: DataFrame
    rejects: DataFrame


def scan(line: str, inside: bool, delimiter: str = ",") -> tuple[int, int]:
    """Whether a line that begins inside quotes or at a record completes the
    record, leaves it open or is bad, and the delimiters outside quotes."""
    at, n, size = 0, 0, len(line)
    while True:
        if not inside:
            if line.startswith('"', at):
                inside, at = True, at + 1
            else:
                cut = line.find(delimiter, at)  # quotes inside a bare field are part of it
                if cut < 0:
                    return COMPLETE, n
                n, at = n + 1, cut + 1
                continue
        quote = line.find('"', at)
        if quote < 0:
            return OPEN, n
        if line.startswith('"', quote + 1):
            at = quote + 2
            continue
        at, inside = quote + 1, False
        if at == size or line[at:] == "\r":
            return COMPLETE, n
        if not line.startswith(delimiter, at):
            return BAD, n
        n, at = n + 1, at + 1


class Records:
    """Records and rejects from lines in order, beginning at a record."""

    def __init__(self, delimiter: str):
        self.delimiter, self.pending, self.delimiters = delimiter, [], 0
        self.out: list[tuple[str, int, str | None]] = []  # text, number of fields, reason of a reject

    def add(self, line: str) -> None:
        todo = deque([line])
        while todo:
            line = todo.popleft()
            status, n = scan(line, bool(self.pending), self.delimiter)
            if status == BAD and self.pending:  # the quote that opened the record was never closed
                todo.appendleft(line)
                todo.extendleft(reversed(self._give_up()))
            elif status == BAD:
                self.out.append((line.removesuffix("\r"), 0, AFTER_QUOTE))
            elif status == OPEN:
                self.pending.append(line)
                self.delimiters += n
            else:
                text = "\n".join([*self.pending, line.removesuffix("\r")])
                if text:
                    self.out.append((text, self.delimiters + n + 1, None))
                self.pending, self.delimiters = [], 0

    def _give_up(self) -> list[str]:
        first, rest = self.pending[0], self.pending[1:]
        self.out.append((first.removesuffix("\r"), 0, UNCLOSED))
        self.pending, self.delimiters = [], 0
        return rest

    def end(self) -> None:
        """No more lines: what is open was never closed."""
        while self.pending:
            for line in self._give_up():
                self.add(line)


def split_id(path: str, start: int) -> int:
    import zlib
    raw = f"{start}:{path}".encode()
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(path, start of the split, lines) of the splits in a batch of rows in order."""
    path, start = batch.column(0), batch.column(1).to_numpy()
    codes = path.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((start[1:] != start[:-1]) | (codes[1:] != codes[:-1])) + 1
    for a, b in zip([0, *edges], [*edges, len(start)]):
        if b > a:
            yield path[int(a)].as_py(), int(start[a]), batch.column(2).slice(int(a), int(b - a))


_SPLITS = "path string, start long, ends0 boolean, ends1 boolean, closes boolean, head string, tail0 string, tail1 string"


class _Split:
    """Both cases of one split, line by line."""

    def __init__(self, path: str, start: int, delimiter: str):
        self.path, self.start, self.delimiter = path, start, delimiter
        self.head: list[str] | None = []  # lines of the record that it begins in
        self.closed = False
        self.open: list[list[str]] = [[], []]  # lines of the open record, begun at a record or inside quotes

    def plain(self, lines: pa.Array) -> None:
        """Lines without quotes."""
        if not self.closed or any(self.open):
            texts = lines.to_pylist()
            if not self.closed:
                self.head += texts
            for o in self.open:
                if o:
                    o += texts

    def quoted(self, line: str) -> None:
        for case in (0, 1):
            if case == 1 and not self.closed:
                status, _ = scan(line, True, self.delimiter)
                if status == OPEN:
                    self.head.append(line)
                    continue
                self.closed = True
                if status == COMPLETE:
                    self.head.append(line)
                    continue
            o = self.open[case]
            status, _ = scan(line, bool(o), self.delimiter)
            if status == BAD and o:
                o.clear()
                status, _ = scan(line, False, self.delimiter)
            if status == OPEN:
                o.append(line)
            else:
                o.clear()

    def row(self) -> tuple:
        a, b = self.open
        text = lambda lines: "\n".join(lines) if lines else None
        head = "\n".join(self.head) if self.closed and self.head else None
        return self.path, self.start, bool(a), bool(b) if self.closed else True, self.closed, head, text(a), text(b)


def _both_cases(delimiter: str):
    def run(batches):
        names = [f.split()[0] for f in _SPLITS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        now: _Split | None = None
        for batch in batches:
            for path, start, lines in _runs(batch):
                if now is None or (now.path, now.start) != (path, start):
                    if now is not None:
                        yield table([now.row()])
                    now = _Split(path, start, delimiter)
                quotes = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
                at = 0
                for q in quotes.tolist():
                    if q > at:
                        now.plain(lines.slice(at, q - at))
                    now.quoted(lines[q].as_py())
                    at = q + 1
                if at < len(lines):
                    now.plain(lines.slice(at))
        if now is not None:
            yield table([now.row()])
    return run


def _in_order(batches):
    """(path, [(start, ends0, ends1, closes)]) -> per split whether it begins
    inside quotes, and the split after it."""
    for batch in batches:
        for path, splits in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
            splits = sorted(splits, key=lambda s: s["start"])
            inside, states = False, []
            for s in splits:
                inside = inside and s["closes"]  # a split all inside quotes: they were never closed
                states.append(inside)
                inside = s["ends1"] if inside else s["ends0"]
            n = len(splits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array([s["start"] for s in splits], pa.int64()), pa.array(states, pa.bool_()),
                 pa.array([s["start"] for s in splits[1:]] + [None], pa.int64())], names=["path", "start", "inside", "next"])


_RECORDS = "path string, record string, fields int, reason string"


def _table(paths: list[str], out: list[tuple[str, int, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()),
         pa.array([x[2] for x in out], pa.string())], names=[f.split()[0] for f in _RECORDS.split(", ")])


def _records(known: set[int], delimiter: str, header: bool):
    """Lines -> the records that end in the split they begin in; ``known`` are
    the splits that begin inside quotes."""
    def run(batches):
        split = head = first = records = None
        for batch in batches:
            for path, start, lines in _runs(batch):
                if split != (path, start):
                    split, records = (path, start), Records(delimiter)
                    head, first = split_id(path, start) in known, header and start == 0
                if not head and not first and not records.pending and not pc.any(pc.match_substring(lines, '"')).as_py():
                    text = pc.utf8_rtrim(lines, characters="\r")
                    text = text.filter(pc.not_equal(text, ""))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(text), pa.string()), text.cast(pa.string()),
                         pc.add(pc.count_substring(text, delimiter), 1).cast(pa.int32()), pa.nulls(len(text), pa.string())],
                        names=[f.split()[0] for f in _RECORDS.split(", ")])
                    continue
                for line in lines.to_pylist():
                    if head:
                        status, _ = scan(line, True, delimiter)
                        head = status == OPEN
                        if status != BAD:
                            continue
                    records.add(line)
                if first and records.out:
                    first, records.out = False, records.out[1:]
                yield _table([path] * len(records.out), records.out)
                records.out = []
    return run


def _crossing(delimiter: str):
    """(path, start, tail, head of the next split or null) -> its records; without
    a head that closes it, the tail's quote was never closed."""
    def run(batches):
        for batch in batches:
            for path, tail, head in zip(*(batch.column(c).to_pylist() for c in range(3))):
                records = Records(delimiter)
                for text in (tail, head):
                    for line in text.split("\n") if text is not None else ():
                        records.add(line)
                records.end()
                yield _table([path] * len(records.out), records.out)
    return run


def _lines(spark: SparkSession, path: str, csv_only: bool) -> DataFrame:
    r = spark.read.option("lineSep", "\n")
    if csv_only:
        r = r.option("pathGlobFilter", "*.csv")
    return r.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def read_records(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, csv_only: bool = True) -> DataFrame:
    """``path, record, fields, reason`` of every record under a path (without the
    first of each file, if that is the header); rejects have a reason."""
    ship(spark)
    lines = _lines(spark, path, csv_only)
    splits = stored(lines.mapInArrow(_both_cases(delimiter), _SPLITS), "csv-splits")
    order = splits.groupBy("path").agg(F.collect_list(F.struct("start", "ends0", "ends1", "closes")).alias("s"))
    states = stored(order.mapInArrow(_in_order, "path string, start long, inside boolean, next long"), "csv-states")
    inside = {split_id(r["path"], r["start"]) for r in states.where("inside").select("path", "start").collect()}
    whole = lines.mapInArrow(_records(inside, delimiter, header), _RECORDS)
    known = splits.join(states, ["path", "start"])
    tails = known.select("path", "next", F.when(F.col("inside"), F.col("tail1")).otherwise(F.col("tail0")).alias("tail"))
    heads = known.where("inside").select("path", F.col("start").alias("next"), "head")
    joined = tails.where("tail is not null").join(heads, ["path", "next"], "left").select("path", "tail", "head")
    return whole.unionAll(joined.mapInArrow(_crossing(delimiter), _RECORDS))


def read_csv_rejecting(spark: SparkSession, path: str, schema: str | T.StructType | None = None, delimiter: str = ",",
                       csv_only: bool = True, header: bool = True) -> CsvRead:
    """A5 + A11: CSV files by splits.  Without a schema every column of the first
    file's header is a string."""
    if schema is None:
        r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter)
        names = (r.option("pathGlobFilter", "*.csv") if csv_only else r).csv(path).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    n = len(schema.fields)
    found = read_records(spark, path, delimiter, header, csv_only)
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = F.from_csv("record", full, {"sep": delimiter, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE",
                                         "columnNameOfCorruptRecord": "__bad"})
    found = found.withColumn("__row", F.when(F.col("reason").isNull(), parsed))
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when(F.col("fields") != n, F.format_string(f"%d fields, not {n}", "fields"))
              .when(F.col("__row.__bad").isNotNull(), F.lit("not of the schema's types")))
    found = found.withColumn("reason", reason)
    rows = found.where("reason is null").select(*[F.col(f"__row.`{f.name}`").alias(f.name) for f in schema.fields])
    return CsvRead(rows, found.where("reason is not null").select("path", "record", "reason"))
