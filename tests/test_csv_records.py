"""Splitting CSV reader: equal to Spark's multi-line reader, and no row lost to a bad one."""
import csv
import io
import random

import pytest

from ticketlens.operators import scoring as S
from ticketlens.session import scratch_path
from ticketlens.sources import csv_records as C
from ticketlens.sources import files as SF


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


def write(spark, text, name="in.csv"):
    import os
    path = scratch_path(spark, "csv-in")
    os.makedirs(path)
    with open(f"{path}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def test_scan_follows_quotes():
    assert C.scan("a,b", False) == (C.COMPLETE, 1) and C.scan('a,"b', False) == (C.OPEN, 1)
    assert C.scan('b"",c', True)[0] == C.OPEN and C.scan('b","c', True) == (C.OPEN, 1)
    assert C.scan('x"', True) == (C.COMPLETE, 0) and C.scan('x"\r', True)[0] == C.COMPLETE
    assert C.scan('x"y', True)[0] == C.BAD and C.scan('"x"y,z', False)[0] == C.BAD
    assert C.scan('5" pipe,x"y', False) == (C.COMPLETE, 1) and C.scan("", True)[0] == C.OPEN


@pytest.mark.parametrize("size", [300, 5000, 1 << 20])
def test_same_rows_as_the_multi_line_reader_from_many_tasks(spark, small_splits, size):
    r = random.Random(size)
    piece = lambda: "".join(r.choice(["a", "é", '"', ",", "\n", "\r\n", " ", "b", "\n\n"]) for _ in range(r.randint(0, 40)))
    rows = [(i, "x" + piece(), piece() + "y") for i in range(150)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
    w.writerow(["ticket_id", "text", "note"])
    w.writerows(rows)
    path = write(spark, out.getvalue())
    schema = "ticket_id long, text string, note string"
    want = sorted(map(tuple, SF.read_csv(spark, path, schema).collect()))
    small_splits(size)
    got = C.read_csv_rejecting(spark, path, schema)
    if size < 1000:
        assert got.rows.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, got.rows.collect())) == want and got.rejects.count() == 0 and len(want) == 150


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_bad_records_go_alone(spark, small_splits, size):
    good = [f'{i},"text {i}\nsecond ""line"", {i}"' for i in range(60)]
    lines = list(good)
    lines[10:10] = ['900,"never closed']
    lines[20:20] = ['901,"a" b', "902,a,b,c", "x,y"]
    lines[40:40] = ["", '903,"never closed', '904,"nor this']
    lines += ['905,"open until the end', "906,plain"]
    path = write(spark, "ticket_id,text\r\n" + "\r\n".join(lines) + "\r\n")
    small_splits(size)
    got = C.read_csv_rejecting(spark, path, "ticket_id long, text string")
    rows = {r.ticket_id: r.text for r in got.rows.collect()}
    assert rows == {**{i: f'text {i}\nsecond "line", {i}' for i in range(60)}, 906: "plain"}
    rejects = sorted((r.record, r.reason) for r in got.rejects.collect())
    assert rejects == sorted([('900,"never closed', C.UNCLOSED), ('901,"a" b', C.AFTER_QUOTE), ("902,a,b,c", "4 fields, not 2"),
                              ("x,y", "not of the schema's types"), ('903,"never closed', C.UNCLOSED),
                              ('904,"nor this', C.UNCLOSED), ('905,"open until the end', C.UNCLOSED)])


def test_a_quote_that_swallows_whole_splits_is_given_up(spark, small_splits):
    lines = ['1,"open'] + [f"{i},no quote here" for i in range(2, 400)]
    small_splits(500)
    got = C.read_csv_rejecting(spark, write(spark, "ticket_id,text\n" + "\n".join(lines)), "ticket_id long, text string")
    assert sorted(r.ticket_id for r in got.rows.collect()) == list(range(2, 400))
    assert [r.record for r in got.rejects.collect()] == ['1,"open']


def test_only_csv_files_headers_and_empty_input(spark):
    path = write(spark, "b,a\n1,\n,\"\"\n")
    with open(f"{path}/other.txt", "w") as f:
        f.write("b,a\n7,8\n")
    with open(f"{path}/none.csv", "w") as f:
        f.write("")
    got = C.read_csv_rejecting(spark, path)
    assert got.rows.columns == ["b", "a"] and got.rejects.count() == 0
    want = [tuple(r) for r in SF.read_csv(spark, path).collect()]
    assert sorted(map(tuple, got.rows.collect()), key=str) == sorted(want, key=str) and len(want) == 2
    only = C.read_csv_rejecting(spark, write(spark, "a,b\n"))
    assert only.rows.count() == 0 and only.rejects.count() == 0


def test_batch_job_scores_the_rest(spark):
    from pyspark.sql import functions as F
    path = write(spark, 'ticket_id,text\n1,"line one\nline two"\n2,"bad" one\n3,fine\n')
    out, bad = scratch_path(spark, "out"), scratch_path(spark, "bad")

    def score(df):
        return df.selectExpr("*", "'c' as category", "'p' as priority", "0.5 as category_confidence", "'t' as routing_team")
    assert S.run_batch_job(spark, path, out, score, "ticket_id long, text string", bad) == 2
    back = C.read_csv_rejecting(spark, out).rows
    assert {r.ticket_id: r.text for r in back.collect()} == {"1": "line one\nline two", "3": "fine"}
    assert spark.read.parquet(bad).select(F.concat_ws("|", "record", "reason")).first()[0] == '2,"bad" one|' + C.AFTER_QUOTE
