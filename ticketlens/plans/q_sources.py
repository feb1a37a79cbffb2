"""Catalogue: file sources and sinks, written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.operators import labels as L
from ticketlens.plans import oracle as O
from ticketlens.plans.q_drift import _with_drift, verdicts
from ticketlens.plans.registry import query
from ticketlens.session import scratch_path
from ticketlens.sources import csv_records as C
from ticketlens.sources import files as SF
from ticketlens.sources import tables as T

#: doc_id % 40 of the records that are written badly: a quote that is never
#: closed, text after a closing quote, a field too many, an id that is no number.
UNCLOSED, AFTER, MORE, NO_NUMBER = 3, 7, 11, 13

_QUOTED_SQL = "('\"' || replace(text, '\"', '\"\"') || '\"')"


def csv_with_bad_records(spark, sf_dir) -> str:
    """The documents as CSV text, one record in ten of them bad; the folder."""
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    kind = F.pmod("doc_id", F.lit(40))
    head = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.col("source"), F.lit('",'))
    line = (F.when(kind == UNCLOSED, F.concat(head, F.lit('"'), F.regexp_extract("text", "[a-z]+", 0)))
            .when(kind == AFTER, F.concat(head, F.lit('"x" tail')))
            .when(kind == MORE, F.concat(head, quoted, F.lit(",more")))
            .when(kind == NO_NUMBER, F.concat(F.lit("n/a"), head, quoted))
            .otherwise(F.concat(head, quoted)))
    path = scratch_path(spark, "csv-text")
    T.read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).select(line.alias("value")).write.text(path)
    return path


def _read(spark, sf_dir) -> C.CsvRead:
    return C.read_csv_rejecting(spark, csv_with_bad_records(spark, sf_dir), "doc_id long, source string, text string",
                                csv_only=False, header=False)


@query("a5_csv_rows", f"""
SELECT doc_id, source, text FROM documents WHERE doc_id % 40 NOT IN ({UNCLOSED}, {AFTER}, {MORE}, {NO_NUMBER})""")
def a5_csv_rows(spark, sf_dir):
    """A5: the records that parse, line breaks inside quotes and all, whatever stands between them."""
    return _read(spark, sf_dir).rows


@query("a5_csv_rejects", f"""
SELECT * FROM (
  SELECT CASE doc_id % 40
           WHEN {UNCLOSED} THEN doc_id || ',"' || source || '","' || regexp_extract(text, '[a-z]+')
           WHEN {AFTER} THEN doc_id || ',"' || source || '","x" tail'
           WHEN {MORE} THEN doc_id || ',"' || source || '",' || {_QUOTED_SQL} || ',more'
           WHEN {NO_NUMBER} THEN 'n/a' || doc_id || ',"' || source || '",' || {_QUOTED_SQL} END AS record,
         CASE doc_id % 40 WHEN {UNCLOSED} THEN {O.q(C.UNCLOSED)} WHEN {AFTER} THEN {O.q(C.AFTER_QUOTE)}
           WHEN {MORE} THEN '4 fields, not 3' WHEN {NO_NUMBER} THEN 'not of the schema''s types' END AS reason
  FROM documents) r WHERE record IS NOT NULL""")
def a5_csv_rejects(spark, sf_dir):
    """A5: the records that do not, each with its reason."""
    return _read(spark, sf_dir).rejects.select("record", "reason")


@query("a7_label_mappings", """
SELECT 'label' AS kind, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS id, source AS name
FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s""")
def a7_label_mappings(spark, sf_dir):
    """The mapping of the raw labels, written as JSON and read again."""
    dim = L.dense_ids(T.load_corpus_a(spark, sf_dir), "label_name", "id")
    path = scratch_path(spark, "mappings")
    SF.write_mappings(dim.select(F.lit("label").alias("kind"), "id", F.col("label_name").alias("name")), path)
    return SF.read_mappings(spark, path)


@query("a14_drift_report", _with_drift(
    "SELECT *, CASE WHEN drift_detected THEN 'DRIFT' ELSE 'OK' END AS status FROM verdicts"))
def a14_drift_report(spark, sf_dir):
    """The drift report as a table in folders by scenario, written and read again."""
    path, report = scratch_path(spark, "report"), verdicts(spark, sf_dir)
    SF.write_table(report, path, partition_by="scenario")
    return spark.read.schema(report.schema).parquet(path).select(*report.columns)
