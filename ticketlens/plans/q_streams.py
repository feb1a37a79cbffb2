"""Catalogue: streams (K1-K4).  Streaming queries run with an ``availableNow``
trigger over the driver tables as file streams; the registered query returns
what the sink wrote.  K1 and K4 are checked against the batch SQL (a stream
must equal the batch over the same files); K2 has a batch form with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlens.plans import oracle as O
from ticketlens.plans.q_scoring import DECODED, EVENT_PRIORITY, K4_SQL, event_tickets
from ticketlens.plans.registry import query
from ticketlens.streaming import streams as ST
from ticketlens.plans import fixtures as FX
from ticketlens.operators import drift as D
from ticketlens import constants as K
from ticketlens.sources import tables as T
from ticketlens.plans.q_drift import CATEGORICAL, CATEGORICAL_SQL, NUMERIC, NUMERIC_SQL, SPLIT, VERDICTS_SQL


_K1_COLS = ["ticket_id", "category", "category_confidence", "priority", "priority_confidence",
            "review_status", "review_reason", "routing_team"]


@query("k1_stream_scoring", f"WITH {DECODED} SELECT {', '.join(_K1_COLS)} FROM decoded")
def k1_stream_scoring(spark, sf_dir):
    """K1: logits stream -> decode -> gate -> parquet sink; equals the batch I10 rows."""
    out, ckpt = ST.stream_paths(spark, "k1")
    src = ST.file_stream(spark, T.table_path(sf_dir, "embeddings"), ST.EMBEDDINGS_SCHEMA)
    ST.score_stream(src, out, ckpt)
    return spark.read.parquet(out).select(*_K1_COLS)


_PRI = O.values(EVENT_PRIORITY.items(), ["event_type", "priority"])


K2_SQL = f"""
SELECT time_bucket(INTERVAL 1 DAY, e.ts) AS window_start, time_bucket(INTERVAL 1 DAY, e.ts) + INTERVAL 1 DAY AS window_end,
       p.priority, count(*) AS n
FROM events e JOIN {_PRI} p ON e.event_type = p.event_type GROUP BY ALL"""


@query("k2_window_counts", K2_SQL)
def k2_window_counts(spark, sf_dir):
    """K2 (batch form): daily tumbling-window ticket counts per priority."""
    t = event_tickets(spark, sf_dir)
    w = t.groupBy(F.window("opened_at", "1 day").alias("w"), "priority").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "priority", "n")


# A window closes once the watermark (latest event less one day) has passed its
# end.  Spark moves the watermark between micro-batches, to the millisecond.
K2_CLOSED_SQL = f"""
SELECT * FROM ({K2_SQL}) w
WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)"""


@query("k2_window_counts_stream", K2_CLOSED_SQL)
def k2_window_counts_stream(spark, sf_dir):
    """K2 on a stream: each window is appended once the watermark closes it, so
    the state stays bounded; bounds come back as wall-clock (NTZ) values."""
    out, ckpt = ST.stream_paths(spark, "k2")
    src = ST.file_stream(spark, T.table_path(sf_dir, "events"), ST.EVENTS_SCHEMA)
    tickets = ST.with_event_time(event_tickets(spark, sf_dir, source=src), "opened_at", "event_time")
    agg = ST.windowed_counts(tickets, "event_time", "1 day", ["priority"], "1 day")
    ST.write_closed_windows(agg, out, ckpt)
    r = spark.read.schema(agg.schema).parquet(out)
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "priority", "n")


_K3_SIDES = f"""sides AS (
  SELECT 'k3' AS scenario, 'ref' AS side, CAST(length(text) AS INTEGER) AS text_length,
         {O.word_count('text')} AS word_count, category_id
  FROM split_tickets WHERE split = 'train'
  UNION ALL
  SELECT 'k3', 'cur', CAST(length(text) AS INTEGER), {O.word_count('text')}, CAST((conv_id + turn) % {len(K.CATEGORIES)} AS INTEGER)
  FROM conversations WHERE role = 'user')"""


# One file and an availableNow trigger make exactly one micro-batch (id 0),
# so its verdicts equal the batch drift of all user turns against training.
@query("k3_drift_per_batch", O.with_tickets(
    "SELECT feature, method, score, threshold, drift_detected, "
    "CASE WHEN drift_detected THEN 'DRIFT' ELSE 'OK' END AS status, CAST(0 AS INTEGER) AS batch_id FROM numeric",
    SPLIT, _K3_SIDES, NUMERIC_SQL))
def k3_drift_per_batch(spark, sf_dir):
    """K3: each micro-batch of incoming tickets (user turns arriving as a file
    stream) is checked for drift against the training split."""
    out, ckpt = ST.stream_paths(spark, "k3")
    ref = D.monitor_features(FX.split_tickets(spark, sf_dir).filter(F.col("split") == "train"))
    src = ST.file_stream(spark, T.table_path(sf_dir, "conversations"),
                         "conv_id long, turn long, role string, text string")
    predicted = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(K.CATEGORIES))).cast("int")
    cur = D.monitor_features(src.filter(F.col("role") == "user").withColumn("category_id", predicted))
    ST.drift_per_batch(cur, ref, ["text_length", "word_count", "category_id"], out, ckpt)
    return spark.read.parquet(out)


# K3 by event time: daily windows of event tickets against the first week.
REFERENCE_DAYS = 7
_K3_WINDOWS = f"""ev AS (
  SELECT e.ts, time_bucket(INTERVAL 1 DAY, e.ts) AS day, floor(e.value * 10.0) AS response_minutes, p.priority
  FROM events e JOIN {_PRI} p ON e.event_type = p.event_type),
bounds AS (SELECT min(day) + INTERVAL {REFERENCE_DAYS} DAY AS start, date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS mark FROM ev),
cur AS (SELECT ev.* FROM ev, bounds WHERE day >= start AND day + INTERVAL 1 DAY <= mark),
sides AS (
  SELECT DISTINCT_DAYS.day AS scenario, 'ref' AS side, response_minutes, priority
  FROM ev, bounds, (SELECT DISTINCT day FROM cur) DISTINCT_DAYS WHERE ev.day < start
  UNION ALL SELECT day, 'cur', response_minutes, priority FROM cur)"""


def _only(sql: str, columns: list[str], new: list[str], cast: str) -> str:
    from ticketlens.plans.q_drift import _long
    return sql.replace(_long(columns, cast), _long(new, cast))


@query("k3_drift_windows", f"""WITH {_K3_WINDOWS}, {_only(NUMERIC_SQL, NUMERIC, ['response_minutes'], 'DOUBLE')},
{_only(CATEGORICAL_SQL, CATEGORICAL, ['priority'], 'VARCHAR')}, {VERDICTS_SQL}
SELECT scenario AS window_start, feature, method, score, threshold, drift_detected,
       CASE WHEN drift_detected THEN 'DRIFT' ELSE 'OK' END AS status FROM verdicts""")
def k3_drift_windows(spark, sf_dir):
    """K3 on event time: each day that the watermark closes, against the first week."""
    out, ckpt = ST.stream_paths(spark, "k3w")
    events = T.read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    first = events.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    start = F.lit(first).cast("timestamp") + F.expr(f"INTERVAL {REFERENCE_DAYS} DAYS")
    minutes = F.floor("response_minutes").alias("response_minutes")
    ref = event_tickets(spark, sf_dir).where(F.col("opened_at").cast("timestamp") < start).select(minutes, "priority")
    src = event_tickets(spark, sf_dir, source=ST.file_stream(spark, T.table_path(sf_dir, "events"), ST.EVENTS_SCHEMA))
    src = ST.with_event_time(src, "opened_at", "event_time").select("event_time", minutes, "priority")
    ST.drift_per_window(src.where(F.col("event_time") >= start), ref, "event_time", "1 day", "1 day", ["response_minutes"], out, ckpt, ["priority"])
    r = spark.read.schema(ST.WINDOW_VERDICTS).parquet(out)
    return r.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("batch_id")


@query("j7_drift_alerts", O.with_tickets(
    f"SELECT feature, method, score FROM numeric WHERE method <> 'ks' AND score > {K.DRIFT_ALERT_SCORE}",
    SPLIT, _K3_SIDES, NUMERIC_SQL))
def j7_drift_alerts(spark, sf_dir):
    """Alerts of all user turns against training (their texts are much shorter)."""
    ref = D.monitor_features(FX.split_tickets(spark, sf_dir).filter(F.col("split") == "train"))
    turns = T.read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).filter(F.col("role") == "user")
    predicted = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(K.CATEGORIES))).cast("int")
    cur = D.monitor_features(turns.withColumn("category_id", predicted))
    v = D.drift_verdicts(ref, cur, ["text_length", "word_count", "category_id"])
    return D.drift_alerts(v).select("feature", "method", "score")


_K4_COLS = ["ticket_id", "opened_at", "priority", "sla_label", "sla_minutes", "sla_deadline", "sla_breached"]


@query("k4_sla_stream", K4_SQL.replace(
    "SELECT e.event_id AS ticket_id,",
    "SELECT * EXCLUDE (response_minutes) FROM (SELECT e.event_id AS ticket_id,", 1) + ") s")
def k4_sla_stream(spark, sf_dir):
    """K4 on a stream: deadline and breach per event ticket as it arrives."""
    out, ckpt = ST.stream_paths(spark, "k4")
    src = ST.file_stream(spark, T.table_path(sf_dir, "events"), ST.EVENTS_SCHEMA)
    ST.sla_stream(event_tickets(spark, sf_dir, source=src), out, ckpt)
    return spark.read.parquet(out).select(*_K4_COLS)
