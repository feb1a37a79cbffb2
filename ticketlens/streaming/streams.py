"""Structured Streaming forms of scoring, windowed counts, drift and SLA (K1-K4).

Sources are file streams with explicit schemas (no inference); sinks are
parquet (append) or ``foreachBatch`` for outputs that need batch-only
operators.  Checkpoints and outputs live under the shared
``spark.checkpoint.dir`` so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import constants as K
from ticketlens.operators import drift as D
from ticketlens.operators import labels as L
from ticketlens.operators import scoring as S
from ticketlens.session import scratch_path, stored

EMBEDDINGS_SCHEMA = "vec_id long, embedding array<float>, label int"
EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet file stream over a table: a folder of part files, or one file (a
    stream's base path must be a folder, so that is read as its folder's only match)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return r.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return r.parquet(path)


def run_available(query_builder) -> None:
    """Start a streaming write with an ``availableNow`` trigger and wait for it."""
    q = query_builder.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def score_stream(logits_stream: DataFrame, out_path: str, checkpoint: str,
                 threshold: float = K.AUTO_ROUTE_THRESHOLD) -> None:
    """K1: decode logits as they arrive and append the routed rows to parquet.

    Every operator in the decode is a projection or a stream-static join
    with a fixed dimension, so the stream keeps no state.
    """
    scored = S.decode_logits(S.logits_from_embeddings(logits_stream), threshold=threshold)
    run_available(scored.writeStream.format("parquet").option("path", out_path)
                  .option("checkpointLocation", checkpoint).outputMode("append"))


def with_event_time(stream: DataFrame, ts_col: str = "ts", out_col: str = "event_time") -> DataFrame:
    """Watermarks need a TIMESTAMP (not TIMESTAMP_NTZ) column; the session time
    zone is UTC, so the cast keeps the wall-clock values."""
    return stream.withColumn(out_col, F.col(ts_col).cast("timestamp"))


def windowed_counts(stream: DataFrame, time_col: str, window: str, keys, watermark: str) -> DataFrame:
    """K2: tumbling-window counts per key with a watermark bounding the state."""
    return (stream.withWatermark(time_col, watermark)
                  .groupBy(F.window(time_col, window).alias("w"), *keys)
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n"))


def write_closed_windows(agg: DataFrame, out_path: str, checkpoint: str) -> None:
    """Append each window once the watermark has passed its end (bounded state;
    the newest, still-open windows are emitted by later input)."""
    run_available(agg.writeStream.format("parquet").option("path", out_path)
                  .option("checkpointLocation", checkpoint).outputMode("append"))


def drift_per_batch(stream: DataFrame, reference: DataFrame, numeric_cols, out_path: str, checkpoint: str,
                    categorical_cols=()) -> None:
    """K3: for every micro-batch, J6 verdicts against a fixed reference, stored
    per batch id (``foreachBatch``: the drift operators use windows that a
    stream cannot run directly).  Each batch overwrites its own
    ``batch_id=N`` folder, so a retried batch replaces its output instead of
    appending it twice."""
    ref_counts = stored(D.value_counts(reference, numeric_cols, "n_ref"), "reference")  # once, not per batch

    def sink(batch_df, epoch_id):
        v = D.drift_verdicts(reference, batch_df, numeric_cols, categorical_cols, ref_counts=ref_counts)
        v.write.mode("overwrite").parquet(f"{out_path}/batch_id={int(epoch_id)}")
    run_available(stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint))


def window_value_counts(stream: DataFrame, time_col: str, window: str, watermark: str, numeric_cols, categorical_cols=()) -> DataFrame:
    """The state of K3: rows per (window, feature, value), ``value`` of numeric
    columns, ``name`` of categorical ones.  The watermark bounds it and drops
    rows that come later than that.  Numbers should be counts or rounded: the
    state holds one row per distinct value and open window."""
    items = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("name"))
             for c in numeric_cols]
    items += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("name"))
              for c in categorical_cols]
    each = stream.withWatermark(time_col, watermark).select(time_col, F.explode(F.array(*items)).alias("x"))
    return (each.groupBy(F.window(time_col, window).alias("w"), "x.feature", "x.value", "x.name").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "feature", "value", "name", "n"))


WINDOW_VERDICTS = ("window_start timestamp, feature string, method string, score double, threshold double, "
                   "drift_detected boolean, status string")


def drift_per_window(stream: DataFrame, reference: DataFrame, time_col: str, window: str, watermark: str, numeric_cols,
                     out_path: str, checkpoint: str, categorical_cols=()) -> None:
    """K3 by event time: when the watermark closes a window, its values are compared
    with the reference (J6).  A window closes in one micro-batch, whatever batches
    its rows came in; a retried batch replaces its own folder."""
    ref_numeric = stored(D.value_counts(reference, numeric_cols, "n_ref"), "reference")
    ref_categorical = stored(D.value_counts(reference, categorical_cols, "n_ref", "string"), "reference")
    counts = window_value_counts(stream, time_col, window, watermark, numeric_cols, categorical_cols)

    def sink(batch_df, epoch_id):
        closed = stored(batch_df, "closed")  # read twice below
        if not closed.isEmpty():
            v = D.verdicts_per_key(closed, ref_numeric, ref_categorical, "window_start")
            v.write.mode("overwrite").parquet(f"{out_path}/batch_id={int(epoch_id)}")
    run_available(counts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint))


def sla_stream(ticket_stream: DataFrame, out_path: str, checkpoint: str, opened_col: str = "opened_at") -> None:
    """K4: SLA deadline and breach flag per ticket as it arrives (stateless)."""
    t = L.priority_sla(ticket_stream, opened_col=opened_col)
    t = t.withColumn("sla_breached", F.col("response_minutes") > F.col("sla_minutes"))
    run_available(t.writeStream.format("parquet").option("path", out_path)
                  .option("checkpointLocation", checkpoint).outputMode("append"))


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh (output, checkpoint) folders under the shared checkpoint dir."""
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"
