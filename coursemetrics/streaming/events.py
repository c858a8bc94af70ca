"""Structured Streaming forms of the silver and engagement jobs.

Every runner takes the caller's output folder and checkpoint folder (both on shared storage) and drives the
stream to the end of its input (``availableNow``). A job that is run again with the same folders reads only
files it has not seen.

* ``run_to_table``: rows of a stream appended to a Parquet table; with ``stream_dedup``, repeated ``event_id`` are dropped
  within a watermark, so the state is bounded by its delay, and rows that come later than that are not taken.
* ``run_statements``: raw statements to silver and to a reject table, both from one pass over each micro-batch.
* ``run_engagement``: hourly windows per course and module. Each micro-batch leaves its partial counts and learner
  sketches; ``engagement_table`` adds them up. No window waits for a watermark, so the last hours are there as soon as
  they are read, late rows count in their own window, and there is no state to keep.

Tables of partial results have a folder for each micro-batch, which a repeated batch overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemetrics.operators.silver import rejected_statements, silver_events
from coursemetrics.sources.binding import silver_from_events
from coursemetrics.sources.schemas import EVENT_SCHEMA

WATERMARK = "1 hour"
WINDOW = "1 hour"


def read_event_stream(spark: SparkSession, folder: str, fmt: str = "parquet", schema=None, file_filter: str | None = None,
                      max_files_per_trigger: int | None = None, multiline: bool = True) -> DataFrame:
    """File stream over the files of ``folder`` (``file_filter``: only names that match this glob)."""
    options = {"pathGlobFilter": file_filter} if file_filter else {}
    if schema is None:
        schema = spark.read.options(**options).format(fmt).load(folder).schema if fmt == "parquet" else EVENT_SCHEMA
    if fmt == "json":
        options["multiLine"] = multiline
    if max_files_per_trigger:
        options["maxFilesPerTrigger"] = max_files_per_trigger
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def stream_silver(stream: DataFrame, n_courses: int | None = None) -> DataFrame:
    """Flat silver rows from a stream of raw statements, or of driver events bound to ``n_courses`` courses."""
    return silver_events(stream) if n_courses is None else silver_from_events(stream, F.lit(n_courses))


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ event time is read in the session zone (UTC, see
    ``session.configure``)."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return df.withColumn(col, F.col(col).cast("timestamp"))
    return df


def stream_dedup(silver_stream: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return event_time(silver_stream).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _run(query) -> None:
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> str:
    """Append ``stream`` to the Parquet table ``out``."""
    _run(stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint))
    return out


def _batch_folder(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch={batch_id}"


def run_statements(stream: DataFrame, out: str, rejects: str, checkpoint: str) -> None:
    """Raw statements: valid ones flattened into ``out``, the others as text into ``rejects``, in the same micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            silver_events(kept).write.mode("overwrite").parquet(_batch_folder(out, batch_id))
            rejected_statements(kept).write.mode("overwrite").parquet(_batch_folder(rejects, batch_id))
        finally:
            kept.unpersist()

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def engagement_partials(silver: DataFrame, window: str = WINDOW, verbs=("interacted", "progressed", "launched")) -> DataFrame:
    e = event_time(silver.filter(F.col("verb").isin(*verbs)))
    return (e.groupBy("course_id", "module_id", F.window("ts", window).alias("w"))
            .agg(F.count("*").alias("event_count"), F.hll_sketch_agg("learner_email").alias("learners"))
            .select("course_id", "module_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_count", "learners"))


def run_engagement(silver_stream: DataFrame, out: str, checkpoint: str, window: str = WINDOW) -> str:
    """Partial counts of every window touched by a micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        engagement_partials(batch, window).write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    _run(silver_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
    return out


def engagement_table(spark: SparkSession, out: str) -> DataFrame:
    """Windows with exact event counts and approximate distinct learners."""
    return (spark.read.parquet(out).groupBy("course_id", "module_id", "window_start", "window_end")
            .agg(F.sum("event_count").cast("bigint").alias("event_count"),
                 F.hll_sketch_estimate(F.hll_union_agg("learners")).alias("approx_unique_learners")))
