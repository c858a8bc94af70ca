"""Exact streaming forms: distinct learners per window by keyed state, and late repeats by a merge on write.

* ``run_exact_engagement``: a state processor keeps the learners of every open window in list state. Its keys are shares: a learner of a
  course and module belongs to one share by hash, so a course with a third of all events is dealt over all of them, the shares of
  a window add up exactly, and their number does not grow with the courses. A window's state goes when the watermark passes its end.
* ``run_merge``: rows whose id is stored already are left out by an anti join with the stored ids of the same days, so a
  repeat is dropped however late it comes, and no state is kept between batches.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from coursemetrics.streaming.events import WINDOW, _batch_folder, _run, event_time

SHARES = 256
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTED = ("interacted", "progressed", "launched")
UPDATES = "course_id string, module_id string, share int, window_start long, window_end long, event_count long, unique_learners long"


class WindowLearners(StatefulProcessor):
    """Key: a share. List state ``seen`` holds a row for each course, module, window and learner, ``counts`` one for each window.

    Both are read and written whole lists at a time, since a call of the store costs more than a row: a batch takes a few calls
    for each share, however many learners come. A share has one timer at least, for the first end of its windows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "course_id string, module_id string, window_start long, learner string")
        self.counts = handle.getListState("counts", "course_id string, module_id string, window_start long, window_end long, events long, learners long")

    def handleInputRows(self, key, rows, timerValues):
        found, ends = Counter(), {}
        for r in rows:
            window = (r.course_id, r.module_id, r.window_start)
            found[(*window, r.learner_email)] += 1
            ends[window] = r.window_end
        counts = {tuple(c[:3]): tuple(c[3:]) for c in self.counts.get()}
        new = set(found).difference(map(tuple, self.seen.get()))
        first = min((end for end, _, _ in counts.values()), default=None)
        for who, n in found.items():
            window = who[:3]
            end, events, learners = counts.get(window, (ends[window], 0, 0))
            counts[window] = (end, events + n, learners + (who in new and who[3] is not None))
        self.seen.appendList(list(new)) if new else None
        self.counts.put([(*window, *told) for window, told in counts.items()])
        soonest = min(ends.values())
        if first is None or soonest < first:
            self.handle.registerTimer(soonest // 1000)
        for window in ends:
            end, events, learners = counts[window]
            yield Row(course_id=window[0], module_id=window[1], share=key[0], window_start=window[2], window_end=end,
                      event_count=events, unique_learners=learners)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        counts = [tuple(c) for c in self.counts.get()]
        left = [c for c in counts if c[3] > passed]
        if len(left) < len(counts):
            windows = {c[:3] for c in left}
            seen = [who for who in map(tuple, self.seen.get()) if who[:3] in windows] if left else []
            for state, rows in ((self.counts, left), (self.seen, seen)):
                state.put(rows) if rows else state.clear()
        if left:
            self.handle.registerTimer(min(c[3] for c in left) // 1000)
        return iter(())

    def close(self) -> None:
        pass


def run_exact_engagement(silver_stream: DataFrame, out: str, checkpoint: str, delay: str, window: str = WINDOW, verbs=COUNTED, shares: int = SHARES) -> str:
    """Updates of every window touched by a micro-batch, appended under ``out``; runs again from ``checkpoint``.

    Rows later than ``delay`` behind the newest event are not counted (``events.run_engagement`` counts those, with a sketch)."""
    spark = silver_stream.sparkSession
    e = event_time(silver_stream.filter(F.col("verb").isin(*verbs) & F.col("ts").isNotNull()))
    w = F.window("ts", window)
    keyed = (e.withWatermark("ts", delay).withColumn("share", F.pmod(F.xxhash64("course_id", "module_id", "learner_email"), F.lit(shares)).cast("int"))
             .select("course_id", "module_id", "share", "learner_email", "ts", F.unix_micros(w.start).alias("window_start"), F.unix_micros(w.end).alias("window_end")))
    updates = keyed.groupBy("share").transformWithState(
        statefulProcessor=WindowLearners(), outputStructType=UPDATES, outputMode="Update", timeMode="EventTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)      # keyed map state with timers needs this store; read when the query starts
    try:
        _run(updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint))
    finally:
        spark.conf.set(PROVIDER, old) if old is not None else spark.conf.unset(PROVIDER)
    return out


def exact_engagement_table(spark: SparkSession, out: str) -> DataFrame:
    """Windows with exact events and distinct learners. A share's numbers only grow, so its last update is its largest."""
    last = (spark.read.parquet(out).groupBy("course_id", "module_id", "window_start", "window_end", "share")
            .agg(F.max("event_count").alias("event_count"), F.max("unique_learners").alias("unique_learners")))
    return (last.groupBy("course_id", "module_id", "window_start", "window_end")
            .agg(F.sum("event_count").alias("event_count"), F.sum("unique_learners").alias("unique_learners"))
            .withColumns({c: F.timestamp_micros(c) for c in ("window_start", "window_end")}))


def merge_batch(batch: DataFrame, out: str, load: str, key: str = "event_id", time: str = "ts") -> None:
    """Append the rows of ``batch`` whose key is not stored yet for their day. Running the same load again replaces it.

    Equal keys of one day are one row; rows without a key are all kept; rows without a time have a day of their own."""
    spark = batch.sparkSession
    day = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("none"))
    rows = batch.withColumn("day", day)
    stored_schema = T.StructType([*batch.schema.fields, T.StructField("load", T.StringType()), T.StructField("day", T.StringType())])
    # An empty first folder gives the table its schema.
    spark.createDataFrame([], batch.schema).write.mode("ignore").parquet(f"{out}/load=start/day=none")
    stored = spark.read.schema(stored_schema).parquet(out).where(F.col("load") != load).select("day", key)
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates(["day", key])
    # Only the folders of the days in this batch are read.
    near = stored.join(fresh.select("day").distinct(), "day", "left_semi")
    kept = fresh.join(near, ["day", key], "left_anti").select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))
    kept.write.mode("overwrite").partitionBy("day").parquet(f"{out}/load={load}")


def run_merge(stream: DataFrame, out: str, checkpoint: str, name: str, key: str = "event_id", time: str = "ts") -> str:
    """Merge a stream into the table ``out``, each row once. ``name`` tells apart streams that write to the same table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            merge_batch(kept, out, f"{name}-{batch_id}", key, time)
        finally:
            kept.unpersist()

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))
    return out


def merged_table(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("load", T.StringType()), T.StructField("day", T.StringType())])).parquet(out).select(*schema.names)
