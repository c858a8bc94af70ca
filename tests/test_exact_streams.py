"""Exact distinct learners and late repeats, across restarts and files in any order."""

import random

import pytest
from pyspark.sql import functions as F

from coursemetrics import streaming
from coursemetrics.sources.binding import Binding
from coursemetrics.streaming import exact
from coursemetrics.streaming.events import read_event_stream
from paths import SF_SMALL


def silver(spark):
    return Binding(spark, SF_SMALL).silver


def silver_stream(spark, folder):
    return streaming.stream_silver(read_event_stream(spark, folder, max_files_per_trigger=2), 200)


def check(spark, out):
    s = silver(spark).withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("verb").isin(*exact.COUNTED))
    w = F.window("ts", "1 hour")
    want = (s.groupBy("course_id", "module_id", w.start.alias("window_start"), w.end.alias("window_end"))
            .agg(F.count("*").alias("event_count"), F.count_distinct("learner_email").alias("unique_learners")))
    got = exact.exact_engagement_table(spark, out).select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_exact_learners_survive_a_restart(spark, tmp_path):
    """Every event comes twice or more for some windows; the second run starts from the first one's state."""
    events, src, out, ckpt = spark.read.parquet(f"{SF_SMALL}/events.parquet"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(src)
    exact.run_exact_engagement(silver_stream(spark, src), out, ckpt, "3650 days", shares=2)
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    exact.run_exact_engagement(silver_stream(spark, src), out, ckpt, "3650 days", shares=2)
    check(spark, out)


def test_state_of_past_windows_goes(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    rows = lambda hour, who: [(f"e{hour}{w}", w, "interacted", "c", "m", f"2024-01-01 {hour:02d}:10:00") for w in who]
    schema = "event_id string, learner_email string, verb string, course_id string, module_id string, t string"
    for hour, who in ((1, "ab"), (5, "a"), (9, "abc")):
        spark.createDataFrame(rows(hour, who), schema).select("*", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(f"{schema}, ts timestamp").parquet(src)
        exact.run_exact_engagement(stream, out, ckpt, "1 hour", shares=1)
    got = {r.window_start.hour: (r.event_count, r.unique_learners) for r in exact.exact_engagement_table(spark, out).collect()}
    assert got == {1: (2, 2), 5: (1, 1), 9: (3, 3)}
    held = spark.read.format("statestore").option("path", ckpt).option("stateVarName", "counts").load()
    assert held.count() == 1      # the last window only


def test_late_repeats_are_kept_once(spark, tmp_path):
    """Files in shuffled order, days late, each event in two to four of them."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [ev.where(f"event_id % 7 = {i}") for i in range(7)] * 2 + [ev.where("event_id % 3 = 0")] * 2
    random.Random(5).shuffle(parts)
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(src)
        if i in (4, 9, len(parts) - 1):
            streaming.run_merge(silver_stream(spark, src), out, str(tmp_path / "ckpt"), "events")
    want = silver(spark)
    got = exact.merged_table(spark, out, silver_stream(spark, src).schema)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", None), ("a", "2024-01-01 09:00:00"), (None, None), (None, None)], "event_id string, t string")
    batch = rows.select("event_id", F.to_timestamp("t").alias("ts"))
    for load in ("x-0", "x-1", "x-1", "x-0"):
        exact.merge_batch(batch.where("event_id is not null") if load == "x-1" else batch, out, load)
    got = exact.merged_table(spark, out, batch.schema)
    assert got.where("event_id is not null").count() == 2 and got.where("event_id is null").count() == 2


@pytest.mark.parametrize("name", ["stream_exact_learners", "stream_merge"])
def test_registered_streams_read_their_input_each_time(spark, name):
    from coursemetrics.plans.registry import QUERIES
    first, second = (QUERIES[name](spark, SF_SMALL) for _ in range(2))
    assert first.count() == second.count() > 0 and set(first.inputFiles()).isdisjoint(second.inputFiles())


def test_calls_of_the_state_do_not_grow_with_learners():
    """A share's batch takes as many calls for three learners as for three hundred, and its windows go by one timer after the other."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    def calls(learners):
        told = []

        class Held:
            def __init__(self):
                self.rows = []

            def get(self):
                told.append("get")
                return iter(self.rows)

            def put(self, rows):
                told.append("put")
                self.rows = list(rows)

            def appendList(self, rows):
                told.append("append")
                self.rows += rows

            def clear(self):
                told.append("clear")
                self.rows = []

        timers = []
        p = exact.WindowLearners()
        p.init(SimpleNamespace(getListState=lambda *_: Held(), registerTimer=timers.append))
        hour = 3_600_000_000
        rows = [Row(course_id="c", module_id="m", window_start=h * hour, window_end=(h + 1) * hour, learner_email=None if i == 0 else f"l{i}") for h in range(4) for i in range(learners) for _ in range(2)]
        out = list(p.handleInputRows((7,), iter(rows), None))
        assert {(r.window_start // hour, r.event_count, r.unique_learners) for r in out} == {(h, 2 * learners, learners - 1) for h in range(4)} and timers == [3_600_000]
        assert [r.unique_learners for r in p.handleInputRows((7,), iter(rows[:2] + [Row(**(rows[0].asDict() | {"learner_email": "other"}))]), None)] == [learners]
        list(p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3 * 3_600_000), None))
        assert len(p.counts.rows) == 1 and len(p.seen.rows) == learners and timers[-1] == 4 * 3_600_000
        list(p.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 4 * 3_600_000), None))
        assert p.counts.rows == p.seen.rows == []
        return len(told) + len(timers)

    assert calls(3) == calls(300)
