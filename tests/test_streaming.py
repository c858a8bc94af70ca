import json
import os

import pytest
from pyspark.sql import functions as F

from coursemetrics import streaming
from coursemetrics.operators.silver import silver_events
from coursemetrics.sources.binding import Binding
from coursemetrics.sources.raw import read_raw_events, statements_from_silver
from coursemetrics.streaming.events import read_event_stream
from paths import SF_SMALL


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "ckpt")


def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")


def silver_stream(spark, folder):
    return streaming.stream_silver(read_event_stream(spark, folder), 200)


def test_stream_silver_equals_batch(spark, folders):
    stream = read_event_stream(spark, SF_SMALL, file_filter="events.parquet")
    got = spark.read.parquet(streaming.run_to_table(streaming.stream_silver(stream, 200), *folders))
    want = Binding(spark, SF_SMALL).silver
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_a_stopped_job_resumes(spark, folders, tmp_path):
    """New files are taken up by a second run with the same folders, old ones are not read again."""
    src = str(tmp_path / "in")
    events(spark).where("event_id < 400").coalesce(1).write.parquet(src)
    streaming.run_to_table(silver_stream(spark, src), *folders)
    streaming.run_engagement(silver_stream(spark, src), folders[0] + "-eng", folders[1] + "-eng")
    assert spark.read.parquet(folders[0]).count() == 400
    events(spark).where("event_id >= 400").coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        streaming.run_to_table(silver_stream(spark, src), *folders)
        streaming.run_engagement(silver_stream(spark, src), folders[0] + "-eng", folders[1] + "-eng")
    assert spark.read.parquet(folders[0]).count() == events(spark).count()
    check_engagement(spark, folders[0] + "-eng")


def check_engagement(spark, out):
    """Every window of the input is there, the last and the late ones too, once and with all events."""
    silver = Binding(spark, SF_SMALL).silver.withColumn("ts", F.col("ts").cast("timestamp"))
    want = (silver.filter(F.col("verb").isin("interacted", "progressed", "launched"))
            .groupBy("course_id", "module_id", F.window("ts", "1 hour").start.alias("window_start"))
            .agg(F.count("*").alias("event_count"), F.count_distinct("learner_email").alias("learners")))
    got = streaming.engagement_table(spark, out)
    cols = ["course_id", "module_id", "window_start", "event_count"]
    assert got.count() == want.count() > 0 and got.select(cols).exceptAll(want.select(cols)).count() == 0
    both = got.join(want, cols)
    assert both.where("abs(approx_unique_learners - learners) > 0").count() == 0


def test_late_events_count_in_their_window(spark, folders, tmp_path):
    src = str(tmp_path / "in")
    events(spark).where("event_id >= 500").coalesce(1).write.parquet(src)
    streaming.run_engagement(silver_stream(spark, src), *folders)
    events(spark).where("event_id < 500").coalesce(1).write.mode("append").parquet(src)
    streaming.run_engagement(silver_stream(spark, src), *folders)
    check_engagement(spark, folders[0])


def test_stream_dedup_drops_repeats(spark, tmp_path, folders):
    ev = events(spark)
    ev.unionByName(ev.limit(100)).write.parquet(str(tmp_path / "dup"))
    s = streaming.stream_dedup(silver_stream(spark, str(tmp_path / "dup")))
    got = spark.read.parquet(streaming.run_to_table(s, *folders))
    assert got.count() == ev.count() and got.select("event_id").distinct().count() == ev.count()
    assert dict(got.dtypes)["ts"] == "timestamp"


def test_rejects_come_from_the_same_pass(spark, tmp_path, folders):
    import shutil
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(os.path.join(os.path.dirname(__file__), "fixtures", "raw_events.json"), src / "a.json")
    out, rejects, ckpt = folders[0], folders[0] + "-rejects", folders[1]
    for _ in range(2):
        streaming.run_statements(read_event_stream(spark, str(src), fmt="json"), out, rejects, ckpt)
    assert spark.read.parquet(out).count() == 6 and spark.read.parquet(rejects).count() == 3


def test_line_delimited_statements_and_malformed_records(spark, tmp_path):
    """A record per line: the file is split, and a record that does not parse is among the rejects, not lost."""
    from coursemetrics.plans.medallion import build_tables
    raw = tmp_path / "raw"
    raw.mkdir()
    silver = Binding(spark, SF_SMALL).silver.limit(50)
    lines = [r.j for r in statements_from_silver(silver).select(F.to_json(F.struct("*")).alias("j")).collect()]
    (raw / "xapi_events.json").write_text("\n".join([*lines, "{broken", json.dumps({"id": "no actor"})]))
    (raw / "courses.json").write_text("[]")
    (raw / "learners.json").write_text("[]")
    bronze = read_raw_events(spark, str(raw / "xapi_events.json"), multiline=False).cache()
    assert bronze.count() == 52 and silver_events(bronze).count() == 50
    paths = build_tables(spark, str(tmp_path / "lake"), raw_dir=str(raw), lines=True)
    assert spark.read.parquet(paths["silver_xapi_events"]).count() == 50
    told = {(r.reason, r.statement) for r in spark.read.parquet(paths["rejected_xapi_events"]).collect()}
    assert {x for x, _ in told} == {"unreadable", "incomplete"} and ("unreadable", "{broken") in told
