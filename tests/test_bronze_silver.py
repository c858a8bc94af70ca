import os

from coursemetrics.operators import gold
from coursemetrics.operators.silver import silver_events
from coursemetrics.sources.raw import read_raw_events

FIXTURE = os.path.join(os.path.dirname(__file__), "fixtures", "raw_events.json")


def test_bronze_to_silver_cases(spark):
    s = silver_events(read_raw_events(spark, FIXTURE))
    rows = {r["event_id"]: r for r in s.collect()}
    # 5: no mailbox, 6: no en-US verb, 7: no course id -> dropped
    assert set(rows) == {"e1", "e2", "e3", "e4a", "e4b", "e8"}
    assert rows["e1"]["course_completed"] is True and rows["e1"]["learner_email"] == "ada@example.com"
    assert rows["e1"]["learner_mbox"] == "mailto:ada@example.com" and rows["e1"]["department"] == "Sales"
    assert rows["e2"]["score"] is None and rows["e2"]["duration_iso"] is None
    assert rows["e3"]["score"] is None and rows["e3"]["duration_iso"] == "PT2M3S"
    assert rows["e8"]["ts"] is None                      # unparsable timestamp kept as NULL
    assert rows["e1"]["ts"] is not None


def test_low_score_threshold(spark):
    s = silver_events(read_raw_events(spark, FIXTURE))
    dims = spark.createDataFrame([("C1", "T", "Sales", "blended", "beginner", 3)],
                                 "course_id string, title string, department string, format string, "
                                 "skill_level string, duration_hours long")
    g = gold.gold_course_completion(s, dims).first()
    assert g["low_score_events"] == 1                    # 0.59 counts, 0.60 does not
    assert g["enrolled"] == 2 and g["completed"] == 1 and g["completion_rate_pct"] == 50.0
    assert g["avg_score"] == 0.595
