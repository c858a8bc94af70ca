"""Per (learner, course) feature tables for the dropout model and the recommender.

Distinct counts (modules of a course, calendar days of activity) are row counts
after a reduction to one row per (pair, module) and per (pair, day): plain hash
aggregates with map-side combine, no set per pair and no copy of the input rows
per distinct column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coursemetrics.functions.rounding import stable_round
from coursemetrics.operators.reports import _eq_or_all

FEATURE_COLS = ["total_events", "modules_touched", "avg_score", "active_days", "span_days",
                "events_per_day", "completion_velocity", "score_x_events"]
BASE_COLS = FEATURE_COLS[:5]
COMPLETION_WEIGHT = 3.0


def _activity(events: DataFrame, keys: list[str], min_events: int) -> DataFrame:
    """One row per ``keys`` with the activity columns and ``completed``, for groups of ``min_events`` or more."""
    scored = F.when(F.col("verb") == "scored", F.col("score"))
    done = (F.col("verb") == "completed") & F.col("course_completed")
    per_module = events.groupBy(*keys, "module_id").agg(
        F.count("*").alias("n"), F.sum(scored).alias("s_sum"), F.count(scored).alias("s_cnt"), F.min("ts").alias("first"),
        F.max("ts").alias("last"), F.max(F.when(done, 1).otherwise(0)).alias("done"))
    out = (per_module.groupBy(*keys)
           .agg(F.sum("n").cast("bigint").alias("total_events"), F.count("module_id").alias("modules_touched"),
                stable_round(F.try_divide(F.sum("s_sum"), F.sum("s_cnt")), 4).alias("avg_score"),
                # calendar-day boundaries between first and last event (two-argument datediff)
                F.datediff(F.max("last"), F.min("first")).cast("bigint").alias("span_days"),
                F.max("done").cast("bigint").alias("completed"))
           .filter(F.col("total_events") >= min_events))
    days = (events.filter(F.col("ts").isNotNull()).select(*keys, F.to_date("ts").alias("day")).distinct()
            .groupBy(*keys).agg(F.count("*").alias("active_days")))
    return out.join(days, keys, "left").select(
        *keys, "total_events", "modules_touched", "avg_score", F.coalesce("active_days", F.lit(0)).alias("active_days"),
        "span_days", "completed")


def interaction_matrix(silver: DataFrame, min_events: int = 2) -> DataFrame:
    return (silver.filter(F.col("learner_email").isNotNull())
            .groupBy("learner_email", "course_id")
            .agg(F.count("*").alias("event_count"),
                 F.max(F.when(F.col("course_completed"), 1).otherwise(0)).cast("bigint").alias("completed"),
                 stable_round(F.avg(F.when(F.col("verb") == "scored", F.col("score"))), 4).alias("avg_score"))
            .filter(F.col("event_count") >= min_events))


def training_features(silver: DataFrame, min_events: int = 5) -> DataFrame:
    return _activity(silver.filter(F.col("learner_email").isNotNull()), ["learner_email", "course_id"], min_events)


def course_learner_features(silver: DataFrame, course_id=None, min_events: int = 3) -> DataFrame:
    """Features of learners who have not completed the course (no label)."""
    s = _eq_or_all(silver, "course_id", course_id).filter(F.col("learner_email").isNotNull())
    return _activity(s, ["course_id", "learner_email"], min_events).filter(F.col("completed") == 0).drop("completed")


def course_activity(silver: DataFrame) -> DataFrame:
    """Activity of every (course, learner) pair, with ``completed``."""
    return _activity(silver.filter(F.col("learner_email").isNotNull()), ["course_id", "learner_email"], 1)


def median_avg_score(features: DataFrame) -> DataFrame:
    """Single-row frame with the exact (interpolated) median of ``avg_score``."""
    return features.agg(F.median("avg_score").alias("median_avg_score"))


def dropout_features(features: DataFrame, median=None) -> DataFrame:
    """Derived model features.

    ``median``: a number (the training median kept with the model), or None to
    take the median of ``features`` itself (the reference's batch behaviour).
    A row that still has no score gets 0, as do other missing features.
    """
    if median is None:
        f = features
        fill = median_avg_score(features).select("median_avg_score").scalar()   # scalar subquery
    else:
        f = features
        fill = F.lit(float(median))
    avg_score = F.coalesce(F.col("avg_score"), fill)
    out = (f.withColumn("avg_score", avg_score)
           .withColumn("events_per_day", F.col("total_events") / F.greatest(F.col("active_days"), F.lit(1)))
           .withColumn("completion_velocity", F.col("modules_touched") / F.greatest(F.col("span_days"), F.lit(1)))
           .withColumn("score_x_events", F.col("avg_score") * F.col("total_events")))
    return out


def interaction_weights(interactions: DataFrame) -> DataFrame:
    """log1p(events) + 3*completed + avg_score/100 (score is 0-1, so the last term is <= 0.01)."""
    activity = F.log1p(F.col("event_count").cast("double"))
    finished = F.coalesce(F.col("completed").cast("double"), F.lit(0.0))
    score = F.coalesce(F.col("avg_score"), F.lit(0.0)) / 100.0
    return interactions.withColumn("weight", activity + COMPLETION_WEIGHT * finished + score)
