"""Unions of learners from mergeable sketches (D4 -> D8, D12).

A stored hourly table with distinct counts can't be added up over weekdays: a learner of two days counts twice. Here each
cell keeps a theta sketch of its learners instead; unions over any cells, and differences between two sets, come from the
stored cells without reading events again. Sets of fewer learners than a sketch's size (4,096 as built) are exact, larger
ones are within two per cent about nineteen times in twenty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LOG_SIZE = 12
ENGAGED = ("interacted", "progressed", "launched")


def engagement_sketches(silver: DataFrame, verbs=ENGAGED, log_size: int = LOG_SIZE) -> DataFrame:
    """Hourly cells: events and the sketch of their learners."""
    e = silver.filter(F.col("verb").isin(*verbs))
    return (e.groupBy("course_id", "module_id", F.hour("ts").cast("bigint").alias("hour_of_day"), F.dayofweek("ts").cast("bigint").alias("day_of_week"))
            .agg(F.count("*").alias("event_count"), F.theta_sketch_agg("learner_email", log_size).alias("learners")))


def union_over(cells: DataFrame, *keys: str, log_size: int = LOG_SIZE) -> DataFrame:
    """``keys`` with events and distinct learners over all of their cells."""
    return (cells.groupBy(*keys).agg(F.sum("event_count").cast("bigint").alias("event_count"), F.theta_union_agg("learners", log_size).alias("learners"))
            .select(*keys, "event_count", F.theta_sketch_estimate("learners").cast("bigint").alias("unique_learners")))


def active_without_completion(silver: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """Learners of each course that have engaged, and those of them that have not completed it."""
    sets = silver.groupBy("course_id").agg(
        F.theta_sketch_agg(F.when(F.col("verb").isin(*ENGAGED), F.col("learner_email")), log_size).alias("active"),
        F.theta_sketch_agg(F.when(F.col("course_completed"), F.col("learner_email")), log_size).alias("done"))
    return sets.select("course_id", F.theta_sketch_estimate("active").cast("bigint").alias("active"),
                       F.theta_sketch_estimate(F.theta_difference("active", "done")).cast("bigint").alias("active_not_completed"))
