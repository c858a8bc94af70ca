"""Gold tables (pre-aggregated reporting tables) built from silver events.

Distinct-learner counts are computed by first reducing to one row per
(group, learner) and then counting rows. Both steps are hash aggregates with
map-side partial aggregation, so several distinct counts per group need no
``Expand`` (which would multiply the input rows), and a course holding a third
of all events is combined on the map side before its single key is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from coursemetrics.functions.rounding import pct, stable_round

LOW_SCORE = 0.60
ENGAGEMENT_VERBS = ("interacted", "progressed", "launched")
TARGET_PROFICIENCY = 3.5


def _is(verb: str):
    return F.col("verb") == verb


def _scored(col: str):
    return F.when(_is("scored"), F.col(col))


def _avg(sum_col: str, cnt_col: str):
    return F.try_divide(F.sum(sum_col), F.sum(cnt_col))


def _learner_partials(silver: DataFrame, keys: list[str], completed_flag, low_score: float) -> DataFrame:
    """One row per (keys, learner): completion flag and scored-event partial sums."""
    return (silver
            .groupBy(*keys, "learner_email")
            .agg(F.max(F.when(completed_flag, 1).otherwise(0)).alias("done"),
                 F.sum(_scored("score")).alias("s_sum"),
                 F.count(_scored("score")).alias("s_cnt"),
                 F.sum(_scored("score_raw")).alias("r_sum"),
                 F.count(_scored("score_raw")).alias("r_cnt"),
                 F.count(F.when(_is("scored") & (F.col("score") < low_score), 1)).alias("low")))


def gold_course_completion(silver: DataFrame, dim_courses: DataFrame, low_score: float = LOW_SCORE) -> DataFrame:
    s = silver.filter(F.col("learner_email").isNotNull())
    per_learner = _learner_partials(s, ["course_id"], _is("completed") & F.col("course_completed"), low_score)
    per_course = (per_learner.groupBy("course_id")
                  .agg(F.count("*").alias("enrolled"),
                       F.sum("done").cast("bigint").alias("completed"),
                       _avg("s_sum", "s_cnt").alias("avg_score"),
                       _avg("r_sum", "r_cnt").alias("avg_score_raw"),
                       F.sum("low").cast("bigint").alias("low_score_events")))
    # Inner join to the catalogue (events of unknown courses drop out). The
    # catalogue side is small; AQE turns this into a broadcast join when its
    # runtime size is under the threshold and keeps a shuffle join otherwise.
    courses = dim_courses.select("course_id", "title", "department", F.col("format").alias("course_format"),
                                 "skill_level", "duration_hours")
    return (per_course.join(courses, "course_id")
            .select("course_id", "title", "department", "course_format", "skill_level", "duration_hours",
                    "enrolled", "completed",
                    pct("completed", "enrolled", 1).alias("completion_rate_pct"),
                    stable_round("avg_score", 3).alias("avg_score"),
                    stable_round("avg_score_raw", 1).alias("avg_score_raw"),
                    "low_score_events"))


def gold_module_dropoff(silver: DataFrame, low_score: float = LOW_SCORE) -> DataFrame:
    s = silver.filter(F.col("learner_email").isNotNull())
    per_learner = _learner_partials(s, ["course_id", "module_id"], _is("completed"), low_score)
    return (per_learner.groupBy("course_id", "module_id")
            .agg(F.count("*").alias("learners_reached"),
                 F.sum("done").cast("bigint").alias("learners_completed"),
                 _avg("s_sum", "s_cnt").alias("avg_quiz_score"),
                 F.sum("low").cast("bigint").alias("low_score_count"))
            .select("course_id", "module_id", "learners_reached", "learners_completed",
                    pct("learners_completed", "learners_reached", 1).alias("module_completion_pct"),
                    stable_round("avg_quiz_score", 3).alias("avg_quiz_score"),
                    "low_score_count"))


def learner_skill_rows(dim_learners: DataFrame) -> DataFrame:
    """LATERAL VIEW EXPLODE(skills): learners with NULL or empty skills drop out."""
    return (dim_learners
            .select("learner_id", "email", "name", "department", F.explode("skills").alias("s"))
            .select("learner_id", "email", "name", "department",
                    F.col("s.skill_name").alias("skill_name"),
                    F.col("s.proficiency_level").alias("proficiency_level")))


def gold_department_skills(dim_learners: DataFrame, target: float = TARGET_PROFICIENCY) -> DataFrame:
    return (learner_skill_rows(dim_learners)
            .groupBy("department", "skill_name")
            .agg(F.avg("proficiency_level").alias("avg_p"), F.count("*").alias("learner_count"))
            .select("department", "skill_name",
                    stable_round("avg_p", 2).alias("avg_proficiency"),
                    F.lit(float(target)).alias("target_proficiency"),
                    stable_round(F.lit(float(target)) - F.col("avg_p"), 2).alias("skill_gap"),
                    "learner_count"))


def gold_engagement_hourly(silver: DataFrame, verbs=ENGAGEMENT_VERBS) -> DataFrame:
    keys = ["course_id", "module_id", "hour_of_day", "day_of_week"]
    e = (silver.filter(F.col("verb").isin(*verbs))
         .select("course_id", "module_id", "learner_email",
                 F.hour("ts").cast("bigint").alias("hour_of_day"),
                 F.dayofweek("ts").cast("bigint").alias("day_of_week")))
    per_learner = e.groupBy(*keys, "learner_email").agg(F.count("*").alias("n"))
    return (per_learner.groupBy(*keys)
            .agg(F.sum("n").cast("bigint").alias("event_count"),
                 F.count("learner_email").alias("unique_learners")))
