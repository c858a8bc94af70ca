"""Query facade over the written tables (the output of ``plans.medallion.build_tables``).

The named reporting queries as methods returning lazy DataFrames. Silver is read
from its ``course_id``-partitioned folder, so per-course lookups read only that
course's files (partition pruning), and gold lookups push their filters into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from coursemetrics.operators import features, reports
from coursemetrics.session import configure

TABLES = ("silver_xapi_events", "dim_courses", "dim_learners", "gold_course_completion", "gold_module_dropoff",
          "gold_department_skills", "gold_engagement_hourly")


@dataclass
class LearningAnalytics:
    spark: SparkSession
    root: str
    fmt: str = "parquet"

    def __post_init__(self):
        configure(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format(self.fmt).load(f"{self.root.rstrip('/')}/{name}")

    # dashboard
    def overview_kpis(self, as_of=None) -> DataFrame:
        return reports.overview_kpis(self.table("silver_xapi_events"), self.table("gold_course_completion"),
                                     self.table("dim_courses"), as_of=as_of)

    def completion_funnel(self, course_id=None) -> DataFrame:
        return reports.completion_funnel(self.table("gold_module_dropoff"), course_id)

    def engagement_heatmap(self, course_id=None) -> DataFrame:
        return reports.engagement_heatmap(self.table("gold_engagement_hourly"), course_id)

    def department_skill_gaps(self, department=None) -> DataFrame:
        return reports.department_skill_gaps(self.table("gold_department_skills"), department)

    def course_ranking(self, min_enrolled: int = 3) -> DataFrame:
        return reports.course_ranking(self.table("gold_course_completion"), min_enrolled)

    def at_risk_learners(self, course_id=None, as_of=None, min_days: int = 7) -> DataFrame:
        return reports.at_risk_learners(self.table("silver_xapi_events"), course_id, as_of, min_days)

    def completion_by_format(self, min_enrolled: int = 5) -> DataFrame:
        return reports.completion_by_format(self.table("gold_course_completion"), min_enrolled)

    # lookups
    def departments(self) -> DataFrame:
        return reports.distinct_departments(self.table("dim_learners"))

    def courses(self, department=None) -> DataFrame:
        return reports.course_list(self.table("dim_courses"), department)

    def course_stats(self, course_id=None) -> DataFrame:
        return reports.course_stats(self.table("gold_course_completion"), course_id)

    def course_detail(self, course_id=None) -> DataFrame:
        return reports.course_detail(self.table("gold_course_completion"), self.table("dim_courses"), course_id)

    def courses_by_department(self, department=None) -> DataFrame:
        return reports.courses_by_department(self.table("gold_course_completion"), department)

    def learners(self, department=None) -> DataFrame:
        return reports.learners_by_department(self.table("dim_learners"), department)

    # model inputs
    def interaction_matrix_data(self, min_events: int = 2) -> DataFrame:
        return features.interaction_matrix(self.table("silver_xapi_events"), min_events)

    def training_features(self, min_events: int = 5) -> DataFrame:
        return features.training_features(self.table("silver_xapi_events"), min_events)

    def course_learner_features(self, course_id=None, min_events: int = 3) -> DataFrame:
        return features.course_learner_features(self.table("silver_xapi_events"), course_id, min_events)
