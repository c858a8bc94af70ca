"""Binding of the driver's tables to the activity data model.

``events`` becomes the silver event table, ``part`` the course catalogue and
``customer`` the learner dimension. Every mapping is arithmetic on keys, so
the DuckDB oracle (``plans/oracle.py``) can state the same binding in SQL.
Dimensions cover the whole source tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursemetrics.functions.lookup import pick
from coursemetrics.sources.tables import read_table

# Fixed values of the binding (order matters: index = key mod length).
DEPARTMENTS = ["Engineering", "Sales", "Marketing", "HR", "Finance", "Operations"]
FORMATS = ["self-paced", "blended", "instructor-led", "cohort-based"]
SKILL_LEVELS = ["beginner", "intermediate", "advanced"]
# event_type -> activity verb; anything else is a completion statement
VERBS = [("view", "launched"), ("click", "interacted"), ("signup", "progressed"), ("error", "scored")]
OTHER_VERB = "completed"
# A learner takes up to eight courses (k mod 8), spread over the whole catalogue; the cube makes
# low course numbers popular. Plain double arithmetic, so SQL gives the same course.
COURSES_PER_LEARNER = 8
LEARNER_STEP, COURSE_STEP, SPREAD = 1310, 571, 10007
MODULES_PER_COURSE = 5        # k div 20 -> module (k in 0..99)
COMPLETION_K = 80             # a purchase in module 5 completes the course
PASS_MARK = 70


def _verb(event_type: Column) -> Column:
    expr = None
    for source, verb in VERBS:
        expr = F.when(event_type == source, verb) if expr is None else expr.when(event_type == source, verb)
    return expr.otherwise(OTHER_VERB)


def _duration_iso(seconds: Column) -> Column:
    """ISO-8601 duration text PT#H#M#S (hours only when present)."""
    h = F.floor(seconds / 3600)
    m = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    s = F.pmod(seconds, F.lit(60))
    return F.when(h > 0, F.format_string("PT%dH%dM%dS", h, m, s)).otherwise(F.format_string("PT%dM%dS", m, s))


def course_place(user_id: Column, k: Column, n_courses: Column) -> Column:
    """Number of the course (from 0, below ``n_courses``) of an event."""
    x = F.pmod(user_id * LEARNER_STEP + F.pmod(k, F.lit(COURSES_PER_LEARNER)) * COURSE_STEP, F.lit(SPREAD)).cast("double") / float(SPREAD)
    return F.floor(x * x * x * n_courses.cast("double"))


def silver_from_events(events: DataFrame, n_courses: Column) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    et = F.col("event_type")
    graded = et.isin("error", "purchase")
    course_idx = F.col("course_idx")
    course_id = F.format_string("COURSE-%04d", course_idx + 1)
    module_id = F.format_string("MOD-%02d", (F.floor(F.col("k") / 20) + 1).cast("int"))
    uid = F.col("user_id")
    duration_s = F.round(F.col("value") * 60).cast("bigint")
    return (e
            .filter(F.col("k").isNotNull() & uid.isNotNull() & et.isNotNull())
            .withColumn("course_idx", course_place(uid, F.col("k"), n_courses))
            .select(
                F.col("event_id").cast("string").alias("event_id"),
                F.concat(F.lit("mailto:user"), uid.cast("string"), F.lit("@example.com")).alias("learner_mbox"),
                F.concat(F.lit("user"), uid.cast("string"), F.lit("@example.com")).alias("learner_email"),
                F.concat(F.lit("Learner "), uid.cast("string")).alias("learner_name"),
                _verb(et).alias("verb"),
                F.concat(F.lit("urn:course:"), course_id, F.lit(":"), module_id).alias("object_id"),
                F.concat(course_id, F.lit(" "), module_id).alias("object_name"),
                F.when(graded, F.least(F.col("value") / 100, F.lit(1.0))).alias("score"),
                F.when(graded, F.least(F.col("value"), F.lit(100.0))).alias("score_raw"),
                F.when(graded, F.col("value") >= PASS_MARK).alias("quiz_passed"),
                F.when(et == "purchase", F.col("k") >= COMPLETION_K)
                 .when(et == "error", F.lit(False)).alias("course_completed"),
                F.when(et != "view", _duration_iso(duration_s)).alias("duration_iso"),
                F.col("ts"),
                course_id.alias("course_id"),
                module_id.alias("module_id"),
                pick(uid, DEPARTMENTS).alias("department"),
                pick(course_idx, FORMATS).alias("course_format"),
            ))


def dim_courses_from_part(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        F.format_string("COURSE-%04d", key + 1).alias("course_id"),
        F.concat(F.col("p_name"), F.lit(" "), key.cast("string")).alias("title"),
        pick(key, DEPARTMENTS).alias("department"),
        pick(key, SKILL_LEVELS).alias("skill_level"),
        pick(key, FORMATS).alias("format"),
        F.col("p_size").cast("bigint").alias("duration_hours"),
        F.array(F.col("p_brand"), F.col("p_type")).alias("skills_taught"),
        F.concat(F.col("p_type"), F.lit(" course on "), F.col("p_name")).alias("description"),
        F.lit(MODULES_PER_COURSE).cast("bigint").alias("num_modules"),
        F.transform(F.sequence(F.lit(1), F.lit(MODULES_PER_COURSE)),
                    lambda i: F.concat(F.lit("Module "), i.cast("string"))).alias("module_titles"),
        F.array().cast("array<string>").alias("prerequisites"),
    )


def learner_skill_struct(key: Column, i: Column) -> Column:
    return F.struct(
        F.concat(F.lit("Skill-"), (F.pmod(key, F.lit(6)) * 4 + i).cast("string")).alias("skill_name"),
        (F.lit(1.0) + F.pmod(key * 7 + i * 37, F.lit(400)).cast("double") / 100).alias("proficiency_level"),
    )


def dim_learners_from_customer(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        F.format_string("LRN-%04d", key).alias("learner_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email"),
        pick(key, DEPARTMENTS).alias("department"),
        F.col("c_mktsegment").alias("job_title"),
        F.concat(F.lit("manager"), F.pmod(key, F.lit(6)).cast("string"), F.lit("@example.com")).alias("manager_email"),
        F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(key * 37, F.lit(3000)).cast("int")),
                      "yyyy-MM-dd").alias("hire_date"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: learner_skill_struct(key, i.cast("bigint")))
         .alias("skills"),
    )


@dataclass
class Binding:
    """Lazily bound frames for one scale-factor directory.

    Each frame is built once per binding (one query build): a query that uses the catalogue in
    several branches gets one DataFrame, so the driver plans it once and Spark can reuse its
    exchanges. DataFrames are immutable, so sharing them is safe.
    """

    spark: SparkSession
    sf_dir: str
    _tables: dict = field(default_factory=dict, repr=False)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, self.sf_dir, name)
        return self._tables[name]

    @cached_property
    def silver(self) -> DataFrame:
        return silver_from_events(self.table("events"), self.table("part").agg(F.count("*").alias("n")).select("n").scalar())

    @cached_property
    def dim_courses(self) -> DataFrame:
        return dim_courses_from_part(self.table("part"))

    @cached_property
    def dim_learners(self) -> DataFrame:
        return dim_learners_from_customer(self.table("customer"))
