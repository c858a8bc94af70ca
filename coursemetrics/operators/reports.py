"""Named reporting queries (dashboard and notebook read paths).

Every function returns a lazy DataFrame. Per-key lookups of the reference
(``course_id = ?``, ``department = ?``) take the key as an optional argument;
``None`` answers for every key at once, which is the batch form used by the
registry. Orderings carry a unique tie-break so top-k cuts are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from coursemetrics.functions.rounding import stable_round
from coursemetrics.functions.topk import top_k_per_group

def _eq_or_all(df: DataFrame, col: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def as_of_literal(value, like: DataFrame, ts_col: str = "ts") -> Column:
    """``as_of`` (text or None = now) typed like the event time column."""
    dtype = like.schema[ts_col].dataType
    if value is None:
        return F.current_timestamp().cast(dtype)
    return F.lit(str(value)).cast(dtype)


def scalar(df: DataFrame, col: str) -> Column:
    """A one-value aggregate as a scalar subquery (evaluated once, no join)."""
    return df.select(col).scalar()


# ── notebook checks ────────────────────────────────────────────────────────

def verb_counts(silver: DataFrame) -> DataFrame:
    return (silver.groupBy("verb").agg(F.count("*").alias("cnt"))
            .orderBy(F.desc("cnt"), "verb"))


def dept_verb_summary(silver: DataFrame, n: int | None = None) -> DataFrame:
    """Every (department, verb) group; ``n`` limits the rows for display."""
    out = (silver.groupBy("department", "verb")
            .agg(F.count("*").alias("cnt"), stable_round(F.avg("score"), 3).alias("avg_score"))
            .orderBy("department", F.desc("cnt"), "verb"))
    return out if n is None else out.limit(n)


def module_completion_pattern(gold_module_dropoff: DataFrame) -> DataFrame:
    return (gold_module_dropoff.groupBy("module_id")
            .agg(stable_round(F.avg("module_completion_pct"), 1).alias("avg_completion_pct"),
                 stable_round(F.avg("avg_quiz_score"), 3).alias("avg_quiz_score"),
                 F.countDistinct("course_id").alias("courses"))
            .orderBy("module_id"))


def peak_hours(gold_engagement_hourly: DataFrame, n: int = 10) -> DataFrame:
    """Top hours by events. ``total_learners`` sums per-cell distinct counts (as the reference does)."""
    return (gold_engagement_hourly.groupBy("hour_of_day")
            .agg(F.sum("event_count").cast("bigint").alias("total_events"),
                 F.sum("unique_learners").cast("bigint").alias("total_learners"))
            .orderBy(F.desc("total_events"), "hour_of_day")
            .limit(n))


def completion_by_format(gold_course_completion: DataFrame, min_enrolled: int = 5) -> DataFrame:
    return (gold_course_completion.filter(F.col("enrolled") >= min_enrolled)
            .groupBy("course_format")
            .agg(F.count("*").alias("num_courses"),
                 stable_round(F.avg("completion_rate_pct"), 1).alias("avg_completion_rate"),
                 stable_round(F.avg("avg_score"), 3).alias("avg_score"))
            .orderBy(F.desc("avg_completion_rate"), "course_format"))


def format_comparison(by_format: DataFrame) -> DataFrame:
    return by_format.select("course_format", "num_courses", "avg_completion_rate",
                            stable_round(F.col("avg_score") * 100, 1).alias("avg_score_pct"))


# ── dashboard queries ──────────────────────────────────────────────────────

def overview_kpis(silver: DataFrame, gold_course_completion: DataFrame, dim_courses: DataFrame,
                  as_of=None, min_enrolled: int = 5) -> DataFrame:
    cutoff = as_of_literal(as_of, silver) + F.expr("INTERVAL -1 MONTH")
    # One row per learner first: both distinct counts become plain counts.
    last_seen = (silver.filter(F.col("learner_email").isNotNull())
                 .groupBy("learner_email").agg(F.max("ts").alias("last_ts")))
    learners = last_seen.agg(F.count("*").alias("total_learners"),
                             F.count(F.when(F.col("last_ts") >= cutoff, 1)).alias("active_this_month"))
    rate = (gold_course_completion.filter(F.col("enrolled") >= min_enrolled)
            .agg(stable_round(F.avg("completion_rate_pct"), 1).alias("avg_completion_rate")))
    courses = dim_courses.agg(F.count("*").alias("total_courses"))
    return learners.select("total_learners", "active_this_month",
                           scalar(rate, "avg_completion_rate").alias("avg_completion_rate"),
                           scalar(courses, "total_courses").alias("total_courses"))


def completion_funnel(gold_module_dropoff: DataFrame, course_id=None) -> DataFrame:
    return (_eq_or_all(gold_module_dropoff, "course_id", course_id)
            .select("course_id", "module_id", "learners_reached", "learners_completed",
                    "module_completion_pct", "avg_quiz_score", "low_score_count")
            .orderBy("course_id", "module_id"))


def engagement_heatmap(gold_engagement_hourly: DataFrame, course_id=None) -> DataFrame:
    """Module x hour cells; ``unique_learners`` sums distinct counts over weekdays (over-counts)."""
    return (_eq_or_all(gold_engagement_hourly, "course_id", course_id)
            .groupBy("course_id", "module_id", "hour_of_day")
            .agg(F.sum("event_count").cast("bigint").alias("event_count"),
                 F.sum("unique_learners").cast("bigint").alias("unique_learners"))
            .orderBy("course_id", "module_id", "hour_of_day"))


def engagement_heatmap_exact(silver: DataFrame, verbs=("interacted", "progressed", "launched")) -> DataFrame:
    """Module x hour cells straight from silver, with each learner counted once in ``unique_learners_exact``."""
    e = silver.filter(F.col("verb").isin(*verbs)).withColumn("hour_of_day", F.hour("ts").cast("bigint"))
    keys = ["course_id", "module_id", "hour_of_day"]
    return (e.groupBy(*keys, "learner_email").agg(F.count("*").alias("n")).groupBy(*keys)
            .agg(F.sum("n").cast("bigint").alias("event_count"), F.count("learner_email").alias("unique_learners_exact")))


def heatmap_matrix(engagement_heatmap_rows: DataFrame) -> DataFrame:
    """Dense module x 24-hour matrix, zero-filled. Pivot values are given, so no extra job runs."""
    wide = (engagement_heatmap_rows.groupBy("course_id", "module_id")
            .pivot("hour_of_day", list(range(24)))
            .agg(F.sum("event_count")))
    renamed = wide.select("course_id", "module_id",
                          *[F.col(str(h)).cast("bigint").alias(f"h{h:02d}") for h in range(24)])
    return renamed.na.fill(0).orderBy("course_id", "module_id")


def department_skill_gaps(gold_department_skills: DataFrame, department=None) -> DataFrame:
    return (_eq_or_all(gold_department_skills, "department", department)
            .select("department", "skill_name", "avg_proficiency", "target_proficiency", "skill_gap",
                    "learner_count")
            .orderBy("department", F.desc("skill_gap"), "skill_name"))


def top_skill_gaps(gold_department_skills: DataFrame, n: int = 10) -> DataFrame:
    """The n largest skill gaps of every department."""
    return top_k_per_group(gold_department_skills, "department", [F.desc("skill_gap"), "skill_name"], n) \
        .select("department", "rank", "skill_name", "avg_proficiency", "skill_gap")


def course_ranking(gold_course_completion: DataFrame, min_enrolled: int = 3) -> DataFrame:
    return (gold_course_completion.filter(F.col("enrolled") >= min_enrolled)
            .select("course_id", "title", "department", "course_format", "skill_level", "enrolled",
                    "completed", "completion_rate_pct", "avg_score")
            .orderBy(F.desc("completion_rate_pct"), "course_id"))


def completions(silver: DataFrame) -> DataFrame:
    """(course_id, learner_email) pairs with a course-completion statement."""
    return (silver.filter((F.col("verb") == "completed") & F.col("course_completed"))
            .select("course_id", "learner_email").distinct())


def at_risk_learners(silver: DataFrame, course_id=None, as_of=None, min_days: int = 7) -> DataFrame:
    s = _eq_or_all(silver, "course_id", course_id).filter(F.col("learner_email").isNotNull())
    now = as_of_literal(as_of, silver)
    # Aggregate first (partial aggregation absorbs a hot learner or course), then drop the
    # (course, learner) pairs with a completion: the anti join sees one row per pair.
    # The keys are non-null, so the anti join equals NOT IN.
    # One row per module first: the distinct count is then a plain count.
    keys = ["course_id", "learner_email", "learner_name", "department"]
    per_module = s.groupBy(*keys, "module_id").agg(F.max("ts").alias("last"), F.sum("score").alias("s_sum"),
                                                   F.count("score").alias("s_cnt"))
    per_learner = (per_module.groupBy(*keys)
                   .agg(F.count("module_id").alias("modules_started"), F.max("last").alias("last_activity"),
                        stable_round(F.try_divide(F.sum("s_sum"), F.sum("s_cnt")), 3).alias("avg_score")))
    return (per_learner.join(completions(s), ["course_id", "learner_email"], "left_anti")
            .withColumn("days_inactive", F.datediff(now, F.col("last_activity")).cast("bigint"))
            .filter(F.col("days_inactive") > min_days)
            .select("course_id", "learner_email", "learner_name", "department", "modules_started",
                    "last_activity", "days_inactive", "avg_score")
            .orderBy(F.desc("days_inactive"), "course_id", "learner_email"))


def effectiveness_quadrants(ranking: DataFrame) -> DataFrame:
    """Score as percent plus median quadrant lines (medians over the ranked courses)."""
    r = ranking.withColumn("avg_score_pct", stable_round(F.coalesce(F.col("avg_score"), F.lit(0.0)) * 100, 1))
    # medians over the ranked courses (one row per course: bounded by the catalogue)
    medians = r.agg(F.median("completion_rate_pct").alias("median_completion_rate"),
                    F.median("avg_score_pct").alias("median_score_pct"))
    out = r.select("*", scalar(medians, "median_completion_rate").alias("median_completion_rate"),
                   scalar(medians, "median_score_pct").alias("median_score_pct"))
    hi_rate = F.col("completion_rate_pct") >= F.col("median_completion_rate")
    hi_score = F.col("avg_score_pct") >= F.col("median_score_pct")
    quadrant = (F.when(hi_rate & hi_score, "high completion, high score")
                .when(hi_rate, "high completion, low score")
                .when(hi_score, "low completion, high score")
                .otherwise("low completion, low score"))
    return out.select("course_id", "title", "course_format", "enrolled", "completion_rate_pct",
                      "avg_score_pct", stable_round("median_completion_rate", 4).alias("median_completion_rate"),
                      stable_round("median_score_pct", 4).alias("median_score_pct"),
                      quadrant.alias("quadrant"))


# ── catalogue and people lookups ───────────────────────────────────────────

def course_stats(gold_course_completion: DataFrame, course_id=None) -> DataFrame:
    return _eq_or_all(gold_course_completion, "course_id", course_id).select(
        "course_id", "completion_rate_pct", "avg_score")


def courses_by_department(gold_course_completion: DataFrame, department=None) -> DataFrame:
    return (_eq_or_all(gold_course_completion, "department", department)
            .select("department", "course_id", "title", "skill_level", "course_format", "enrolled",
                    "completion_rate_pct", "avg_score")
            .orderBy("department", F.desc("completion_rate_pct"), "course_id"))


def course_list(dim_courses: DataFrame, department=None) -> DataFrame:
    out = _eq_or_all(dim_courses, "department", department).select("course_id", "title", "department")
    order = ["title", "course_id"] if department else ["department", "title", "course_id"]
    return out.orderBy(*order)


def distinct_departments(dim_learners: DataFrame) -> DataFrame:
    return dim_learners.select("department").distinct().orderBy("department")


def learners_by_department(dim_learners: DataFrame, department=None) -> DataFrame:
    return (_eq_or_all(dim_learners, "department", department)
            .select("learner_id", "name", "email", "department", "job_title", "hire_date")
            .orderBy("name", "learner_id"))


def course_detail(gold_course_completion: DataFrame, dim_courses: DataFrame, course_id=None) -> DataFrame:
    g = _eq_or_all(gold_course_completion, "course_id", course_id)
    d = dim_courses.select("course_id", "description", "skills_taught", "num_modules", "module_titles")
    return g.join(d, "course_id")


def started_courses(interactions: DataFrame) -> DataFrame:
    """Set of courses per learner (bounded by the catalogue size)."""
    return (interactions.groupBy("learner_email")
            .agg(F.array_sort(F.collect_set("course_id")).alias("started_courses")))


def drop_private_columns(df: DataFrame) -> DataFrame:
    return df.select([c for c in df.columns if not c.startswith("_")])


AT_RISK_DISPLAY = [("learner_name", "Name"), ("department", "Dept"), ("modules_started", "Modules Started"),
                   ("days_inactive", "Days Inactive"), ("avg_score", "Avg Score"), ("risk_tier", "Risk"),
                   ("intervention", "Suggested Action")]


def at_risk_display(df: DataFrame) -> DataFrame:
    return df.select([F.col(src).alias(dst) for src, dst in AT_RISK_DISPLAY if src in df.columns])


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table, as one union (one job) instead of one action per table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seed_pattern_checks(silver: DataFrame, dim_courses: DataFrame, dim_learner_skills: DataFrame,
                        department: str = "Engineering", low_score: float = 0.60) -> DataFrame:
    """The seed script's planted-pattern checks as one (check, item, value) table."""
    fmt = dim_courses.groupBy("format").agg(F.count("*").cast("double").alias("value")) \
        .select(F.lit("courses_per_format").alias("check"), F.col("format").alias("item"), "value")
    prof = (dim_learner_skills.filter(F.col("department") == department)
            .groupBy("skill_name").agg(stable_round(F.avg("proficiency_level"), 4).alias("value"))
            .select(F.lit("dept_skill_proficiency").alias("check"), F.col("skill_name").alias("item"), "value"))
    done = (silver.filter(F.col("verb") == "completed")                 # every completion statement
            .agg(F.count("*").cast("double").alias("value"))
            .select(F.lit("completion_events").alias("check"), F.lit("all").alias("item"), "value"))
    scored = silver.filter(F.col("verb") == "scored").agg(
        F.count(F.when(F.col("score") < low_score, 1)).alias("low"), F.count("*").alias("all"))
    low = scored.select(F.lit("low_score_events").alias("check"), F.explode(F.array(
        F.struct(F.lit("low").alias("item"), F.col("low").cast("double").alias("value")),
        F.struct(F.lit("scored").alias("item"), F.col("all").cast("double").alias("value")),
        F.struct(F.lit("share").alias("item"),
                 stable_round(F.try_divide(F.col("low"), F.col("all")), 4).alias("value")))).alias("x")) \
        .select("check", "x.item", "x.value")
    return fmt.unionByName(prof).unionByName(done).unionByName(low)
