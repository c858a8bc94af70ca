"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame`` plus DuckDB oracle SQL.

Every query reads the whole driver tables through the binding; per-key
lookups are registered in their all-keys form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemetrics.functions.lookup import pick
from coursemetrics.plans.oracle import DEPTS, FMTS, LEVELS, sr, with_binding
from coursemetrics.session import checkpoint_dir, configure
from coursemetrics.sources.binding import DEPARTMENTS, FORMATS, SKILL_LEVELS, Binding
from coursemetrics.functions.rounding import stable_round
from coursemetrics.operators import gold, reports, features

# The fixed "now" of the checks, within the driver's event dates; the operators default to the current time.
AS_OF_KPI = "2024-02-29 23:00:00"
AS_OF_AT_RISK = "2024-01-31 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, bind: bool = True):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Binding(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = with_binding(oracle) if bind else oracle.strip()
        return fn
    return deco


# ── gold tables (D1-D4) ────────────────────────────────────────────────────

def _gcc(b: Binding) -> DataFrame:
    return gold.gold_course_completion(b.silver, b.dim_courses)


def _gmd(b: Binding) -> DataFrame:
    return gold.gold_module_dropoff(b.silver)


def _gds(b: Binding) -> DataFrame:
    return gold.gold_department_skills(b.dim_learners)


def _geh(b: Binding) -> DataFrame:
    return gold.gold_engagement_hourly(b.silver)


register("gold_course_completion", "SELECT * FROM gold_course_completion")(_gcc)
register("gold_module_dropoff", "SELECT * FROM gold_module_dropoff")(_gmd)
register("gold_department_skills", "SELECT * FROM gold_department_skills")(_gds)
register("gold_engagement_hourly", "SELECT * FROM gold_engagement_hourly")(_geh)


@register("silver_events", "SELECT * FROM silver")
def _silver(b: Binding) -> DataFrame:
    """Silver events from the bound driver table (B1/B2 shape)."""
    return b.silver


# ── notebook checks (D5-D9, D24, D22, A11) ─────────────────────────────────

@register("verb_counts", "SELECT verb, COUNT(*) AS cnt FROM silver GROUP BY verb ORDER BY cnt DESC, verb")
def _verb_counts(b):
    return reports.verb_counts(b.silver)


@register("dept_verb_summary", f"""
SELECT department, verb, COUNT(*) AS cnt, {sr('AVG(score)', 3)} AS avg_score
FROM silver GROUP BY department, verb ORDER BY department, cnt DESC, verb""")
def _dept_verb(b):
    return reports.dept_verb_summary(b.silver)


@register("module_completion_pattern", f"""
SELECT module_id, {sr('AVG(module_completion_pct)', 1)} AS avg_completion_pct,
       {sr('AVG(avg_quiz_score)', 3)} AS avg_quiz_score, COUNT(DISTINCT course_id) AS courses
FROM gold_module_dropoff GROUP BY module_id ORDER BY module_id""")
def _module_pattern(b):
    return reports.module_completion_pattern(_gmd(b))


@register("peak_hours", """
SELECT hour_of_day, CAST(SUM(event_count) AS BIGINT) AS total_events,
       CAST(SUM(unique_learners) AS BIGINT) AS total_learners
FROM gold_engagement_hourly GROUP BY hour_of_day ORDER BY total_events DESC, hour_of_day LIMIT 10""")
def _peak_hours(b):
    return reports.peak_hours(_geh(b))


_BY_FORMAT = f"""
SELECT course_format, COUNT(*) AS num_courses, {sr('AVG(completion_rate_pct)', 1)} AS avg_completion_rate,
       {sr('AVG(avg_score)', 3)} AS avg_score
FROM gold_course_completion WHERE enrolled >= 5 GROUP BY course_format"""


@register("completion_by_format", _BY_FORMAT + " ORDER BY avg_completion_rate DESC, course_format")
def _by_format(b):
    return reports.completion_by_format(_gcc(b))


@register("format_comparison", f"""
WITH f AS ({_BY_FORMAT})
SELECT course_format, num_courses, avg_completion_rate, {sr('avg_score * 100', 1)} AS avg_score_pct FROM f""")
def _format_comparison(b):
    return reports.format_comparison(reports.completion_by_format(_gcc(b)))


@register("seed_pattern_checks", f"""
SELECT 'courses_per_format' AS "check", format AS item, CAST(COUNT(*) AS DOUBLE) AS value
FROM dim_courses GROUP BY format
UNION ALL
SELECT 'dept_skill_proficiency', skill_name, {sr('AVG(proficiency_level)', 4)}
FROM learner_skills WHERE department = 'Engineering' GROUP BY skill_name
UNION ALL
SELECT 'completion_events', 'all', CAST(COUNT(*) AS DOUBLE) FROM silver WHERE verb = 'completed'
UNION ALL
SELECT 'low_score_events', 'low', CAST(COUNT(CASE WHEN score < 0.60 THEN 1 END) AS DOUBLE)
FROM silver WHERE verb = 'scored'
UNION ALL
SELECT 'low_score_events', 'scored', CAST(COUNT(*) AS DOUBLE) FROM silver WHERE verb = 'scored'
UNION ALL
SELECT 'low_score_events', 'share', {sr("COUNT(CASE WHEN score < 0.60 THEN 1 END) / COUNT(*)", 4)}
FROM silver WHERE verb = 'scored'""")
def _seed_checks(b):
    return reports.seed_pattern_checks(b.silver, b.dim_courses, gold.learner_skill_rows(b.dim_learners))


@register("table_row_counts", """
SELECT 'silver_xapi_events' AS table_name, COUNT(*) AS n FROM silver
UNION ALL SELECT 'bronze_xapi_events', COUNT(*) FROM silver
UNION ALL SELECT 'dim_courses', COUNT(*) FROM dim_courses
UNION ALL SELECT 'dim_learners', COUNT(*) FROM dim_learners
UNION ALL SELECT 'gold_course_completion', COUNT(*) FROM gold_course_completion
UNION ALL SELECT 'gold_module_dropoff', COUNT(*) FROM gold_module_dropoff
UNION ALL SELECT 'gold_department_skills', COUNT(*) FROM gold_department_skills
UNION ALL SELECT 'gold_engagement_hourly', COUNT(*) FROM gold_engagement_hourly""")
def _row_counts(b):
    return reports.table_row_counts({
        "silver_xapi_events": b.silver, "bronze_xapi_events": raw.statements_from_silver(b.silver), "dim_courses": b.dim_courses, "dim_learners": b.dim_learners,
        "gold_course_completion": _gcc(b), "gold_module_dropoff": _gmd(b),
        "gold_department_skills": _gds(b), "gold_engagement_hourly": _geh(b)})


# ── dashboard queries (D10-D15, D19, D20) ──────────────────────────────────

@register("overview_kpis", f"""
SELECT (SELECT COUNT(DISTINCT learner_email) FROM silver) AS total_learners,
       (SELECT COUNT(DISTINCT learner_email) FROM silver
         WHERE ts >= TIMESTAMP '{AS_OF_KPI}' - INTERVAL 1 MONTH) AS active_this_month,
       (SELECT {sr('AVG(completion_rate_pct)', 1)} FROM gold_course_completion WHERE enrolled >= 5)
         AS avg_completion_rate,
       (SELECT COUNT(*) FROM dim_courses) AS total_courses""")
def _kpis(b):
    return reports.overview_kpis(b.silver, _gcc(b), b.dim_courses, as_of=AS_OF_KPI)


@register("completion_funnel", """
SELECT course_id, module_id, learners_reached, learners_completed, module_completion_pct, avg_quiz_score,
       low_score_count FROM gold_module_dropoff ORDER BY course_id, module_id""")
def _funnel(b):
    return reports.completion_funnel(_gmd(b))


_HEATMAP = """
SELECT course_id, module_id, hour_of_day, CAST(SUM(event_count) AS BIGINT) AS event_count,
       CAST(SUM(unique_learners) AS BIGINT) AS unique_learners
FROM gold_engagement_hourly GROUP BY course_id, module_id, hour_of_day"""


@register("engagement_heatmap", _HEATMAP + " ORDER BY course_id, module_id, hour_of_day")
def _heatmap(b):
    return reports.engagement_heatmap(_geh(b))


@register("heatmap_matrix", "WITH hm AS (" + _HEATMAP + ")\nSELECT course_id, module_id, " + ", ".join(
    f"CAST(SUM(CASE WHEN hour_of_day = {h} THEN event_count ELSE 0 END) AS BIGINT) AS h{h:02d}"
    for h in range(24)) + " FROM hm GROUP BY course_id, module_id ORDER BY course_id, module_id")
def _heatmap_matrix(b):
    return reports.heatmap_matrix(reports.engagement_heatmap(_geh(b)))


@register("department_skill_gaps", """
SELECT department, skill_name, avg_proficiency, target_proficiency, skill_gap, learner_count
FROM gold_department_skills ORDER BY department, skill_gap DESC, skill_name""")
def _skill_gaps(b):
    return reports.department_skill_gaps(_gds(b))


@register("top_skill_gaps", """
SELECT department, rank, skill_name, avg_proficiency, skill_gap
FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY skill_gap DESC, skill_name) AS rank FROM gold_department_skills) g WHERE rank <= 10""")
def _top_skill_gaps(b):
    return reports.top_skill_gaps(_gds(b))


@register("engagement_heatmap_exact", """
SELECT course_id, module_id, CAST(hour(ts) AS BIGINT) AS hour_of_day, COUNT(*) AS event_count, COUNT(DISTINCT learner_email) AS unique_learners_exact
FROM silver WHERE verb IN ('interacted', 'progressed', 'launched') GROUP BY ALL""")
def _heatmap_exact(b):
    return reports.engagement_heatmap_exact(b.silver)


_RANKING = """
SELECT course_id, title, department, course_format, skill_level, enrolled, completed, completion_rate_pct,
       avg_score FROM gold_course_completion WHERE enrolled >= 3"""


@register("course_ranking", _RANKING + " ORDER BY completion_rate_pct DESC, course_id")
def _ranking(b):
    return reports.course_ranking(_gcc(b))


@register("effectiveness_quadrants", f"""
WITH r AS (SELECT *, {sr('coalesce(avg_score, 0) * 100', 1)} AS avg_score_pct FROM ({_RANKING}) x),
m AS (SELECT median(completion_rate_pct) AS mr, median(avg_score_pct) AS ms FROM r)
SELECT course_id, title, course_format, enrolled, completion_rate_pct, avg_score_pct,
       {sr('mr', 4)} AS median_completion_rate, {sr('ms', 4)} AS median_score_pct,
       CASE WHEN completion_rate_pct >= mr AND avg_score_pct >= ms THEN 'high completion, high score'
            WHEN completion_rate_pct >= mr THEN 'high completion, low score'
            WHEN avg_score_pct >= ms THEN 'low completion, high score'
            ELSE 'low completion, low score' END AS quadrant
FROM r, m""")
def _quadrants(b):
    return reports.effectiveness_quadrants(reports.course_ranking(_gcc(b)))


_AT_RISK = f"""
SELECT p.course_id, p.learner_email, l.learner_name, l.department, p.modules AS modules_started, p.last_ts AS last_activity,
       date_diff('day', p.last_ts, TIMESTAMP '{AS_OF_AT_RISK}') AS days_inactive, {sr('p.every_avg', 3)} AS avg_score
FROM per_pair p JOIN (SELECT DISTINCT learner_email, learner_name, department FROM silver) l USING (learner_email)
WHERE NOT p.course_done AND date_diff('day', p.last_ts, TIMESTAMP '{AS_OF_AT_RISK}') > 7"""


@register("at_risk_learners", _AT_RISK + " ORDER BY days_inactive DESC, course_id, learner_email")
def _at_risk(b):
    return reports.at_risk_learners(b.silver, as_of=AS_OF_AT_RISK)


# ── catalogue and people lookups (B6-B10, C2) ──────────────────────────────

@register("course_stats", "SELECT course_id, completion_rate_pct, avg_score FROM gold_course_completion")
def _course_stats(b):
    return reports.course_stats(_gcc(b))


@register("courses_by_department", """
SELECT department, course_id, title, skill_level, course_format, enrolled, completion_rate_pct, avg_score
FROM gold_course_completion ORDER BY department, completion_rate_pct DESC, course_id""")
def _courses_by_dept(b):
    return reports.courses_by_department(_gcc(b))


@register("course_list", "SELECT course_id, title, department FROM dim_courses ORDER BY department, title, course_id")
def _course_list(b):
    return reports.course_list(b.dim_courses)


@register("distinct_departments", "SELECT DISTINCT department FROM dim_learners ORDER BY department")
def _departments(b):
    return reports.distinct_departments(b.dim_learners)


@register("learners_by_department", """
SELECT learner_id, name, email, department, job_title, hire_date FROM dim_learners ORDER BY name, learner_id""")
def _learners(b):
    return reports.learners_by_department(b.dim_learners)


@register("course_detail", """
SELECT g.*, d.description, array_to_string(d.skills_taught, ', ') AS skills_taught, d.num_modules
FROM gold_course_completion g JOIN dim_courses d ON g.course_id = d.course_id""")
def _course_detail(b):
    d = reports.course_detail(_gcc(b), b.dim_courses)
    return d.withColumn("skills_taught", F.array_join("skills_taught", ", ")).drop("module_titles")


# ── feature tables (D16-D18, D21, E1, F1) ──────────────────────────────────

_INTERACTIONS = """
SELECT learner_email, course_id, total_events AS event_count, CAST(any_completed AS BIGINT) AS completed, avg_score
FROM activity WHERE total_events >= 2"""
_TRAINING = "SELECT * EXCLUDE (any_completed) FROM activity WHERE total_events >= 5"


@register("interaction_matrix", _INTERACTIONS)
def _interactions(b):
    return features.interaction_matrix(b.silver)


@register("training_features", _TRAINING)
def _training(b):
    return features.training_features(b.silver)


_COURSE_LEARNERS = "SELECT * EXCLUDE (any_completed, completed) FROM activity WHERE total_events >= 3 AND completed = 0"


@register("course_learner_features", _COURSE_LEARNERS)
def _course_learner_features(b):
    return features.course_learner_features(b.silver)


@register("started_courses", f"""
WITH i AS ({_INTERACTIONS})
SELECT learner_email, COUNT(*) AS n_started, string_agg(course_id, ',' ORDER BY course_id) AS started
FROM i GROUP BY learner_email""")
def _started(b):
    s = reports.started_courses(features.interaction_matrix(b.silver))
    return s.select("learner_email", F.size("started_courses").cast("bigint").alias("n_started"),
                    F.array_join("started_courses", ",").alias("started"))


@register("dropout_features", f"""
WITH t AS ({_TRAINING}), m AS (SELECT median(avg_score) AS med FROM t),
f AS (SELECT t.* REPLACE (coalesce(t.avg_score, m.med) AS avg_score) FROM t, m)
SELECT learner_email, course_id, total_events, modules_touched, {sr('avg_score', 6)} AS avg_score,
       active_days, span_days, completed,
       {sr('total_events / greatest(active_days, 1)', 6)} AS events_per_day,
       {sr('modules_touched / greatest(span_days, 1)', 6)} AS completion_velocity,
       {sr('avg_score * total_events', 6)} AS score_x_events
FROM f""")
def _dropout_features(b):
    f = features.dropout_features(features.training_features(b.silver))
    return f.select("learner_email", "course_id", "total_events", "modules_touched",
                    stable_round("avg_score", 6).alias("avg_score"), "active_days", "span_days",
                    "completed",
                    *[stable_round(c, 6).alias(c)
                      for c in ("events_per_day", "completion_velocity", "score_x_events")])


@register("interaction_weights", f"""
WITH i AS ({_INTERACTIONS})
SELECT learner_email, course_id,
       {sr('ln(1 + event_count) + 3 * coalesce(completed, 0) + coalesce(avg_score, 0) / 100', 6)} AS weight
FROM i""")
def _weights(b):
    w = features.interaction_weights(features.interaction_matrix(b.silver))
    return w.select("learner_email", "course_id", stable_round("weight", 6).alias("weight"))


# ── dropout model (E2-E16, C4, A7, D23) ────────────────────────────────────
# Values that depend on the fitted trees have rows-only checks; what a scored table holds beside them is compared.

from coursemetrics.functions.labels import INTERVENTION_TEXTS, risk_label, risk_tier_cut, suggested_intervention  # noqa: E402
from coursemetrics.operators import dropout  # noqa: E402

_MODELS: dict = {}


def fitted_dropout(b: Binding) -> "dropout.DropoutModel":
    """The model for this data directory, fitted once per process (a fit is an action)."""
    key = (b.sf_dir.rstrip("/"), b.spark.sparkContext.applicationId)
    if key not in _MODELS:
        _MODELS[key] = dropout.train_dropout(features.training_features(b.silver))
    return _MODELS[key]


# The split rule in SQL: md5 buckets, counted for each label.
_PLACED = f"""
t AS ({_TRAINING}),
bucketed AS (SELECT *, ('0x' || substr(md5('{dropout.SEED}|' || learner_email || '|' || course_id), 1, 8))::BIGINT % {dropout.HASH_BUCKETS} AS bucket FROM t),
counted AS (SELECT completed, bucket, COUNT(*) AS n FROM bucketed GROUP BY ALL),
cut AS (SELECT completed, bucket, SUM(n) OVER (PARTITION BY completed ORDER BY bucket) - n AS before, SUM(n) OVER (PARTITION BY completed) AS of_label FROM counted),
placed AS (SELECT bucketed.*, cut.before, cut.of_label, cut.before >= {dropout.TEST_FRACTION} * cut.of_label AS is_train
           FROM bucketed JOIN cut USING (completed, bucket))"""
_FEATURES = f"""
m AS (SELECT median(avg_score) AS med FROM t),
f AS (SELECT t.* REPLACE (coalesce(t.avg_score, m.med) AS avg_score) FROM t, m),
derived AS (SELECT *, total_events / greatest(active_days, 1) AS events_per_day, modules_touched / greatest(span_days, 1) AS completion_velocity,
                   avg_score * total_events AS score_x_events FROM f)"""


@register("stratified_split", f"WITH {_PLACED} SELECT completed, is_train, COUNT(*) AS pairs FROM placed GROUP BY ALL")
def _split(b):
    s = dropout.stratified_split(features.training_features(b.silver))
    return s.groupBy("completed", "is_train").agg(F.count("*").alias("pairs"))


@register("cross_validation_folds", f"""WITH {_PLACED}
SELECT completed, CAST(least(floor(before * {dropout.N_FOLDS} / of_label), {dropout.N_FOLDS - 1}) AS INTEGER) AS fold, COUNT(*) AS pairs
FROM placed GROUP BY ALL""")
def _folds(b):
    return dropout.assign_folds(features.training_features(b.silver)).groupBy("completed", "fold").agg(F.count("*").alias("pairs"))


_FOLDS: dict = {}


def fitted_folds(b: Binding) -> dict:
    """The cross-validation of this data directory, run once per process (five fits)."""
    key = (b.sf_dir.rstrip("/"), b.spark.sparkContext.applicationId)
    if key not in _FOLDS:
        _FOLDS[key] = dropout.cross_validate_dropout(features.training_features(b.silver))
    return _FOLDS[key]


@register("dropout_cross_validation")
def _cross_validation(b):
    """Mean and deviation of the AUC over five folds, each with the model's own settings (200 trees)."""
    got = fitted_folds(b)
    return b.spark.createDataFrame([(got["mean_auc"], got["std_auc"], len(got["fold_auc"]))], "mean_auc double, std_auc double, folds int")


@register("dropout_model_info")
def _model_info(b):
    return dropout.model_info(fitted_dropout(b), b.spark)


@register("dropout_model_sizes", f"""WITH {_PLACED}
SELECT COUNT(*) AS n_samples, COUNT(*) FILTER (is_train) AS n_train, COUNT(*) FILTER (NOT is_train) AS n_test,
       {sr('median(avg_score)', 6)} AS fill_median FROM placed""")
def _model_sizes(b):
    info = dropout.model_info(fitted_dropout(b), b.spark)
    return info.select("n_samples", "n_train", "n_test", stable_round("fill_median", 6).alias("fill_median"))


@register("feature_importances")
def _importances(b):
    return dropout.feature_importances(fitted_dropout(b), b.spark)


@register("confusion_matrix")
def _confusion(b):
    return dropout.confusion_matrix(fitted_dropout(b), features.training_features(b.silver))


@register("confusion_totals", f"WITH {_PLACED} SELECT CAST(completed AS INTEGER) AS actual, COUNT(*) AS pairs FROM placed WHERE NOT is_train GROUP BY ALL")
def _confusion_totals(b):
    """What the cells of the confusion matrix must add up to."""
    m = dropout.confusion_matrix(fitted_dropout(b), features.training_features(b.silver))
    return m.select("actual", (F.col("predicted_0") + F.col("predicted_1")).alias("pairs"))


@register("classification_report")
def _class_report(b):
    return dropout.classification_report(fitted_dropout(b), features.training_features(b.silver))


@register("classification_support", f"""WITH {_PLACED}
SELECT CASE completed WHEN 1 THEN 'Completed' ELSE 'Dropout' END AS class_name, COUNT(*) AS support FROM placed WHERE NOT is_train GROUP BY ALL
UNION ALL SELECT name, COUNT(*) FROM placed, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(name) WHERE NOT is_train GROUP BY name""")
def _class_support(b):
    return dropout.classification_report(fitted_dropout(b), features.training_features(b.silver)).select("class_name", "support")


@register("gold_dropout_risk")
def _gold_risk(b):
    return dropout.gold_dropout_risk(fitted_dropout(b), features.training_features(b.silver))


@register("gold_dropout_risk_inputs", f"""WITH {_PLACED},{_FEATURES}
SELECT d.learner_email, d.course_id, d.total_events, d.modules_touched, d.active_days, d.span_days, {sr('d.events_per_day', 6)} AS events_per_day,
       {sr('d.completion_velocity', 6)} AS completion_velocity, {sr('d.score_x_events', 6)} AS score_x_events, p.is_train, true AS has_risk
FROM derived d JOIN placed p USING (learner_email, course_id)""")
def _gold_risk_inputs(b):
    """Everything of the scored table but the score itself, which must be a probability."""
    g = dropout.gold_dropout_risk(fitted_dropout(b), features.training_features(b.silver))
    return g.select("learner_email", "course_id", "total_events", "modules_touched", "active_days", "span_days",
                    *[stable_round(c, 6).alias(c) for c in ("events_per_day", "completion_velocity", "score_x_events")],
                    "is_train", F.col("dropout_risk_score").between(0, 1).alias("has_risk"))


@register("high_risk_pairs")
def _high_risk(b):
    return dropout.high_risk_pairs(dropout.gold_dropout_risk(fitted_dropout(b), features.training_features(b.silver)))


@register("score_course")
def _score_course(b):
    return dropout.score_course(fitted_dropout(b), features.course_learner_features(b.silver))


@register("score_course_inputs", f"SELECT *, true AS has_risk FROM ({_COURSE_LEARNERS}) s")
def _score_course_inputs(b):
    s = dropout.score_course(fitted_dropout(b), features.course_learner_features(b.silver))
    return s.withColumn("has_risk", F.col("dropout_risk").between(0, 1)).drop("dropout_risk", "risk_tier", "risk_label")


@register("at_risk_with_risk")
def _at_risk_with_risk(b):
    scored = dropout.score_course(fitted_dropout(b), features.course_learner_features(b.silver))
    return dropout.at_risk_with_risk(reports.at_risk_learners(b.silver, as_of=AS_OF_AT_RISK), scored)


@register("at_risk_scored", f"""
SELECT a.*, s.course_id IS NOT NULL AS has_risk FROM ({_AT_RISK}) a LEFT JOIN ({_COURSE_LEARNERS}) s USING (course_id, learner_email)""")
def _at_risk_scored(b):
    """The at-risk rows of the joined table, and which of them have a score."""
    j = _at_risk_with_risk(b)
    return j.withColumn("has_risk", F.col("dropout_risk").isNotNull()).drop("dropout_risk", "risk_tier", "intervention")


_PSEUDO_RISK = "('0x' || substr(md5('risk|' || learner_email || '|' || course_id), 1, 8))::BIGINT % 1001 / 1000.0::DOUBLE"


@register("risk_tiers_and_actions", f"""
WITH r AS (SELECT course_id, learner_email, span_days, CASE WHEN total_events > 5 THEN {_PSEUDO_RISK} END AS risk FROM activity)
SELECT course_id, learner_email, risk,
       CASE WHEN risk > 0.65 AND risk <= 1 THEN 'High' WHEN risk > 0.40 AND risk <= 0.65 THEN 'Medium' WHEN risk > 0 AND risk <= 0.40 THEN 'Low' END AS risk_tier,
       CASE WHEN risk >= 0.65 THEN 'High' WHEN risk >= 0.40 THEN 'Medium' WHEN risk >= 0 THEN 'Low' ELSE '—' END AS risk_label,
       CASE WHEN risk >= 0.65 THEN CASE WHEN span_days > 14 THEN '{INTERVENTION_TEXTS["high_long_inactive"]}' ELSE '{INTERVENTION_TEXTS["high"]}' END
            WHEN risk >= 0.40 THEN CASE WHEN span_days > 7 THEN '{INTERVENTION_TEXTS["medium_inactive"]}' ELSE '{INTERVENTION_TEXTS["medium"]}' END
            ELSE '{INTERVENTION_TEXTS["on_track"]}' END AS intervention
FROM r""")
def _risk_tiers(b):
    """Tier, label and intervention over a made-up risk that any engine can compute from the pair's key."""
    a = features.course_activity(b.silver)
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("risk"), "learner_email", "course_id")), 1, 8), 16, 10).cast("bigint")
    risk = F.when(F.col("total_events") > 5, (digest % 1001) / 1000.0)
    r = a.select("course_id", "learner_email", "span_days", risk.alias("risk"))
    return r.select("course_id", "learner_email", "risk", risk_tier_cut("risk").alias("risk_tier"), risk_label("risk", missing="—").alias("risk_label"),
                    suggested_intervention("risk", "span_days").alias("intervention"))


_SUMMARY_COLUMNS = [*features.FEATURE_COLS, dropout.LABEL]


@register("feature_summary", f"WITH t AS ({_TRAINING}),{_FEATURES},\nlong AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM derived" for c in _SUMMARY_COLUMNS) + f""")
SELECT feature, COUNT(x) AS n, {sr('AVG(x)', 4)} AS mean, {sr('stddev_samp(x)', 4)} AS std, {sr('MIN(x)', 4)} AS min, {sr('quantile_cont(x, 0.25)', 4)} AS q25,
       {sr('quantile_cont(x, 0.5)', 4)} AS q50, {sr('quantile_cont(x, 0.75)', 4)} AS q75, {sr('MAX(x)', 4)} AS max FROM long GROUP BY feature""")
def _feature_summary(b):
    s = dropout.feature_summary(features.dropout_features(features.training_features(b.silver)))
    return s.select("feature", "n", *[stable_round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@register("label_summary", f"""
WITH t AS ({_TRAINING}) SELECT completed, COUNT(*) AS pairs, round(COUNT(*) / (SELECT COUNT(*) FROM t), 4) AS share FROM t GROUP BY completed""")
def _label_summary(b):
    return dropout.label_summary(features.training_features(b.silver))


# ── recommender (F2-F5, C5, C8): rows-only checks ──────────────────────────

from coursemetrics.operators import recommend  # noqa: E402

_RECS: dict = {}


def fitted_recommender(b: Binding) -> "recommend.Recommender":
    key = (b.sf_dir.rstrip("/"), b.spark.sparkContext.applicationId)
    if key not in _RECS:
        _RECS[key] = recommend.fit_recommender(features.interaction_matrix(b.silver))
    return _RECS[key]


@register("svd_course_factors")
def _course_factors(b):
    rec = fitted_recommender(b)
    return rec.course_factors.select("course_id", F.size("v").alias("k"),
                                     F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm_sq"))


@register("recommender_sizes", f"""
WITH i AS ({_INTERACTIONS}) SELECT COUNT(DISTINCT learner_email) AS n_learners, COUNT(DISTINCT course_id) AS n_courses,
       least({recommend.N_COMPONENTS}, COUNT(DISTINCT course_id) - 1) AS n_components FROM i""")
def _rec_sizes(b):
    return recommend.recommender_info(fitted_recommender(b), features.interaction_matrix(b.silver)).drop("explained_variance_ratio")


@register("recommendation_counts", f"""
WITH i AS ({_INTERACTIONS}), n AS (SELECT COUNT(DISTINCT course_id) AS n FROM i)
SELECT learner_email, least(5, any_value(n.n) - COUNT(*)) AS courses, CAST(0 AS BIGINT) AS started FROM i, n GROUP BY learner_email""")
def _recommendation_counts(b):
    """Courses recommended to each learner, and how many of them it has started (none)."""
    i = features.interaction_matrix(b.silver)
    r = recommend.recommend_courses(fitted_recommender(b), i).join(i.select("learner_email", "course_id", F.lit(1).alias("old")), ["learner_email", "course_id"], "left")
    return r.groupBy("learner_email").agg(F.count("*").alias("courses"), F.count("old").alias("started"))


@register("recommender_info")
def _rec_info(b):
    return recommend.recommender_info(fitted_recommender(b), features.interaction_matrix(b.silver))


@register("recommend_courses")
def _recommend(b):
    return recommend.recommend_courses(fitted_recommender(b), features.interaction_matrix(b.silver))


@register("recommendations_with_title")
def _recommend_titles(b):
    recs = recommend.recommend_courses(fitted_recommender(b), features.interaction_matrix(b.silver))
    return recommend.recommendations_with_title(recs, b.dim_courses)


# ── search (G1-G9) ─────────────────────────────────────────────────────────

from coursemetrics.operators import search  # noqa: E402
from coursemetrics.plans.oracle import (bm25_ctes, vector_ctes, CENTROIDS_SQL, EMBED_TEXT_SQL)  # noqa: E402

SEARCH_TOP = 5
VECTOR_TOP = 10


def _searchable(b: Binding, *keep: str) -> DataFrame:
    """Catalogue text and vector, with the columns that requests filter on."""
    return search.course_embed_text(b.dim_courses, *keep).join(
        search.course_vectors_from_embeddings(b.table("embeddings")), "course_id", "left")


def _with_vector(b: Binding, requests: DataFrame, vec_id) -> DataFrame:
    """Requests with the vector that the binding gives them (none beyond the last vector)."""
    vectors = b.table("embeddings").select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("query_vector"))
    return requests.withColumn("_vec", vec_id).join(vectors, "_vec", "left").drop("_vec")


def _hybrid_ctes(p: str, docs_sql: str, req_sql: str, filters: str = "TRUE") -> str:
    """CTEs ending in ``{p}_top`` (query_id, doc_id, rrf, rank). docs_sql: doc_id, text, v, filter columns; req_sql: query_id,
    query_text, qv, filter columns. ``filters`` uses d.* and q.*."""
    def columns(sql: str, drop: str) -> str:
        return f"SELECT * EXCLUDE ({drop}) FROM ({sql}) s{drop[0]}"
    return (vector_ctes(p + "v", docs_sql, req_sql, 2 * SEARCH_TOP, filters).strip() + ","
            + bm25_ctes(p + "k", columns(docs_sql, "v"), columns(req_sql, "qv"), 2 * SEARCH_TOP,
                        filters.replace("d.", "post.").replace("q.", "qt.")).rstrip() + f""",
{p}_fused AS (SELECT query_id, doc_id, round(SUM(1.0 / (60 + rank)), 8) AS rrf
          FROM (SELECT query_id, doc_id, rank FROM {p}v_top UNION ALL SELECT query_id, doc_id, rank FROM {p}k_top) u
          GROUP BY query_id, doc_id),
{p}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank
                           FROM {p}_fused) x WHERE rank <= {SEARCH_TOP})""")


def _catalogue_docs(b: Binding) -> DataFrame:
    return search.search_docs(b.dim_courses, _gcc(b), search.course_vectors_from_embeddings(b.table("embeddings")))


@register("course_embed_text", f"SELECT course_id, {EMBED_TEXT_SQL} AS embed_text FROM dim_courses")
def _embed_text(b):
    return search.course_embed_text(b.dim_courses)


_SEARCH_DOCS_SQL = """
SELECT c.course_id, c.title, coalesce(c.description, '') AS description, c.department, c.skill_level, c.format,
       coalesce(CAST(c.duration_hours AS DOUBLE), 0) AS duration_hours,
       array_to_string(coalesce(c.skills_taught, []), ', ') AS skills_taught,
       CAST(coalesce(c.num_modules, 0) AS INTEGER) AS num_modules,
       g.completion_rate_pct AS completion_rate, g.avg_score,
       CAST(len(e.embedding) AS INTEGER) AS vector_dim
FROM dim_courses c LEFT JOIN gold_course_completion g ON c.course_id = g.course_id
LEFT JOIN embeddings e ON c.course_id = printf('COURSE-%04d', e.vec_id + 1)"""


@register("search_docs", _SEARCH_DOCS_SQL)
def _search_docs(b):
    d = _catalogue_docs(b)
    return d.withColumn("skills_taught", F.array_join("skills_taught", ", ")) \
            .withColumn("vector_dim", F.size("content_vector")).withColumn(
                "vector_dim", F.when(F.col("content_vector").isNotNull(), F.col("vector_dim"))).drop("content_vector")


@register("facet_counts", """
WITH d AS (SELECT * FROM dim_courses)
SELECT 'department' AS facet, department AS value, COUNT(*) AS count FROM d GROUP BY department
UNION ALL SELECT 'skill_level', skill_level, COUNT(*) FROM d GROUP BY skill_level
UNION ALL SELECT 'format', format, COUNT(*) FROM d GROUP BY format
UNION ALL SELECT 'skills_taught', s, COUNT(*) FROM (SELECT unnest(skills_taught) AS s FROM d) x GROUP BY s""")
def _facets(b):
    return search.facet_counts(b.dim_courses)


@register("document_facets", """
SELECT 'lang' AS facet, lang AS value, COUNT(*) AS count FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, COUNT(*) FROM documents GROUP BY source""", bind=False)
def _doc_facets(b):
    return search.facet_counts(b.table("documents"), fields=("lang", "source"), array_fields=())


_EMB_DOCS = "SELECT vec_id AS doc_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


@register("vector_top_k", "WITH " + vector_ctes("vk", _EMB_DOCS, CENTROIDS_SQL, VECTOR_TOP).strip()
          + "\nSELECT query_id, doc_id, similarity, rank FROM vk_top", bind=False)
def _vector_top_k(b):
    emb = b.table("embeddings")
    return search.vector_top_k(emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")),
                               search.label_centroids(emb), VECTOR_TOP)


@register("filtered_vector_top_k", "WITH " + vector_ctes(
    "fv", _EMB_DOCS, "SELECT query_id, qv, query_id AS label FROM (" + CENTROIDS_SQL + ") c", VECTOR_TOP,
    "d.label = q.label").strip() + "\nSELECT query_id, doc_id, similarity, rank FROM fv_top", bind=False)
def _filtered_vector_top_k(b):
    emb = b.table("embeddings")
    docs = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    reqs = search.label_centroids(emb).withColumn("label", F.col("query_id"))
    return search.vector_top_k(docs, reqs, VECTOR_TOP, filters=[("label", "label", "eq")])


_BENCH_REQ = "SELECT item_id AS query_id, text AS query_text FROM benchmark"


@register("keyword_top_k", "WITH " + bm25_ctes("kw", "SELECT doc_id, text FROM documents", _BENCH_REQ,
                                               VECTOR_TOP).strip()
          + "\nSELECT query_id, doc_id, score, rank FROM kw_top", bind=False)
def _keyword_top_k(b):
    reqs = b.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return search.keyword_top_k(b.table("documents"), reqs, VECTOR_TOP)


_HYB_DOCS = ("SELECT d.doc_id, d.text, CAST(e.embedding AS DOUBLE[]) AS v FROM documents d "
             "LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
_HYB_REQ = ("SELECT b.item_id AS query_id, b.text AS query_text, CAST(e.embedding AS DOUBLE[]) AS qv "
            "FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id")


@register("hybrid_search", "WITH " + _hybrid_ctes("hy", _HYB_DOCS, _HYB_REQ)
          + "\nSELECT query_id, doc_id, rrf, rank FROM hy_top", bind=False)
def _hybrid(b):
    emb = b.table("embeddings")
    docs = (b.table("documents").select("doc_id", "text")
            .join(emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left"))
    reqs = (b.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
            .join(emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")),
                  "query_id", "left"))
    return search.hybrid_search(docs, reqs, SEARCH_TOP)


# One request per learner: the learner's department, a level, a format and a longest duration by learner number.
_LEARNER_REQ = f"""
SELECT c_custkey AS query_id, 'Courses about ' || job_title || ' in ' || department AS query_text, CAST(e.embedding AS DOUBLE[]) AS qv,
       department AS r_department, ({LEVELS})[c_custkey % 3 + 1] AS r_level,
       CASE WHEN c_custkey % 2 = 0 THEN ({FMTS})[c_custkey % 4 + 1] END AS r_format,
       CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS r_hours
FROM dim_learners LEFT JOIN embeddings e ON e.vec_id = c_custkey"""
_CATALOGUE_DOCS = f"""
SELECT c.course_id AS doc_id, {EMBED_TEXT_SQL} AS text, CAST(e.embedding AS DOUBLE[]) AS v, department, skill_level, format,
       CAST(duration_hours AS DOUBLE) AS duration_hours
FROM dim_courses c LEFT JOIN embeddings e ON c.course_id = printf('COURSE-%04d', e.vec_id + 1)"""
_ALL_FILTERS = ("(q.r_department IS NULL OR d.department = q.r_department) AND (q.r_level IS NULL OR d.skill_level = q.r_level) "
                "AND (q.r_format IS NULL OR d.format = q.r_format) AND (q.r_hours IS NULL OR d.duration_hours <= q.r_hours)")


_LEARNER_FILTERS = [("department", "r_department", "eq"), ("skill_level", "r_level", "eq"), ("format", "r_format", "eq"), ("duration_hours", "r_hours", "le")]


def _learner_requests(b: Binding) -> DataFrame:
    key = F.regexp_extract("learner_id", r"(\d+)$", 1).cast("bigint")
    return b.dim_learners.select(
        key.alias("query_id"), F.concat(F.lit("Courses about "), "job_title", F.lit(" in "), "department").alias("query_text"),
        F.col("department").alias("r_department"), pick(key, SKILL_LEVELS).alias("r_level"),
        F.when(key % 2 == 0, pick(key, FORMATS)).alias("r_format"), F.when(key % 5 > 0, (key % 50).cast("double")).alias("r_hours"))


@register("filtered_hybrid_search", "WITH " + _hybrid_ctes("fh", _CATALOGUE_DOCS, _LEARNER_REQ, _ALL_FILTERS)
          + "\nSELECT query_id, doc_id AS course_id, rrf, rank FROM fh_top")
def _filtered_hybrid(b):
    """Department, level, format and duration filters on one hybrid request per learner."""
    reqs = _learner_requests(b)
    docs = _searchable(b, "department", "skill_level", "format", F.col("duration_hours").cast("double").alias("duration_hours"))
    hits = search.hybrid_search(docs, _with_vector(b, reqs, F.col("query_id")), SEARCH_TOP, doc_id="course_id", text="embed_text", vec="content_vector",
                                filters=_LEARNER_FILTERS)
    return hits.withColumnRenamed("doc_id", "course_id")


# A department's request takes the vector of its place in the department list.
_GAP_REQ = f"""
SELECT g.department AS query_id, g.department AS r_department, CAST(any_value(e.embedding) AS DOUBLE[]) AS qv,
       'Courses teaching: ' || string_agg(skill_name, ', ' ORDER BY rank) AS query_text
FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY skill_gap DESC, skill_name) AS rank
      FROM gold_department_skills) g LEFT JOIN embeddings e ON e.vec_id = list_position({DEPTS}, g.department) - 1
WHERE rank <= 3 GROUP BY g.department"""
_SKILL_HITS = _hybrid_ctes("sk", _CATALOGUE_DOCS, _GAP_REQ, "d.department = q.r_department")


def _gap_requests(b: Binding) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, DEPARTMENTS)), F.col("department")) - 1
    return _with_vector(b, search.gap_skill_requests(_gds(b)), place)


@register("search_by_skills", "WITH " + _SKILL_HITS + "\nSELECT query_id, doc_id AS course_id, rrf, rank FROM sk_top")
def _search_by_skills(b):
    hits = search.search_by_skills(_searchable(b, "department"), _gap_requests(b), SEARCH_TOP)
    return hits.withColumnRenamed("doc_id", "course_id")


# ── context and prompt tables (H1-H6) and plan items (P-2, P-6, P-9, P-10) ─

from coursemetrics.operators import context  # noqa: E402


_LEARNER_CONTEXT_CTES = f"""
lc_sk AS (
  SELECT email, string_agg(printf('  %-30s %.1f%s', skill_name, {sr('proficiency_level', 1)},
                                  CASE WHEN proficiency_level < 3.5 THEN ' <-- GAP' ELSE '' END),
                           chr(10) ORDER BY proficiency_level, skill_pos) AS lines
  FROM learner_skills GROUP BY email),
lc_gp AS (
  SELECT department, chr(10) || 'TOP DEPARTMENT SKILL GAPS:' || chr(10)
         || string_agg(printf('  %-30s avg=%.2f  gap=%.2f', skill_name, {sr('avg_proficiency', 2)},
                              {sr('skill_gap', 2)}), chr(10) ORDER BY rank) AS gaps_block
  FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY skill_gap DESC, skill_name) AS rank
        FROM gold_department_skills WHERE coalesce(skill_gap, 0) > 0) t
  WHERE rank <= 5 GROUP BY department),
lc_done AS (
  SELECT learner_email AS email, list(course_id ORDER BY course_id) AS cs
  FROM (SELECT DISTINCT course_id, learner_email FROM silver WHERE verb = 'completed' AND course_completed) d
  GROUP BY learner_email),
lc AS (
SELECT l.learner_id, l.email,
       'LEARNER PROFILE:' || chr(10) || '  Name:       ' || coalesce(l.name, 'Unknown') || chr(10)
       || '  Department: ' || coalesce(l.department, 'Unknown') || chr(10)
       || '  Job title:  ' || coalesce(l.job_title, 'Unknown') || chr(10)
       || '  Hire date:  ' || coalesce(l.hire_date, 'Unknown')
       || coalesce(chr(10) || 'CURRENT SKILL PROFICIENCY (out of 5.0, target is 3.5):' || chr(10) || sk.lines, '')
       || coalesce(gp.gaps_block, '')
       || CASE WHEN len(done.cs) > 0 THEN chr(10) || 'ALREADY COMPLETED (' || CAST(len(done.cs) AS VARCHAR)
               || ' courses):' || chr(10)
               || array_to_string(list_transform(done.cs[1:10], lambda c: '  ' || c), chr(10))
               || CASE WHEN len(done.cs) > 10 THEN chr(10) || '  ... and ' || CAST(len(done.cs) - 10 AS VARCHAR)
                       || ' more' ELSE '' END
               ELSE '' END AS context
FROM dim_learners l LEFT JOIN lc_sk sk ON sk.email = l.email LEFT JOIN lc_gp gp ON gp.department = l.department
LEFT JOIN lc_done done ON done.email = l.email)"""


@register("learner_context", "WITH " + _LEARNER_CONTEXT_CTES.strip() + "\nSELECT learner_id, email, context FROM lc")
def _learner_context(b):
    return context.learner_context(b.dim_learners, _gds(b), reports.completions(b.silver))


def _skill_hits(b: Binding) -> tuple[DataFrame, DataFrame]:
    reqs = _gap_requests(b)
    hits = search.search_by_skills(_searchable(b, "department"), reqs, SEARCH_TOP).withColumnRenamed("doc_id", "course_id")
    return hits.join(_catalogue_docs(b).drop("content_vector"), "course_id"), reqs


_NA = "CASE WHEN {c} IS NULL OR {c} = 0 THEN 'N/A' ELSE CAST({c} AS VARCHAR) END"


def context_system_sql() -> str:
    """SQL twin of the system message of ``context.rag_prompts``."""
    prompt = context.SYSTEM_PROMPT.replace("'", "''")
    return (f"'{prompt}' || coalesce(chr(10) || chr(10) || lcc.context, '') || chr(10) || chr(10) "
            "|| '<search_results>' || chr(10) || coalesce(b.search_block, 'No courses found matching this query.') "
            "|| chr(10) || '</search_results>'")


def _block_ctes(p: str, top_cte: str, req_sql: str) -> str:
    """CTE ``{p}_blocks`` (query_id, search_block) from hits ``top_cte`` (query_id, doc_id=course_id, rank)."""
    return f"""
{p}_cat AS ({_SEARCH_DOCS_SQL}),
{p}_h AS (SELECT t.query_id, t.rank, c.* FROM {top_cte} t JOIN {p}_cat c ON c.course_id = t.doc_id),
{p}_blk AS (
  SELECT query_id, 'AVAILABLE COURSES FROM CATALOG:' || chr(10) || string_agg(
      chr(10) || printf('[%d] %s (ID: %s)', rank, title, course_id) || chr(10)
      || '    Department: ' || coalesce(department, '?') || '  |  Level: ' || coalesce(skill_level, '?') || chr(10)
      || '    Format: ' || coalesce(format, '?') || '  |  Duration: ' || CAST(duration_hours AS VARCHAR) || 'h'
      || chr(10) || '    Skills taught: ' || skills_taught || chr(10)
      || '    Completion rate: ' || {_NA.format(c='completion_rate')} || '%  |  Avg score: '
      || {_NA.format(c='avg_score')} || chr(10)
      || '    Description: ' || substring(coalesce(description, ''), 1, 200), chr(10) ORDER BY rank) AS block
  FROM {p}_h GROUP BY query_id),
{p}_blocks AS (
  SELECT r.query_id, coalesce(b.block, 'No courses found matching this query.') AS search_block
  FROM (SELECT DISTINCT query_id FROM ({req_sql}) q) r LEFT JOIN {p}_blk b ON b.query_id = r.query_id)"""


@register("search_results_block", "WITH " + _SKILL_HITS + ","
          + _block_ctes("sb", "sk_top", _GAP_REQ).rstrip() + "\nSELECT query_id, search_block FROM sb_blocks")
def _results_block(b):
    hits, reqs = _skill_hits(b)
    return context.search_results_block(hits, reqs)


@register("skill_profile", f"""
SELECT learner_id, rank AS position, skill_name, proficiency_level,
       CASE WHEN proficiency_level < 2.5 THEN 'red' WHEN proficiency_level < 3.5 THEN 'yellow' ELSE 'green' END
         AS band,
       printf('%s — %.1f/5', skill_name, {sr('proficiency_level', 1)}) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY proficiency_level, skill_pos) AS rank
      FROM learner_skills) s WHERE rank <= 6""")
def _skill_profile(b):
    return context.skill_profile(b.dim_learners)


@register("conversation_history", """
SELECT conv_id, turn AS position, role, text AS content FROM conversations WHERE role IN ('user', 'assistant')""",
          bind=False)
def _history(b):
    return context.conversation_history(b.table("conversations"))


_RAG_REQ = """
SELECT c.conv_id, c.turn, c.text AS message
FROM conversations c
JOIN (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id) m
  ON m.conv_id = c.conv_id AND m.turn = c.turn"""
# A conversation belongs to the learner of its number: the search is kept to that learner's department, where there is one.
_RAG_HITS_REQ = """SELECT rq.conv_id AS query_id, rq.message AS query_text, CAST(e.embedding AS DOUBLE[]) AS qv, l.department AS r_department
FROM rq LEFT JOIN embeddings e ON e.vec_id = rq.conv_id LEFT JOIN dim_learners l ON l.c_custkey = rq.conv_id"""


@register("rag_prompts", "WITH rq AS (" + _RAG_REQ + ")," + _hybrid_ctes(
    "rg", _CATALOGUE_DOCS, _RAG_HITS_REQ, "(q.r_department IS NULL OR d.department = q.r_department)").rstrip()
    + "," + _block_ctes("rb", "rg_top", "SELECT conv_id AS query_id FROM rq").rstrip() + ","
    + _LEARNER_CONTEXT_CTES.strip() + ",\n" + f"""
lcc AS (SELECT CAST(regexp_extract(email, '^user(\\d+)@', 1) AS BIGINT) AS conv_id, context FROM lc)
SELECT rq.conv_id, CAST(0 AS BIGINT) AS position, 'system' AS role,
       {context_system_sql()} AS content
FROM rq LEFT JOIN rb_blocks b ON b.query_id = rq.conv_id LEFT JOIN lcc ON lcc.conv_id = rq.conv_id
UNION ALL
SELECT h.conv_id, h.turn + 1, h.role, h.text
FROM conversations h JOIN rq ON rq.conv_id = h.conv_id
WHERE h.role IN ('user', 'assistant') AND h.turn < rq.turn
UNION ALL
SELECT conv_id, turn + 1, 'user', message FROM rq""")
def _rag_prompts(b):
    conv = b.table("conversations")
    reqs = context.last_user_messages(conv)
    learners = b.dim_learners.select(F.regexp_extract("learner_id", r"(\d+)$", 1).cast("bigint").alias("conv_id"), "department")
    asked = reqs.join(learners, "conv_id", "left").select(F.col("conv_id").alias("query_id"), F.col("message").alias("query_text"), "department")
    hits = (search.search_by_skills(_searchable(b, "department"), _with_vector(b, asked, F.col("query_id")), SEARCH_TOP)
            .withColumnRenamed("doc_id", "course_id")
            .join(_catalogue_docs(b).drop("content_vector"), "course_id"))
    blocks = context.search_results_block(hits, reqs.select(F.col("conv_id").alias("query_id"))) \
        .withColumnRenamed("query_id", "conv_id")
    ctx = (context.learner_context(b.dim_learners, _gds(b), reports.completions(b.silver))
           .select(F.regexp_extract("email", r"^user(\d+)@", 1).cast("bigint").alias("conv_id"), "context"))
    return context.rag_prompts(reqs, context.conversation_history(conv), blocks, ctx)


@register("dept_skills_active_learners", f"""
WITH active AS (SELECT DISTINCT learner_email AS email, department AS event_department FROM silver)
SELECT a.event_department AS department, ls.skill_name,
       {sr('AVG(ls.proficiency_level)', 2)} AS avg_proficiency,
       {sr('3.5 - AVG(ls.proficiency_level)', 2)} AS skill_gap, COUNT(*) AS learner_count
FROM learner_skills ls JOIN active a ON ls.email = a.email GROUP BY a.event_department, ls.skill_name""")
def _dept_skills_active(b):
    return context.dept_skills_active_learners(gold.learner_skill_rows(b.dim_learners), b.silver)


def _part(u: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract(duration_iso, '(\\d+){u}', 1) AS BIGINT), 0)"


@register("avg_duration_hours", f"""
WITH t AS (SELECT course_id, CASE WHEN duration_iso IS NOT NULL
                                  THEN {_part('H')} * 3600 + {_part('M')} * 60 + {_part('S')} END AS secs
           FROM silver)
SELECT course_id, {sr('AVG(secs) / 3600.0', 4)} AS avg_duration_hours, COUNT(secs) AS timed_events
FROM t GROUP BY course_id""")
def _avg_duration(b):
    return context.avg_duration_hours(b.silver)


@register("course_review_input", """
WITH f AS (SELECT course_id, list({'module_id': module_id, 'learners_reached': learners_reached,
                                   'learners_completed': learners_completed,
                                   'module_completion_pct': module_completion_pct,
                                   'avg_quiz_score': avg_quiz_score} ORDER BY module_id) AS modules
           FROM gold_module_dropoff GROUP BY course_id)
SELECT g.course_id, CAST(to_json({'course_id': g.course_id, 'title': g.title, 'department': g.department,
                                  'course_format': g.course_format, 'enrolled': g.enrolled,
                                  'completed': g.completed, 'completion_rate_pct': g.completion_rate_pct,
                                  'avg_score': g.avg_score, 'modules': f.modules}) AS VARCHAR) AS review_input
FROM gold_course_completion g LEFT JOIN f ON f.course_id = g.course_id""")
def _course_review(b):
    return context.course_review_input(_gcc(b), _gmd(b))


@register("gap_review_input", """
WITH g AS (SELECT department, list({'skill_name': skill_name, 'avg_proficiency': avg_proficiency,
                                   'skill_gap': skill_gap} ORDER BY rank) AS gaps
           FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY skill_gap DESC, skill_name) AS rank
                 FROM gold_department_skills) x WHERE rank <= 10 GROUP BY department),
c AS (SELECT department, list({'course_id': course_id, 'title': title} ORDER BY rank) AS courses
      FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY title, course_id) AS rank
            FROM dim_courses) y WHERE rank <= 15 GROUP BY department)
SELECT coalesce(g.department, c.department) AS department,
       CAST(to_json({'department': coalesce(g.department, c.department), 'gaps': g.gaps, 'courses': c.courses})
            AS VARCHAR) AS review_input
FROM g FULL OUTER JOIN c ON g.department = c.department""")
def _gap_review(b):
    return context.gap_review_input(_gds(b), b.dim_courses)


# ── bronze statements -> silver (A1, B1, B2) ───────────────────────────────

from coursemetrics.operators import silver as silver_ops  # noqa: E402
from coursemetrics.sources import raw  # noqa: E402
from coursemetrics.sources.schemas import EVENT_SCHEMA  # noqa: E402


@register("silver_from_bronze", "SELECT * FROM silver")
def _silver_from_bronze(b):
    """Events nested into statements, serialised to JSON text, parsed with the declared
    schema and flattened again: the result equals the bound silver table."""
    statements = raw.statements_from_silver(b.silver)
    text = statements.select(F.to_json(F.struct(*statements.columns)).alias("json"))
    # inline(array(..)) is a generator: it keeps the optimizer from copying from_json into every
    # field access (one parse per row instead of one per referenced field)
    bronze = text.select(F.inline(F.array(F.from_json("json", EVENT_SCHEMA))))
    flat = silver_ops.silver_events(bronze)
    return flat.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ── streaming (S1-S3) ────────────────────────────────────

from coursemetrics import streaming  # noqa: E402


def _event_stream(b: Binding) -> DataFrame:
    """The events as a file stream: the table's folder, or the driver's folder where the table is one file in it."""
    folder = f"{b.sf_dir.rstrip('/')}/events.parquet"
    one_file = b.spark.read.parquet(folder).inputFiles()[0].endswith("/events.parquet")
    stream = streaming.events.read_event_stream(b.spark, b.sf_dir if one_file else folder, file_filter="events.parquet" if one_file else None)
    return streaming.stream_silver(stream, b.table("part").count())


def _stream_folders(b: Binding, name: str) -> tuple[str, str]:
    """Output and checkpoint of a stream, new for every call: each reads all of its input."""
    root = f"{checkpoint_dir(b.spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return f"{root}/data", f"{root}/checkpoint"


@register("stream_silver", "SELECT * FROM silver")
def _stream_silver(b):
    return b.spark.read.parquet(streaming.run_to_table(_event_stream(b), *_stream_folders(b, "silver")))


@register("stream_dedup", "SELECT * FROM silver")
def _stream_dedup(b):
    """Event ids are unique in the driver data, so the deduplicated stream equals silver
    (event time shown as UTC wall-clock time again)."""
    out = streaming.run_to_table(streaming.stream_dedup(_event_stream(b)), *_stream_folders(b, "dedup"))
    return b.spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_engagement")
def _stream_engagement(b):
    return streaming.engagement_table(b.spark, streaming.run_engagement(_event_stream(b), *_stream_folders(b, "engagement")))


@register("stream_engagement_counts", """
SELECT course_id, module_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, COUNT(*) AS event_count
FROM silver WHERE verb IN ('interacted', 'progressed', 'launched') GROUP BY ALL""")
def _stream_engagement_counts(b):
    """The exact columns of the streaming engagement job, shown as UTC wall-clock times."""
    return _stream_engagement(b).select(
        "course_id", "module_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_count")


@register("stream_exact_learners", """
SELECT course_id, module_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, COUNT(*) AS event_count, COUNT(DISTINCT learner_email) AS unique_learners
FROM silver WHERE verb IN ('interacted', 'progressed', 'launched') GROUP BY ALL""")
def _stream_exact_learners(b):
    """Distinct learners of every window by keyed state, exactly."""
    out = streaming.run_exact_engagement(_event_stream(b), *_stream_folders(b, "exact-learners"), delay="1 hour")
    return streaming.exact_engagement_table(b.spark, out).select(
        "course_id", "module_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_count", "unique_learners")


@register("stream_merge", "SELECT * FROM silver")
def _stream_merge(b):
    """All events merged into a table, then all of them again, as a source that delivers twice: each is stored once."""
    out, checkpoint = _stream_folders(b, "merge")
    for name in ("first", "again"):
        streaming.run_merge(_event_stream(b), out, f"{checkpoint}-{name}", name)
    return streaming.merged_table(b.spark, out, b.silver.schema)


# ── search indexes and factors (G4, G5, F3/F4 beyond one driver) ───────────

from coursemetrics.operators import ann, factors, postings  # noqa: E402

_INDEXES: dict = {}


def _written(b: Binding, name: str, build):
    """An index or fit that is written once for a data folder and session, in a folder of its own on shared storage."""
    key = (name, b.sf_dir.rstrip("/"), b.spark.sparkContext.applicationId)
    if key not in _INDEXES:
        _INDEXES[key] = build(f"{checkpoint_dir(b.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _INDEXES[key]


def _vectors(b: Binding) -> DataFrame:
    return b.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _vector_requests(b: Binding) -> DataFrame:
    """The stated query set of a similarity search: every vector whose id is divisible by 20, against all vectors."""
    return _vectors(b).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))


def _approximate(b: Binding) -> DataFrame:
    index = _written(b, "vector-buckets", lambda path: ann.build_index(_vectors(b), path, VECTOR_TOP))
    return ann.approximate_top_k(index, _vector_requests(b), VECTOR_TOP)


@register("approximate_vector_top_k")
def _approximate_vector_top_k(b):
    return _approximate(b)


@register("approximate_vector_recall", f"""
SELECT COUNT(*) AS requests, COUNT(*) * least({VECTOR_TOP}, (SELECT COUNT(*) FROM embeddings)) AS exact_hits, true AS recall_reached, true AS exact_scores
FROM embeddings WHERE vec_id % 20 = 0""", bind=False)
def _approximate_vector_recall(b):
    """At least 0.9 of the exact neighbours are found, each with its exact similarity."""
    exact = search.vector_top_k(_vectors(b), _vector_requests(b), VECTOR_TOP)
    told = ann.recall(_approximate(b), exact)
    return told.select("requests", "exact_hits", (F.col("recall") >= 0.9).alias("recall_reached"), "exact_scores")


@register("postings_top_k", ORACLE["keyword_top_k"], bind=False)
def _postings_top_k(b):
    docs = b.table("documents").select("doc_id", "text")
    index = _written(b, "postings", lambda path: postings.build_postings(docs, path))
    reqs = b.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return postings.postings_top_k(index, reqs, VECTOR_TOP)


def _factor_recommendations(b: Binding) -> DataFrame:
    fit = _written(b, "factors", lambda path: factors.fit_factors(features.interaction_matrix(b.silver), path))
    return factors.recommend_by_factors(fit, 5)


@register("factor_recommendations")
def _recommend_by_factors(b):
    return _factor_recommendations(b)


@register("factor_recommendation_counts", f"""
WITH i AS ({_INTERACTIONS}), n AS (SELECT COUNT(DISTINCT course_id) AS n FROM i)
SELECT learner_email, least(5, any_value(n.n) - COUNT(*)) AS courses, CAST(0 AS BIGINT) AS started FROM i, n GROUP BY learner_email""")
def _factor_recommendation_counts(b):
    """Courses recommended to each learner by the factors, and how many of them it has started (none)."""
    old = features.interaction_matrix(b.silver).select("learner_email", "course_id", F.lit(1).alias("old"))
    r = _factor_recommendations(b).join(old, ["learner_email", "course_id"], "left")
    return r.groupBy("learner_email").agg(F.count("*").alias("courses"), F.count("old").alias("started"))


# ── uploads (A10) ──────────────────────────────────────────────────────────

from coursemetrics.sources import upload  # noqa: E402


@register("upload_totals", "SELECT COUNT(*) AS succeeded, CAST(0 AS BIGINT) AS failed FROM dim_courses")
def _upload_totals(b):
    """The catalogue's search documents sent in batches to a service that refuses some of them the first time."""
    def send(documents: list[dict]) -> list[bool]:
        known = send.__dict__.setdefault("known", set())
        told = [int(d["course_id"].rpartition("-")[2]) % 97 != 0 or d["course_id"] in known for d in documents]
        known.update(d["course_id"] for d in documents)
        return told
    ledger = f"{checkpoint_dir(b.spark).rstrip('/')}/uploads-{uuid.uuid4().hex}"
    return upload.upload_totals(upload.upload_documents(_catalogue_docs(b).drop("content_vector"), send, ledger)).drop("batches")


# ── sketches (D4 -> D12) and statements as VARIANT (A1) ────────────────────

from coursemetrics.operators import sketches  # noqa: E402
from coursemetrics.sources import variant  # noqa: E402


@register("engagement_heatmap_unions", """
SELECT course_id, module_id, CAST(hour(ts) AS BIGINT) AS hour_of_day, COUNT(*) AS event_count, COUNT(DISTINCT learner_email) AS unique_learners
FROM silver WHERE verb IN ('interacted', 'progressed', 'launched') GROUP BY ALL""")
def _heatmap_unions(b):
    """Weekday cells united: a learner of two days counts once (exact below 4,096 learners a cell)."""
    return sketches.union_over(sketches.engagement_sketches(b.silver), "course_id", "module_id", "hour_of_day")


@register("active_without_completion", """
WITH s AS (SELECT course_id, learner_email, bool_or(verb IN ('interacted', 'progressed', 'launched')) AS active, bool_or(coalesce(course_completed, false)) AS done
           FROM silver GROUP BY ALL)
SELECT course_id, COUNT(*) FILTER (active) AS active, COUNT(*) FILTER (active AND NOT done) AS active_not_completed FROM s GROUP BY course_id""")
def _active_without_completion(b):
    return sketches.active_without_completion(b.silver)


@register("undeclared_statement_fields", """
SELECT event_id, course_format AS client_format, CAST(hour(ts) AS BIGINT) AS client_hour, module_id FROM silver""")
def _undeclared_fields(b):
    """Statements with a field that no schema names, kept whole as VARIANT: the field and a declared one read from it."""
    statements = raw.statements_from_silver(b.silver)
    extensions, hour = F.col("context.extensions"), F.hour(F.to_timestamp("timestamp"))
    client = F.struct(extensions.getItem(f"{raw.EXT_BASE}format").alias("format"), hour.alias("hour")).alias("client")
    bronze = variant.parsed(statements.select(F.to_json(F.struct(*statements.columns, client)).alias("json")), "json")
    return bronze.select(variant.field("$.id", "string").alias("event_id"), variant.field("$.client.format", "string").alias("client_format"),
                         variant.field("$.client.hour", "bigint").alias("client_hour"),
                         variant.field(f"$.context.extensions['{raw.EXT_BASE}module_id']", "string").alias("module_id"))


# ── facets of hits (G9) and clustered silver (A5) ──────────────────────────

from coursemetrics.operators import facets  # noqa: E402
from coursemetrics.sources.sinks import write_clustered  # noqa: E402

_FILTER_COLUMNS = "r_department, r_level, r_format, r_hours"
_HIT_FACETS = "\nUNION ALL ".join(
    [f"SELECT {_FILTER_COLUMNS}, '{f}' AS facet, {f} AS value, COUNT(*) AS count FROM h GROUP BY ALL" for f in ("department", "skill_level", "format")]
    + [f"SELECT {_FILTER_COLUMNS}, 'skills_taught', s, COUNT(DISTINCT course_id) FROM (SELECT *, unnest(skills_taught) AS s FROM h) x GROUP BY ALL"])


@register("filtered_facet_counts", f"""
WITH q AS (SELECT DISTINCT {_FILTER_COLUMNS} FROM ({_LEARNER_REQ}) r), h AS (SELECT q.*, d.* FROM q JOIN dim_courses d ON {_ALL_FILTERS})
{_HIT_FACETS}""")
def _filtered_facets(b):
    """Facet counts of the courses that pass each filter of ``filtered_hybrid_search``, from stored bitmaps."""
    index = _written(b, "facet-bitmaps", lambda path: facets.build_facets(b.dim_courses, path))
    return facets.facets_of_hits(index, _learner_requests(b), _LEARNER_FILTERS)


@register("clustered_silver_courses", """
SELECT course_id, COUNT(*) AS events, COUNT(DISTINCT learner_email) AS learners, TRUE AS neighbouring_files FROM silver GROUP BY course_id""")
def _clustered_courses(b):
    """Silver as range-clustered files: every course from its files, and whether it fills all files between its first and last."""
    path = _written(b, "silver-clustered", lambda path: (write_clustered(b.silver, path), path)[1])
    silver = b.spark.read.schema(b.silver.schema).parquet(path)
    by_file = silver.groupBy("course_id", F.input_file_name().alias("file"), "learner_email").agg(F.count("*").alias("n"))
    parts = by_file.groupBy("file").agg(F.min("course_id").alias("low"), F.max("course_id").alias("high"))
    whole = (by_file.groupBy("course_id", "learner_email").agg(F.sum("n").alias("n"))
             .groupBy("course_id").agg(F.sum("n").alias("events"), F.count("learner_email").alias("learners")))
    # A file's inner courses lie in that file alone.
    held = by_file.select("course_id", "file").distinct().join(parts, "file")
    inner = held.groupBy("course_id").agg(F.count("*").alias("files"), F.max(((F.col("course_id") > F.col("low")) & (F.col("course_id") < F.col("high"))).cast("int")).alias("within"))
    return (whole.join(inner, "course_id")
            .select("course_id", "events", "learners", ((F.col("files") == 1) | (F.col("within") == 0)).alias("neighbouring_files")))
