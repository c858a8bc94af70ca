import os

from pyspark.sql import functions as F

from coursemetrics.operators import dropout, features, reports, search
from coursemetrics.plans.medallion import build_tables
from coursemetrics.sources.binding import Binding
from paths import SF_SMALL


def test_build_tables_from_driver_tables(spark, tmp_path):
    paths = build_tables(spark, str(tmp_path / "lake"), sf_dir=SF_SMALL)
    silver = spark.read.parquet(paths["silver_xapi_events"])
    assert silver.count() == 1000
    assert any(d.startswith("course_id=") for d in os.listdir(paths["silver_xapi_events"]))  # partitioned
    g = spark.read.parquet(paths["gold_course_completion"])
    assert g.count() == silver.select("course_id").distinct().count() > 20 and g.filter(F.col("completed") > F.col("enrolled")).count() == 0


def test_funnel_invariants(spark):
    b = Binding(spark, SF_SMALL)
    from coursemetrics.operators import gold
    m = gold.gold_module_dropoff(b.silver)
    assert m.filter(F.col("learners_completed") > F.col("learners_reached")).count() == 0
    assert m.filter((F.col("module_completion_pct") < 0) | (F.col("module_completion_pct") > 100)).count() == 0


def test_drop_private_and_display(spark):
    df = spark.createDataFrame([(1, "x", 2)], "a int, _hidden string, _dropoff int")
    assert reports.drop_private_columns(df).columns == ["a"]
    rows = spark.createDataFrame([("Ann", "HR", 3, 12)], "learner_name string, department string, "
                                 "modules_started int, days_inactive int")
    assert reports.at_risk_display(rows).columns == ["Name", "Dept", "Modules Started", "Days Inactive"]


def test_course_document(spark):
    b = Binding(spark, SF_SMALL)
    from coursemetrics.operators import gold
    docs = search.search_docs(b.dim_courses, gold.gold_course_completion(b.silver, b.dim_courses),
                              search.course_vectors_from_embeddings(b.table("embeddings")))
    one = search.course_document(docs, "COURSE-0001")
    assert one.count() == 1 and "content_vector" not in one.columns
    assert search.course_document(docs, "NOPE").count() == 0


def test_cross_validation_runs(spark):
    f = features.training_features(Binding(spark, SF_SMALL).silver)
    cv = dropout.cross_validate_dropout(f, params={"maxIter": 2, "minInstancesPerNode": 2}, n_folds=3)
    assert len(cv["fold_auc"]) == 3 and cv["std_auc"] >= 0


def test_build_tables_from_raw_json(spark, tmp_path):
    import json
    import shutil
    raw = tmp_path / "raw"
    raw.mkdir()
    shutil.copy(os.path.join(os.path.dirname(__file__), "fixtures", "raw_events.json"), raw / "xapi_events.json")
    (raw / "courses.json").write_text(json.dumps([
        {"course_id": "C1", "title": "Intro", "department": "Sales", "skill_level": "beginner", "format": "blended",
         "duration_hours": 4, "skills_taught": ["Negotiation"], "description": "d", "num_modules": 5,
         "module_titles": ["M1"], "prerequisites": [], "_dropoff_prone": True}]))
    (raw / "learners.json").write_text(json.dumps([
        {"learner_id": "LRN-0001", "name": "Ada", "email": "ada@example.com", "department": "Sales",
         "job_title": "Rep", "manager_email": "m@example.com", "hire_date": "2020-01-01",
         "skills": [{"skill_name": "Negotiation", "proficiency_level": 2.5}], "completed_courses": []}]))
    paths = build_tables(spark, str(tmp_path / "lake"), raw_dir=str(raw))
    assert spark.read.parquet(paths["bronze_xapi_events"]).count() == 9
    assert spark.read.parquet(paths["silver_xapi_events"]).count() == 6
    g = spark.read.parquet(paths["gold_course_completion"]).collect()
    assert len(g) == 1 and g[0]["enrolled"] == 2 and g[0]["completed"] == 1
    assert "_dropoff_prone" not in spark.read.parquet(paths["dim_courses"]).columns


def test_facade_prunes_course_partitions(spark, tmp_path):
    import io
    from contextlib import redirect_stdout
    from coursemetrics.api import LearningAnalytics
    from coursemetrics.plans import registry
    build_tables(spark, str(tmp_path / "lake"), sf_dir=SF_SMALL)
    la = LearningAnalytics(spark, str(tmp_path / "lake"))
    one = la.at_risk_learners("COURSE-0004", as_of=registry.AS_OF_AT_RISK)
    buf = io.StringIO()
    with redirect_stdout(buf):
        one.explain("formatted")
    assert "PartitionFilters: [isnotnull(course_id" in buf.getvalue() and "COURSE-0004" in buf.getvalue()
    every = registry.QUERIES["at_risk_learners"](spark, SF_SMALL).filter("course_id = 'COURSE-0004'")
    cols = ["learner_email", "modules_started", "days_inactive", "avg_score"]
    assert sorted(one.select(cols).collect()) == sorted(every.select(cols).collect())
    assert la.overview_kpis().count() == 1 and la.course_ranking().count() > 0


def test_time_defaults_to_now(spark):
    """Without as_of, activity is measured against the current time: the events of today count, old ones are inactive."""
    silver = spark.sql("""SELECT 'C' AS course_id, 'a@x' AS learner_email, 'A' AS learner_name, 'HR' AS department, 'M1' AS module_id,
                          'launched' AS verb, false AS course_completed, 1.0D AS score, current_timestamp() AS ts
                          UNION ALL SELECT 'C', 'b@x', 'B', 'HR', 'M1', 'launched', false, 1.0D, current_timestamp() - INTERVAL 30 DAYS
                          UNION ALL SELECT 'C', 'c@x', 'C', 'HR', 'M2', 'launched', false, 1.0D, current_timestamp() - INTERVAL 90 DAYS""")
    gold_cc = spark.createDataFrame([(9, 50.0)], "enrolled int, completion_rate_pct double")
    kpis = reports.overview_kpis(silver, gold_cc, spark.range(2)).first()
    assert kpis.total_learners == 3 and kpis.active_this_month in (1, 2)
    late = {r.learner_email: r.days_inactive for r in reports.at_risk_learners(silver).collect()}
    assert late.keys() == {"b@x", "c@x"} and late["b@x"] in (30, 31) and late["c@x"] in (90, 91)


def test_search_docs_and_dropout_risk_jobs(spark, tmp_path):
    from coursemetrics.plans.medallion import build_dropout_risk, build_search_docs
    root = str(tmp_path / "lake")
    build_tables(spark, root, sf_dir=SF_SMALL)
    docs = spark.read.parquet(build_search_docs(spark, root, lambda texts: [[float(len(t)), 1.0] for t in texts]))
    assert docs.count() == 200 and docs.where("size(content_vector) = 2").count() == 200 and docs.where("completion_rate is not null").count() > 0
    model = build_dropout_risk(spark, root, params={"maxIter": 2})
    risk = spark.read.parquet(f"{root}/gold_dropout_risk")
    assert risk.count() == model.metrics["n_samples"] == spark.read.parquet(f"{root}/dropout_training_features").count()
    assert risk.where("dropout_risk_score not between 0 and 1").count() == 0
