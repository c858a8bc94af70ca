"""What the short jobs of a fit read: few tasks, over a plan that is cut."""

import numpy as np
from pyspark.sql import functions as F

from coursemetrics.operators import dropout, recommend


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_fit_has_no_more_tasks_than_run_at_once():
    assert [dropout.fit_tasks(n, 12) for n in (0, 1, 25_001, 640_000, 3_800_000, 24_000_000)] == [1, 1, 2, 12, 12, 24]
    assert [recommend.vector_tasks(n, 12) for n in (0, 5_000, 15_000, 540_000, 30_000_000)] == [1, 1, 3, 12, 30]


def test_a_fit_reads_a_table_whose_plan_is_cut(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    kept = rows.persist()
    try:
        got = dropout.for_fit(kept)
    finally:
        kept.unpersist()
    assert "InMemory" not in plan(got) and "Aggregate" not in plan(got)
    assert got.rdd.getNumPartitions() == 1 and got.exceptAll(rows).count() == 0 and got.count() == 100


def test_the_solver_reads_sparse_vectors_in_few_tasks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"l{i}", f"c{j:03d}", int(rng.integers(2, 9)), 0, 0.5) for i in range(240) for j in rng.choice(170, 5, replace=False)]
    given = spark.createDataFrame(rows, "learner_email string, course_id string, event_count long, completed long, avg_score double").repartition(9)
    seen = []

    def spy(vectors):
        seen.append((plan(vectors), vectors.rdd.getNumPartitions(), [type(r.row).__name__ for r in vectors.limit(3).collect()]))
        return matrix(vectors)
    matrix = recommend.RowMatrix
    monkeypatch.setattr(recommend, "RowMatrix", spy)
    recommend.fit_recommender(given, 5)
    (told, tasks, kinds), = seen
    assert tasks == 1 and set(kinds) == {"SparseVector"}
    before = plan(recommend.learner_cells(recommend.interaction_weights(given).select("learner_email", "course_id", "weight"), recommend.course_index(given)))
    assert "Aggregate" in before and "Aggregate" not in told and "Join" not in told
