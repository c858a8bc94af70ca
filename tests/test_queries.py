"""The driver contract and the DuckDB value check on the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from coursemetrics.plans import registry
from paths import SF_SMALL
from coursemetrics.sources.tables import DRIVER_TABLES

def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "completion_rate_pct" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    cur = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = [dict(zip(ocols, r)) for r in cur.fetchall()]
    assert sorted(sdf.columns) == sorted(ocols)
    cols = sorted(ocols)
    assert _rows([r.asDict() for r in sdf.collect()], cols) == _rows(orows, cols)


# What must hold in the queries whose values depend on a fitted model.
HOLDS = {
    "dropout_cross_validation": lambda rows: len(rows) == 1 and 0 <= rows[0]["mean_auc"] <= 1 and rows[0]["folds"] == 5,
    "dropout_model_info": lambda rows: len(rows) == 1 and rows[0]["trained"] and rows[0]["n_train"] + rows[0]["n_test"] == rows[0]["n_samples"],
    "feature_importances": lambda rows: len(rows) == 8 and abs(sum(r["importance"] for r in rows) - 1) < 0.01,
    "confusion_matrix": lambda rows: all(min(r["predicted_0"], r["predicted_1"]) >= 0 for r in rows) and len(rows) <= 2,
    "classification_report": lambda rows: {r["class_name"] for r in rows} == {"Dropout", "Completed", "accuracy", "macro avg", "weighted avg"}
    and all(0 <= r[c] <= 1 for r in rows for c in ("precision", "recall", "f1")),
    "gold_dropout_risk": lambda rows: rows and all(0 <= r["dropout_risk_score"] <= 1 for r in rows),
    "high_risk_pairs": lambda rows: all(r["dropout_risk_score"] > 0.65 for r in rows),
    "score_course": lambda rows: rows and all(r["risk_label"] == ("High" if r["dropout_risk"] >= 0.65 else "Medium" if r["dropout_risk"] >= 0.4 else "Low") for r in rows),
    "at_risk_with_risk": lambda rows: all((r["risk_tier"] == "—") == (r["dropout_risk"] is None) for r in rows),
    "svd_course_factors": lambda rows: rows and all(0 <= r["norm_sq"] <= 1 + 1e-9 for r in rows) and len({r["k"] for r in rows}) == 1,
    "recommender_info": lambda rows: len(rows) == 1 and 0 < rows[0]["explained_variance_ratio"] <= 1,
    "recommend_courses": lambda rows: rows and len({(r["learner_email"], r["rank"]) for r in rows}) == len(rows) and max(r["rank"] for r in rows) <= 5,
    "recommendations_with_title": lambda rows: rows and all(r["title"] for r in rows),
    "approximate_vector_top_k": lambda rows: rows and len({(r["query_id"], r["rank"]) for r in rows}) == len(rows)
    and all(r["doc_id"] == r["query_id"] and r["similarity"] == 1 for r in rows if r["rank"] == 1),
    "factor_recommendations": lambda rows: rows and len({(r["learner_email"], r["rank"]) for r in rows}) == len(rows) and max(r["rank"] for r in rows) <= 5,
    "stream_engagement": lambda rows: rows and all(1 <= r["approx_unique_learners"] <= r["event_count"] for r in rows),
}


def test_every_query_has_a_check():
    assert set(registry.QUERIES) - set(registry.ORACLE) == set(HOLDS)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_model_queries_hold(spark, name):
    assert HOLDS[name]([r.asDict() for r in registry.QUERIES[name](spark, SF_SMALL).collect()])
