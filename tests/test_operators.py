import json
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemetrics.operators import dropout, features, recommend, search
from coursemetrics.operators.context import extract_tool_sources
from coursemetrics.operators.embed import embed_catalogue
from coursemetrics.sources.binding import Binding
from coursemetrics.sources.inventory import raw_file_inventory, run_named_query
from paths import SF_SMALL


def test_vector_top1_is_itself(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(40)
    docs = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    reqs = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = search.vector_top_k(docs, reqs, 1, request_blocks=6).collect()
    assert len(top) == 40 and all(r["query_id"] == r["doc_id"] for r in top)


def _bm25(docs, query, k1=1.2, b=0.75):
    import regex
    tok = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
    toks = {d: tok(t) for d, t in docs.items()}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for d, ts in toks.items():
        tf = Counter(ts)
        s = 0.0
        for term in set(tok(query)):
            if term in tf:
                df = sum(1 for x in toks.values() if term in x)
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                s += idf * tf[term] * (k1 + 1) / (tf[term] + k1 * (1 - b + b * len(ts) / avgdl))
        if s:
            out[d] = round(s, 6)
    return out


def test_bm25_matches_brute_force(spark):
    docs = {1: "The cat sat on the mat.", 2: "Dogs and cats; the best of friends", 3: "Économie et société",
            4: "cat cat cat dog", 5: "nothing here"}
    ddf = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = "the cat économie"
    got = search.keyword_top_k(ddf, spark.createDataFrame([(1, q)], "query_id long, query_text string"), 10)
    got = {r["doc_id"]: r["score"] for r in got.collect()}
    want = _bm25(docs, q)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_search_filter(spark):
    docs = spark.createDataFrame([("a", "Sales", "beginner", "blended", 5.0), ("b", "HR", "beginner", "blended", 50.0)],
                                 "course_id string, department string, skill_level string, format string, "
                                 "duration_hours double")
    assert [r[0] for r in docs.filter(search.search_filter(department="Sales", max_duration_hours=10)).collect()] \
        == ["a"]
    assert docs.filter(search.search_filter()).count() == 2


def _check_recommendations(inter, top_n=3):
    rec = recommend.fit_recommender(inter)
    w = features.interaction_weights(inter).toPandas()
    learners = {x: i for i, x in enumerate(sorted(w.learner_email.unique()))}
    courses = {x: i for i, x in enumerate(sorted(w.course_id.unique()))}
    a = np.zeros((len(learners), len(courses)))
    for r in w.itertuples():
        a[learners[r.learner_email], courses[r.course_id]] = r.weight
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    v = vt[: rec.k].T
    want = a @ v @ v.T                                 # U*S*V^T is sign-invariant (T10)
    recs = recommend.recommend_courses(rec, inter, top_n=top_n).toPandas()
    started = w.groupby("learner_email").course_id.apply(set).to_dict()
    for r in recs.itertuples():
        assert r.course_id not in started[r.learner_email]
        assert abs(want[learners[r.learner_email], courses[r.course_id]] - r.score) < 2e-4
    for learner, own in recs.sort_values("rank").groupby("learner_email"):
        row = want[learners[learner]]
        best = sorted((row[j] for c, j in courses.items() if c not in started[learner]), reverse=True)[:top_n]
        assert np.allclose(best, own.score, atol=2e-4) and list(own["rank"]) == list(range(1, len(best) + 1))
    return rec


def test_recommender_reconstruction(spark):
    _check_recommendations(features.interaction_matrix(Binding(spark, SF_SMALL).silver))


def test_recommender_reconstruction_of_a_large_catalogue(spark, monkeypatch):
    """Over 150 courses the solver iterates over the kept vectors; scoring in small blocks gives the same."""
    monkeypatch.setattr(recommend, "CELLS", 1000)
    rng = np.random.default_rng(0)
    rows = [(f"l{i}", f"c{j:03d}", int(rng.integers(2, 9)), int(rng.integers(0, 2)), 0.5) for i in range(240)
            for j in rng.choice(170, int(rng.integers(3, 12)), replace=False)]
    rec = _check_recommendations(spark.createDataFrame(rows, "learner_email string, course_id string, event_count long, completed long, avg_score double"))
    assert rec.k == 50 and rec.n_courses >= 150


def test_recommender_bounds_its_factors(spark, monkeypatch):
    monkeypatch.setattr(recommend, "MAX_FACTOR_BYTES", 100)
    with pytest.raises(ValueError, match="MAX_FACTOR_BYTES"):
        recommend.fit_recommender(features.interaction_matrix(Binding(spark, SF_SMALL).silver))


def test_dropout_model_small(spark):
    b = Binding(spark, SF_SMALL)
    f = features.training_features(b.silver)
    split = dropout.stratified_split(f).groupBy("completed").agg(F.avg(F.col("is_train").cast("double")).alias("p"))
    assert all(0.7 < r["p"] < 0.9 for r in split.collect())
    folds = dropout.assign_folds(f).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    m = dropout.train_dropout(f, params={"maxIter": 3, "minInstancesPerNode": 2})
    scored = dropout.score_dropout(m, f)
    assert scored.filter((F.col("dropout_risk") < 0) | (F.col("dropout_risk") > 1)).count() == 0
    assert scored.count() == f.count() and len(m.importances) == 8


def test_dropout_save_load(spark, tmp_path):
    b = Binding(spark, SF_SMALL)
    f = features.training_features(b.silver)
    m = dropout.train_dropout(f, params={"maxIter": 2, "minInstancesPerNode": 2})
    m.save(str(tmp_path / "model"))
    m2 = dropout.DropoutModel.load(str(tmp_path / "model"))
    a = [r["dropout_risk"] for r in dropout.score_dropout(m, f).orderBy("learner_email", "course_id").collect()]
    c = [r["dropout_risk"] for r in dropout.score_dropout(m2, f).orderBy("learner_email", "course_id").collect()]
    assert a == c and m2.median == m.median


def test_raw_file_inventory(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "xapi_events.json").write_text("[]")
    (tmp_path / "raw" / "courses.json").write_text("[]")
    inv = raw_file_inventory(spark, str(tmp_path), ["raw/xapi_events.json", "raw/courses.json", "raw/learners.json"])
    got = {r["path"]: r["present"] for r in inv.collect()}
    assert got == {"raw/xapi_events.json": True, "raw/courses.json": True, "raw/learners.json": False}


def test_run_named_query(spark):
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").createOrReplaceTempView("t_named")
    assert run_named_query(spark, "SELECT v FROM t_named WHERE k = ?", ["b"]).first()["v"] == 2
    assert run_named_query(spark, "SELECT v FROM t_named ORDER BY v", one=True).count() == 1


def test_extract_tool_sources(spark):
    ok = {"output": [{"type": "mcp_call", "server_label": "", "content": "plain text"},
                     {"type": "tool_result", "server_label": "course-catalog-kb",
                      "content": [{"type": "text", "text": "block one"}, {"type": "text", "text": "two"},
                                  {"type": "image"}]},
                     {"type": "function_call_output", "content": "fn out"},
                     {"type": "mcp_call", "server_label": "other", "content": "skip me"},
                     {"type": "mcp_call", "content": ""},
                     {"type": "message", "content": "not a tool"}]}
    logs = spark.createDataFrame([(1, json.dumps(ok)), (2, "{not json")], "log_id long, response string")
    got = sorted(r["text"] for r in extract_tool_sources(logs, "course-catalog-kb").collect())
    assert got == ["block one", "fn out", "plain text", "two"]


def test_embed_catalogue(spark):
    df = spark.createDataFrame([("c1", "abc"), ("c2", "de")], "course_id string, embed_text string")
    out = embed_catalogue(df, lambda texts: [[float(len(t)), 1.0] for t in texts], batch=1)
    assert {r["course_id"]: r["content_vector"] for r in out.collect()} == {"c1": [3.0, 1.0], "c2": [2.0, 1.0]}


def test_score_records_and_scaler(spark):
    b = Binding(spark, SF_SMALL)
    f = features.training_features(b.silver)
    m = dropout.train_dropout(f, params={"maxIter": 2, "minInstancesPerNode": 2}, scale=True)
    out = dropout.score_records(m, spark, [{"total_events": 9, "modules_touched": 3, "avg_score": None,
                                            "active_days": 4, "span_days": 10}]).first()
    assert 0.0 <= out["dropout_risk"] <= 1.0 and out["avg_score"] is None
