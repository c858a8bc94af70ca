"""Bucket tables, postings and factors against exact search and exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemetrics.functions.ids import dense_ids
from coursemetrics.operators import ann, factors, postings, search


def clustered(n=3000, dim=24, centres=40, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return c[rng.integers(0, centres, n)] + 0.25 * rng.standard_normal((n, dim))


def frame(spark, vectors, name="vector", ident="doc_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], f"{ident} long, {name} array<double>").repartition(6)


@pytest.mark.parametrize("part_rows", [20_000, 25])
def test_recall_on_clusters_reads_a_part_of_the_pairs(spark, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(ann, "PART_ROWS", part_rows)   # the small one splits buckets and requests into many groups
    x = clustered()
    docs = frame(spark, x)
    index = ann.build_index(docs, str(tmp_path), 10)
    asked = frame(spark, x[::15], "query_vector", "query_id")
    found = ann.approximate_top_k(index, asked).cache()
    told = ann.recall(found, search.vector_top_k(docs, asked, 10)).first()
    assert told.recall >= 0.9 and told.exact_scores and told.requests == 200
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    buckets = index.probes / (index.planes.shape[0] << index.planes.shape[2])
    assert buckets < 0.3 and unit.shape[1] == index.planes.shape[1]


def test_equal_vectors_odd_rows_and_ties(spark, tmp_path):
    x = list(clustered(300, 8, 5))
    x += [x[0]] * 500 + [None, [0.0] * 8, [1.0, 2.0], [float("nan")] * 8]
    docs = frame(spark, x)
    index = ann.build_index(docs, str(tmp_path), 12, target=1.0)
    asked = spark.createDataFrame([(0, [float(v) for v in x[0]]), (1, None), (2, [1.0]), (3, [0.0] * 8)], "query_id long, query_vector array<double>")
    found = ann.approximate_top_k(index, asked).collect()
    assert [(r.query_id, r["rank"], r.doc_id, r.similarity) for r in sorted(found, key=lambda r: r["rank"])] == [
        (0, i + 1, d, 1.0) for i, d in enumerate([0, *range(300, 311)])]
    assert index.buckets.where("tbl = 0").count() == 300
    with pytest.raises(ValueError):
        ann.approximate_top_k(index, asked, 13)


def test_an_empty_index(spark, tmp_path):
    index = ann.build_index(frame(spark, [None]), str(tmp_path), 3)
    assert ann.approximate_top_k(index, frame(spark, [[1.0]], "query_vector", "query_id")).count() == 0


def words(seed, n):
    rng = np.random.default_rng(seed)
    vocab = ["the", "of", "a"] + [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, len(vocab) + 1)
    return [" ".join(rng.choice(vocab, int(rng.integers(0, 40)), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("block", [128, 4])
def test_postings_equal_exact_search(spark, tmp_path, block):
    texts = words(1, 900) + [None, "", "the the the", "w5 w5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([*enumerate(words(2, 60)), (90, None), (91, ""), (92, "the"), (93, "unseen"), (94, "W5 é")], "query_id long, query_text string")
    index = postings.build_postings(docs, str(tmp_path), block_documents=block)
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "doc_id", "score").collect()))
    assert key(postings.postings_top_k(index, asked, 7)) == key(search.keyword_top_k(docs, asked, 7))
    assert postings.scored_pairs(index, asked, 7).first().pairs < 0.5 * len(texts) * 65


def test_postings_shuffle_documents_not_entries(spark, tmp_path):
    """Lists are made within their block: no row for each term of a document, and a search drops the lists of other terms as it reads."""
    docs = spark.createDataFrame(list(enumerate(words(5, 300))), "doc_id long, text string")
    index = postings.build_postings(docs, str(tmp_path))
    assert index.lists.agg(F.max(F.size("docs"))).first()[0] > 1 and not (tmp_path / "df").exists()
    asked = spark.createDataFrame([(1, "w3 of w9")], "query_id long, query_text string")
    plan = postings.postings_top_k(index, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_postings_take_any_number_of_requests(spark, tmp_path):
    """Requests of more bytes than one packed block may have."""
    docs = spark.createDataFrame(list(enumerate(words(3, 200))), "doc_id long, text string")
    asked = spark.range(60_000).select(F.col("id").alias("query_id"), F.concat(F.lit("w7 of w9 "), F.repeat(F.lit("unseen "), 200)).alias("query_text"))
    assert 60_000 * 1400 > search.MAX_REQUEST_BYTES
    found = postings.postings_top_k(postings.build_postings(docs, str(tmp_path)), asked, 2)
    assert found.count() == 120_000


def test_dense_ids(spark, tmp_path):
    names = [f"n{i}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names * 3] + [(None,)], "name string").repartition(7)
    got = {r.name: r.id for r in dense_ids(df, "name", str(tmp_path)).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def interactions(spark, learners=60, courses=40):
    """Learners of group g take courses of their group; one learner has started nearly all."""
    rows = [(f"l{i:03d}", f"c{c:03d}", 3 + (i * c) % 4, (i + c) % 2, 0.5) for i in range(learners) for c in range(courses) if c % 4 == i % 4 and (i * 7 + c) % 3]
    rows += [("busy", f"c{c:03d}", 4, 1, 0.9) for c in range(courses - 2)]
    return spark.createDataFrame(rows, "learner_email string, course_id string, event_count long, completed long, avg_score double"), rows


def test_factors_recommend_unstarted_courses_of_the_learners_kind(spark, tmp_path):
    df, rows = interactions(spark)
    fit = factors.fit_factors(df, str(tmp_path), rank=8, iterations=6)
    found = factors.recommend_by_factors(fit, 5).collect()
    started = {(r[0], r[1]) for r in rows}
    per = {}
    for r in found:
        assert (r.learner_email, r.course_id) not in started
        per.setdefault(r.learner_email, []).append(r)
    assert len(per["busy"]) == 2 and all(len(v) == 5 for k, v in per.items() if k != "busy") and len(per) == 61
    for v in per.values():
        order = sorted(v, key=lambda r: r["rank"])
        assert [(-r.score, r.course_id) for r in order] == sorted((-r.score, r.course_id) for r in order)
    alike = [int(r.course_id[1:]) % 4 == int(k[1:]) % 4 for k, v in per.items() if k != "busy" for r in v if r["rank"] == 1]
    assert sum(alike) / len(alike) > 0.9
    one = factors.recommend_by_factors(fit, 3, spark.createDataFrame([("l001",), ("nobody",)], "learner_email string")).collect()
    assert [(r.learner_email, r["rank"]) for r in sorted(one, key=lambda r: r["rank"])] == [("l001", 1), ("l001", 2), ("l001", 3)]


def test_factors_agree_with_their_own_products(spark, tmp_path):
    df, _ = interactions(spark)
    fit = factors.fit_factors(df, str(tmp_path), rank=5, iterations=3)
    u = {r.id: np.array(r.features, np.float32) for r in fit.model.userFactors.collect()}
    v = {r.id: np.array(r.features, np.float32) for r in fit.model.itemFactors.collect()}
    who, what = {r.learner_email: r.learner for r in fit.learners.collect()}, {r.course_id: r.course for r in fit.courses.collect()}
    for r in factors.recommend_by_factors(fit, 4).collect():
        assert r.score == pytest.approx(float(u[who[r.learner_email]] @ v[what[r.course_id]]), abs=2e-4)


def test_factors_need_interactions(spark, tmp_path):
    df, _ = interactions(spark)
    with pytest.raises(ValueError):
        factors.fit_factors(df.limit(0), str(tmp_path))
