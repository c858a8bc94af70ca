"""Search against brute force: ties, filters, request blocks, empty sides, nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemetrics.operators import search

DOCS = "doc_id {}, text string, vector array<double>, kind string, hours double"
REQS = "query_id long, query_text string, query_vector array<double>, kind string, hours double"
FILTERS = [("kind", "r_kind", "eq"), ("hours", "r_hours", "le")]


def tables(spark, seed, text_ids=False):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "red", "blue", "cat", "dog", "é"]
    kinds = ["a", "b", None]
    docs = [(f"d{i:03d}" if text_ids else i, None if i % 17 == 0 else " ".join(rng.choice(words, int(rng.integers(0, 9)))),
             None if i % 13 == 0 else rng.integers(-2, 3, 3).astype(float).tolist(), kinds[i % 3], None if i % 11 == 0 else float(i % 7)) for i in range(120)]
    reqs = [(i, None if i == 3 else " ".join(rng.choice(words, 3)), None if i == 4 else rng.integers(-2, 3, 3).astype(float).tolist(),
             kinds[i % 3], None if i % 2 else float(i % 6)) for i in range(25)]
    d = spark.createDataFrame(docs, DOCS.format("string" if text_ids else "long")).repartition(5)
    return docs, reqs, d, spark.createDataFrame(reqs, REQS).withColumnsRenamed({"kind": "r_kind", "hours": "r_hours"})


def allowed(d, r):
    return (r[3] is None or d[3] == r[3]) and (r[4] is None or d[4] is not None and d[4] <= r[4])


def best(scored, k):
    return [(i, s, n + 1) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])]


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("blocks", [1, 4])
def test_vector_equals_brute_force(spark, blocks, text_ids):
    docs, reqs, d, r = tables(spark, 1, text_ids)
    got = search.vector_top_k(d, r, 7, filters=FILTERS, request_blocks=blocks).collect()
    for q in reqs:
        scored = []
        for x in docs:
            if q[2] is not None and x[2] is not None and allowed(x, q) and np.any(x[2]) and np.any(q[2]):
                a, b = np.array(x[2]), np.array(q[2])
                scored.append((round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0, x[0]))
        assert sorted((g.rank, g.doc_id, g.similarity + 0.0) for g in got if g.query_id == q[0]) == [(n, i, s) for i, s, n in best(scored, 7)]


@pytest.mark.parametrize("cells", [1 << 21, 60])
def test_keyword_equals_brute_force(spark, cells, monkeypatch):
    monkeypatch.setattr(search, "CELLS", cells)
    docs, reqs, d, r = tables(spark, 2)
    got = search.keyword_top_k(d, r, 6, filters=FILTERS, request_blocks=2).collect()
    toks = {x[0]: (x[1] or "").split() for x in docs}
    n, average = len(docs), sum(map(len, toks.values())) / sum(x[1] is not None for x in docs)
    df = {t: sum(t in ts for ts in toks.values()) for ts in toks.values() for t in ts}
    for q in reqs:
        scored = []
        for x in docs:
            ts = toks[x[0]]
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / average))
                    for t in set((q[1] or "").split()) if t in ts)
            if s and allowed(x, q):
                scored.append((s, x[0]))
        mine = sorted((g.rank, g.score) for g in got if g.query_id == q[0])
        assert [s for _, s in mine] == pytest.approx(sorted((s for s, _ in scored), reverse=True)[:6], abs=1e-6)


def test_empty_sides(spark):
    _, _, d, r = tables(spark, 3)
    for docs, reqs in ((d.where("false"), r), (d, r.where("false"))):
        assert search.vector_top_k(docs, reqs, 3).count() == 0 and search.keyword_top_k(docs, reqs, 3).count() == 0
        assert search.hybrid_search(docs, reqs, 3).count() == 0


@pytest.mark.parametrize("limit", [100, 600])
def test_any_number_of_requests_is_answered_in_blocks(spark, monkeypatch, limit):
    _, _, d, r = tables(spark, 4)
    key = lambda df: sorted(map(tuple, df.collect()))
    searches = [lambda: search.vector_top_k(d, r, 5, filters=FILTERS), lambda: search.keyword_top_k(d, r, 5, filters=FILTERS),
                lambda: search.hybrid_search(d, r, 3)]
    whole = [key(s()) for s in searches]
    monkeypatch.setattr(search, "MAX_REQUEST_BYTES", limit)
    size = F.octet_length("query_text") + 32
    assert len(search._blocks(r, "query_id", None, size)) > 1
    assert [key(s()) for s in searches] == whole


def test_requests_beyond_one_broadcast(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} of w{i % 11}") for i in range(80)], "doc_id long, text string")
    asked = spark.range(50_000).select(F.col("id").alias("query_id"), F.concat(F.lit("w7 of w9 "), F.repeat(F.lit("unseen "), 200)).alias("query_text"))
    assert 50_000 * 1400 > search.MAX_REQUEST_BYTES
    assert search.keyword_top_k(docs, asked, 2).count() == 100_000


def test_hybrid_by_skills_without_vectors_is_the_keyword_order(spark):
    docs = spark.createDataFrame([("c1", "python python", "HR"), ("c2", "python and more words", "HR"), ("c3", "python", "IT")],
                                 "course_id string, embed_text string, department string").withColumn("content_vector", F.lit(None).cast("array<double>"))
    reqs = spark.createDataFrame([(1, "python", "HR"), (2, "python", None)], "query_id int, query_text string, department string") \
        .withColumn("query_vector", F.lit(None).cast("array<double>"))
    got = {(r.query_id, r.rank): r.doc_id for r in search.search_by_skills(docs, reqs, 5).collect()}
    assert got[1, 1] == "c1" and got[1, 2] == "c2" and (1, 3) not in got and {got[2, i] for i in (1, 2, 3)} == {"c1", "c2", "c3"}


def test_equal_requests_are_scored_once(spark, monkeypatch):
    """Requests that ask the same get the same rows, each under its own id, from one packed request."""
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)}gamma{i % 5}", i % 2) for i in range(60)], "doc_id long, text string, side int")
    rows = [(i, "beta alpha" if i % 2 else "Alpha  beta", i % 4 // 2 or None) for i in range(40)] + [(40, None, None), (41, "gamma3", None)]
    asked = spark.createDataFrame(rows, "query_id long, query_text string, r_side int")
    packed = []
    inner = search._packed
    monkeypatch.setattr(search, "_packed", lambda block, fields: (packed.append(block.count()), inner(block, fields))[1])
    found = search.keyword_top_k(docs, asked, 4, filters=[("side", "r_side", "eq")]).collect()
    assert packed == [4]
    per = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        per.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(per) == {*range(40), 41} and all(len(v) == 4 for v in per.values())
    assert all(per[i] == per[i % 4 // 2 * 2] for i in range(40)) and all(d % 2 == 1 for d, _ in per[2])
