"""Searches for many requests: what a request costs that shares no words with the documents, and rows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemetrics.operators import search


def test_words_that_no_document_has_make_no_request_of_its_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 3)}", i % 2) for i in range(60)], "doc_id long, text string, side int")
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.when(F.col("id") % 3 > 0, "Beta word").otherwise("word"), "id").alias("query_text"),
                                    (F.col("id") % 2).cast("int").alias("r_side"))
    packed, inner = [], search._packed
    monkeypatch.setattr(search, "_packed", lambda block, fields: (packed.append(block.count()), inner(block, fields))[1])
    found = search.keyword_top_k(docs, asked, 4, filters=[("side", "r_side", "eq")]).collect()
    assert packed == [4]  # beta or nothing, on either side
    assert {r.query_id for r in found} == {i for i in range(300) if i % 3} and len(found) == 4 * 200
    assert all(r.doc_id % 2 == r.query_id % 2 for r in found)


def bm25(docs, asked, k):
    toks = [t.split() for t in docs]
    n, average = len(toks), sum(map(len, toks)) / len(toks)
    words = sorted({w for t in toks for w in t})
    tf = np.array([[t.count(w) for w in words] for t in toks], float)
    df = (tf > 0).sum(0)
    norm = tf + 1.2 * (0.25 + 0.75 * np.array([len(t) for t in toks]) / average)[:, None]
    weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / norm
    for q, text in enumerate(asked):
        score = np.round(weight[:, [i for i, w in enumerate(words) if w in set(text.split())]].sum(1), 6)
        yield q, [(int(d), score[d]) for d in np.lexsort((np.arange(n), -score))[:k] if score[d] > 0]


@pytest.mark.parametrize("cells,many,waiting", [(1 << 19, 1 << 30, 1 << 18), (500, 0, 10)])
def test_common_and_rare_words_equal_brute_force(spark, monkeypatch, cells, many, waiting):
    for name, value in (("CELLS", cells), ("MANY_REQUEST_BYTES", many), ("WAITING_WORDS", waiting)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    often = 1 / np.arange(1, 401) ** 0.9
    draw = lambda size: " ".join(rng.choice(words, size, p=often / often.sum()))
    docs, asked = [draw(int(rng.integers(5, 40))) for _ in range(1500)], [draw(int(rng.integers(1, 8))) + f" unseen{i}" for i in range(120)]
    scored = []
    inner = search._score_pairs
    monkeypatch.setattr(search, "_score_pairs", lambda *a: (scored.append(1), inner(*a))[1])
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    r = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    got = {}
    for x in search.keyword_top_k(d, r, 6).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.doc_id, x.score))
    for q, best in bm25(docs, asked, 6):
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in best], abs=2e-6)


def test_best_of_batches_looks_at_few_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    top, k, looked = search._TopK(10, 40, search.ONE), 10, []
    inner = search._TopK.take
    monkeypatch.setattr(search._TopK, "take", lambda self, r, s, d: (looked.append(len(r)), inner(self, r, s, d))[1])
    values = np.round(rng.uniform(-1, 1, (40, 30_000)), 5)
    values[:, :15_000][values[:, :15_000] > 0.9] = 0.9     # many equal scores
    values[3], values[4, ::2] = np.nan, -np.inf
    ids = rng.permutation(30_000)
    for a in range(0, 30_000, 3_000):
        order = np.argsort(ids[a:a + 3_000])
        begin = top.number(ids[a:a + 3_000][order])
        top.offer(values[:, a:a + 3_000][:, order], np.arange(40), begin + np.arange(3_000))
    for q in range(40):
        fits = np.flatnonzero(np.isfinite(values[q]))
        best = fits[np.lexsort((ids[fits], -values[q][fits]))[:k]]
        assert top.ids[top.documents[q]][top.scores[q] >= 0].tolist() == ids[best].tolist()
    assert sum(looked) < 40 * 30_000 / 20


@pytest.mark.parametrize("find", [search.vector_top_k, search.hybrid_search])
def test_documents_in_many_partitions_are_dealt_over_few(spark, monkeypatch, find):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(f"d{i:03}", f"w{i % 7} x{i % 5}", rng.integers(-3, 4, 4).astype(float).tolist() if i % 3 else None) for i in range(400)],
                                 "doc_id string, text string, vector array<double>").repartition(12)
    asked = spark.createDataFrame([(i, f"w{i % 9} none{i}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(20)],
                                  "query_id long, query_text string, query_vector array<double>")
    whole = sorted(map(tuple, find(docs, asked, 4).collect()))
    dealt, inner = [], search._beside
    monkeypatch.setattr(search, "_beside", lambda d, packed: (dealt.append(d.rdd.getNumPartitions()), inner(d, packed))[1])
    for limit in (1 << 26, 1200):
        monkeypatch.setattr(search, "MANY_REQUEST_BYTES", 500)
        monkeypatch.setattr(search, "MAX_REQUEST_BYTES", limit)
        assert sorted(map(tuple, find(docs, asked, 4).collect())) == whole
    most = 2 * spark.sparkContext.defaultParallelism
    assert dealt and (find is not search.vector_top_k or max(dealt) <= most)
