import math
import random
import re
from collections import Counter

from coursemetrics.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, bag string, n long, m long, score long"
WORDS = ["the", "The", "of", "é", "É", "x1y", "中文", "7", "straße", "ZZ"] + [f"w{i}" for i in range(60)]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted = terms(text)
        rows = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in wanted if b[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def some(seed=1, n=250):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.choice([0, 1, 4, 4, 30])))) for i in range(n)]
    docs += [(1000 + i, "w3 w4 of the") for i in range(60)] + [(None, "w3 w4"), (7, "w3 w4"), (7, "w3 w4"), (500, None), (501, ""), (502, "?!")]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 12])))) for i in range(12)] + [(20, "w3 W3 of"), (21, ""), (22, None), (23, "unseen")]
    return docs, items


def run(spark, docs, items, parts=4, **more):
    frame = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs], DOCS).repartition(parts)
    return ranked_search.rank(spark, frame, spark.createDataFrame(items, "item_id long, text string"), **more)


def test_equals_brute_force(spark):
    docs, items = some()
    found = run(spark, docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)
    assert sorted(map(tuple, run(spark, docs, items, top=3).collect()), key=str) == brute(docs, items, 3)


def test_blocks_of_items_and_small_matrices_change_nothing(spark, monkeypatch):
    docs, items = some(6, 150)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 40)
    monkeypatch.setattr(ranked_search, "CELLS", 30)
    assert sorted(map(tuple, run(spark, docs, items, 2).collect()), key=str) == brute(docs, items)


def test_a_class_is_scored_once(spark):
    docs = [(i, "alpha beta gamma") for i in range(300)] + [(1000 + i, "alpha beta delta epsilon") for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = ranked_search.bags(frame, {b"alpha": 0, b"beta": 1}, "doc_id", "text")
    rows = ranked_search.classes(found, 350, 1100, 20).collect()
    assert sorted(r.members[:3] for r in rows) == [[0, 1, 2], [1000, 1001, 1002]] and {len(r.members) for r in rows} == {20}


def test_odd_tables(spark):
    docs, items = some(2, 20)
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0
    assert run(spark, [(1, None), (2, "?")], items).count() == 0
    twice = [(3, "w1 w2"), (3, "w1 w2")]
    assert sorted(map(tuple, run(spark, docs, twice).collect()), key=str) == brute(docs, twice)
    long = [(1, "w1 " * 500_000 + "w2"), (2, "w1 w2"), (3, "z" * 3_000_000)]
    assert sorted(map(tuple, run(spark, long, [(1, "w1 w2")]).collect()), key=str) == brute(long, [(1, "w1 w2")])


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "w1 w2"), ("a", "w1 w2"), (None, "w1 w2")], "name string, body string")
    items = spark.createDataFrame([("q", "w1")], "key string, text string")
    got = ranked_search.rank(spark, docs.union(docs.limit(0)).unionByName(spark.createDataFrame([("c", "other")], "name string, body string")),
                             items, id_col="name", text_col="body", item_col="key").collect()
    assert [(r.key, r["rank"], r.name) for r in got] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
