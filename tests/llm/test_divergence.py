import random
import re
from collections import Counter

from coursemetrics.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, term string, value long"


def made(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, g, s, "x", 1) for i, (t, g, s) in enumerate(rows)], DOCS).repartition(parts)


def brute(rows, min_docs=3, top=200):
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        counts.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}
        p, q = shares(counts[lang, source]), shares(whole)
        parts = {"pair": [], "term": [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, source][t] and p[t] > q[t]]}
        for g in groups:
            if g[0] == lang and g[1] != source:
                other = shares(counts[g])
                parts["pair"].append((sum((p[t] - other[t]) ** 2 // other[t] for t in kept), g[1]))
        for part, rows_ in parts.items():
            ranked = sorted(rows_, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def some_rows(n=300, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "naïve", "x1y", "中文", "a-b", "straße", "ZZ"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(9)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 60]))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", "é", None, "Z"]))
            for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "fr", "one"), ("1 2 3", "fr", "two"), ("the\x00the of  x", "en", "b")]


def test_equals_brute_force(spark):
    rows = some_rows()
    assert sorted(map(tuple, divergence.audit(made(spark, rows)).collect())) == brute(rows)
    assert sorted(map(tuple, divergence.audit(made(spark, rows), min_docs=1, top=5).collect())) == brute(rows, 1, 5)


def test_small_blocks_and_flushes_change_nothing(spark, monkeypatch):
    rows = some_rows(120, 9)
    want = brute(rows)
    monkeypatch.setattr(divergence, "ENTRIES", 10)
    monkeypatch.setattr(divergence, "PAIR_ROWS", 3)
    assert sorted(map(tuple, divergence.audit(made(spark, rows, 2)).collect())) == want


def test_odd_tables(spark):
    assert divergence.audit(made(spark, [])).count() == 0
    none_kept = [("a b", "en", "x"), ("c", "en", "y")]
    assert sorted(map(tuple, divergence.audit(made(spark, none_kept)).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    long = [("word " * 300_000 + "tail" * 200_000, "en", "x"), ("word tail", "en", "y"), ("word", "en", "y"), ("word", "en", "x")]
    assert sorted(map(tuple, divergence.audit(made(spark, long)).collect())) == brute(long)


def test_many_sources(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(["of", "the", "wa", "wb", "wc"], k=4)), "en", f"s{i % 60}") for i in range(400)]
    assert sorted(map(tuple, divergence.audit(made(spark, rows)).collect())) == brute(rows)
