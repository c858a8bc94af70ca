import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from coursemetrics.llm import mixture
from coursemetrics.llm.queries import op11_mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, size long, target double, taken string"


def made(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, None, s, -1, -1.0, "x") for i, t, s in rows], DOCS).repartition(parts)


def brute_targets(sizes):
    """By exact fractions: sources of (weight, size), 150 % of all words, at most twice a source's."""
    left, open_, out = Fraction(3 * sum(s for _, s in sizes.values()), 2), dict(sizes), {}
    while open_:
        each = left / sum(w for w, _ in open_.values())
        above = {k: 2 * s for k, (w, s) in open_.items() if w * each > 2 * s}
        if not above:
            return out | {k: w * each for k, (w, _) in open_.items()}
        out |= above
        left -= sum(above.values())
        open_ = {k: v for k, v in open_.items() if k not in above}
    return out


def brute(rows, seed=42):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {n: sum(k for k, r in zip(size, rows) if r[2] == n) for n in names}
    goal = brute_targets({n: ((5, 2, 1)[i % 3], total[n]) for i, n in enumerate(names)})
    out = []
    for n in names:
        whole = int(goal[n] // total[n]) if total[n] else 0
        chance = float(goal[n]) / total[n] - whole if total[n] else 0
        left = int(goal[n] + Fraction(1, 2)) - whole * total[n]
        order = []
        for k, (i, _, s) in zip(size, rows):
            if s == n:
                u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append(((u / (1 - u)) / (chance / (1 - chance)) if chance and k else 0, i, k))
        for _, i, k in sorted(order):
            extra = min(k, left) if chance else 0
            left -= extra
            out.append((i, k, total[n], whole * k + extra))
    return sorted(out), goal


def some_rows(n=400, seed=3):
    rng = random.Random(seed)
    names = ["a", "B", "é", "zz", "", None, "中", "b"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 50, 400])), rng.choice(names[:1] * 6 + names)) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "\t\n ", "only empty"), (n + 2, "x " * 30_000, "b")]


def test_equals_brute_force(spark):
    rows = some_rows()
    found = mixture.mix(made(spark, rows)).collect()
    want, goal = brute(rows)
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in found) == want
    source = {i: s for i, _, s in rows}
    for r in found:
        assert r.target == pytest.approx(float(goal[source[r.doc_id]]), rel=1e-12)
        assert 0 <= r.taken <= 2 * r["size"] and r.copies == (r.taken // r["size"] if r["size"] else 0)


def test_sources_meet_their_targets_and_reruns_agree(spark):
    def run(parts):
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
        return sorted(map(tuple, mixture.mix(docs).collect()))
    first = run(3)
    assert first == run(7)
    docs = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sums, goal = {}, {}
    for i, _, _, target, taken, _ in first:
        sums[docs[i]] = sums.get(docs[i], 0) + taken
        goal[docs[i]] = target
    assert all(abs(sums[s] - goal[s]) <= 0.5 for s in goal)
    assert [tuple(r) for r in op11_mixture(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()] == first


def test_inclusion_follows_the_probabilities(spark):
    """With unequal chances in one group, a document is drawn about as often as its chance says."""
    n, runs = 40, 300
    chance = {i: 0.1 + 0.8 * (i % 5) / 4 for i in range(n)}
    rows = [(run, round(sum(chance.values())), i, 1, chance[i]) for run in range(runs) for i in range(n)]
    drawn = spark.createDataFrame(rows, "place long, left long, doc_id long, size long, chance double")
    u = mixture.draw(F.concat_ws("/", "place", "doc_id"), 7)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    found = mixture.sample_words(drawn.withColumn("rank", odds))
    per_run = {r[0]: r[1] for r in found.groupBy("place").agg(F.sum("extra")).collect()}
    assert set(per_run.values()) == {round(sum(chance.values()))}
    share = {r[0]: r[1] / runs for r in found.groupBy("doc_id").agg(F.sum("extra")).collect()}
    for level in set(chance.values()):
        mine = [share[i] for i in share if chance[i] == level]
        assert sum(mine) / len(mine) == pytest.approx(level, abs=0.035)


def test_ranges_never_fall(spark):
    ranks = sorted([1e-12, 0.3, 0.5, 1 - 2**-53, 1.0, 1 + 2**-52, 1.5, 2.0, 1e9, 1e300] + [random.Random(1).expovariate(1) for _ in range(500)])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ranks], "x double").coalesce(1).select(mixture.range_of(F.col("x"))).collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] < 1 << 24


def test_odd_tables(spark):
    assert mixture.mix(made(spark, [])).count() == 0
    same = [(5, "a b c", "s")] * 4 + [(None, "a b", "s"), (None, "a b", "s"), (6, "", None)]
    found = mixture.mix(made(spark, same)).collect()
    assert len(found) == 7 and sum(r.taken for r in found) == 24 and all(r.taken <= 2 * r["size"] for r in found)
    empty = mixture.mix(made(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 2


def test_many_sources_are_numbered_by_code_point(spark):
    names = sorted({f"{random.Random(i).choice(['', 'z', 'é', '中', 'A'])}{i}" for i in range(300)}, key=str.encode) + [None]
    got = mixture.numbered(spark.createDataFrame([(n,) for n in random.Random(2).sample(names, len(names))], "source string"), "source").collect()
    assert {r.source: r.place for r in got} == {n: i for i, n in enumerate(names)}


def test_texts_of_the_mix(spark):
    rows = some_rows(60)
    docs = made(spark, rows)
    mixed = mixture.mix(docs)
    words: dict = {}
    for r in mixture.texts(docs, mixed).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in mixed.collect() if r.taken}
