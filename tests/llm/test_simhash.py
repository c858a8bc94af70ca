import numpy as np
import pytest
import re
import xxhash
from types import SimpleNamespace

from coursemetrics.llm import simhash
from coursemetrics.llm.common import connected_components, shared_dir


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, f"{p:016x}", low.get(find(k))) for k, (i, p) in enumerate(prints)), key=str)


def hexed(df):
    return sorted(((r[0], f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=str)


def test_components_equal_brute_force(docs_of):
    rng = np.random.default_rng(0)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(10)]
    rows = [(k, b) for k, b in enumerate(base)]
    for k in range(150):
        words = base[k % 10].split()
        for _ in range(k % 4):
            words[int(rng.integers(len(words)))] = "changed"
        rows.append((1000 - k, " ".join(words).upper() if k % 5 else " ".join(words)))
    rows += [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "one"), (2004, "One two"), (None, base[0]), (5, base[5]), (5, base[5]),
             (None, "nobody else has this text at all"), (2005, "É é a b c\x85d")]
    assert hexed(simhash.simhash_components(docs_of(rows))) == brute_components(rows)


def test_given_documents_equal_brute_force(spark):
    from coursemetrics.llm.queries import op3_simhash
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_simhash(spark, sf).collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("near", [0, 200, 1500])
def test_index_links_equal_brute_force(near):
    rng = np.random.default_rng(near)
    fp = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    fp[near % 600:] = fp[0]
    if near:  # a dense cloud around one pattern
        cloud = np.full(near, fp[1])
        for _ in range(4):
            cloud ^= np.uint64(1) << rng.integers(0, 64, near).astype(np.uint64)
        fp = np.unique(np.concatenate([fp, cloud]))
    else:
        fp = np.unique(fp)
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fp = fp[np.argsort(rank)]
    got = simhash.merge(fp, np.zeros(len(fp), np.int64), 2)
    want = np.arange(len(fp))
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    while True:
        new = np.where(close, want[None, :], len(fp)).min(1)
        if (new == want).all():
            break
        want = new
    assert (got == want).all()


def test_keep_one(docs_of):
    rows = [(3, "a b c d"), (1, "a b c d"), (2, "A B c d"), (9, "x y z"), (9, "x y z"), (None, "alone here now"), (None, "alone here now"),
            (None, "a b c d"), (4, None), (5, "")]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, "a b c d"), (9, "x y z"), (None, "alone here now"), (4, None)], key=str)
    assert simhash.keep_one(docs_of([])).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}


def test_a_group_larger_than_a_batch(spark, monkeypatch):
    """One block's group comes in many batches; its links join exactly what brute force joins."""
    rng = np.random.default_rng(5)
    prints = sorted({int(x) << 22 for x in rng.integers(0, 1 << 11, 400)})
    near = {i: {j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 2} for i in range(len(prints))}
    monkeypatch.setattr(simhash, "ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        edges = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def joined(links):
        root = list(range(len(prints)))
        def top(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(len(prints))]
    place = {x: i for i, x in enumerate(prints)}
    assert joined((place[e.u], place[e.v]) for e in edges) == joined((i, j) for i, js in near.items() for j in js)


def test_a_cluster_without_a_shared_folder_is_told():
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
