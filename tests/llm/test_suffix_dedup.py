import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coursemetrics.llm import queries
from coursemetrics.llm import suffix_dedup as sd


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[s:s + length] for _, d in data for s in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, length).collect()), key=str)


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    passage, line = word(60), word(18)
    rows = [(i, f"{word(int(rng.integers(5, 60)))} {passage} {word(20)}") for i in range(12)]
    rows += [(100 + i, f"{word(10)} {line} {word(10)}") for i in range(20)]
    base = word(300)
    for i in range(25):  # near copies with changes at random places
        words = base.split()
        for _ in range(i % 6):
            words[int(rng.integers(len(words)))] = "é"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, "same " * 100), (301, "same " * 30 + "x"), (302, "ab" * 400), (303, "a" * 500), (304, word(80) * 2)]
    rows += [(400, None), (401, ""), (402, "short"), (403, word(50)), (None, passage), (404, passage), (404, passage), (405, line)]
    rows += [(500, "x" * 63 + "y" * 64), (501, "y" * 64 + "z" * 10), (502, "\x00" * 40 + "end"), (503, "\x00" * 90)]
    return rows


@pytest.mark.parametrize("length", [64, 100, 200])
def test_equals_brute_force(docs_of, length):
    rows = rows_of(length)
    assert run(docs_of(rows), length) == brute(rows, length)


def test_hot_anchors_have_an_exact_way(docs_of, monkeypatch):
    rows = rows_of(5)
    for bound in (0, 6):
        monkeypatch.setattr(sd, "HOT_PLACES", bound)
        assert run(docs_of(rows), 100) == brute(rows, 100)


def test_many_runs_and_parts(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "RUN_ROWS", 50)
    monkeypatch.setattr(sd, "PART_ROWS", 40)
    rows = rows_of(6)
    assert run(docs_of(rows, 7), 100) == brute(rows, 100)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 200)


def test_kept_bytes_and_empty_table(docs_of):
    rows = rows_of(7)
    for r in sd.remove_repeats(docs_of(rows), 100).collect():
        if r.kept is not None:
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    assert sd.remove_repeats(docs_of([]), 100).count() == 0


def test_blocks_give_the_same_anchors(monkeypatch):
    data = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = sd.anchors(data, 100)
    monkeypatch.setattr(sd, "BLOCK", 700)
    sd._powers.cache_clear()
    places, hashes = sd.anchors(data, 100)
    sd._powers.cache_clear()
    assert set(whole[0]) == set(places) and (hashes[np.searchsorted(places, whole[0])] == whole[1]).all()
    starts = np.searchsorted(whole[0], np.arange(len(data) - 99))
    assert (whole[0][starts] <= np.arange(len(data) - 99) + 100 - sd.KGRAM).all()  # every window has one


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda x: bytes(b % 3 for b in x)), max_size=12), max_size=9))
def test_loser_tree_merges_with_prefixes(lists):
    runs = [sorted((x, x[::-1], 1, 2) for x in rows) for rows in lists]
    got, last = [], b""
    for r, k in sd.merge([sd.Run(sd.front_code(x)) for x in runs]):
        assert k == sd.common(last, r.suffix) and r.before[r.row] == r.suffix[::-1] and (r.low[r.row], r.high[r.row]) == (1, 2)
        got.append(last := r.suffix)
    assert got == sorted(x for rows in lists for x in rows)
