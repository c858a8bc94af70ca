import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coursemetrics.llm import packing, token_counts, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "   ", "a  b\tc \n d", " lead and trail ", "x<|endoftext|> y <|endoftext|>", "don't  we'll", "日本 語　テキスト a b c᠎ d",
       "a\x1c b \x85 c", "word " * 3000, "w" * 5000, "é ù ́ é f", None]


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark, docs_of, tool):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id here"), (3, ODD[3]), (3, ODD[3])]
    got = sorted(map(tuple, token_counts.token_counts(docs_of(rows), PATH).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert got == want
    assert token_counts.token_counts(docs_of([]), PATH).count() == 0


def test_counts_on_given_documents(spark, tool):
    from coursemetrics.llm.queries import op10_token_counts
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op10_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for d, e in zip(docs, tool.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        assert got[d.doc_id] == (len((d.text or "").encode()), len(e.ids), len(e.ids) > 1024)


LETTERS = st.text(st.sampled_from("ab AB'\n\t 12é ñ.,!|$\x00\x1c\x85\xa0\xad\u0301\u0416\u180e\u200b\u2003中🙂'sst"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS, max_size=8))
def test_any_text_equals_the_library(texts):
    lib = tokens.load(PATH)[0]
    got = list(tokens.Encoder(PATH, True).stream(texts, 100))
    assert got == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tokens.Encoder(PATH, False).stream(texts)) == [len(x) // 4 for x in got]


@settings(max_examples=200, deadline=None)
@given(LETTERS, st.integers(1, 20))
def test_blocks_cut_at_safe_boundaries(text, limit):
    lib, cut = tokens.load(PATH)[0], list(tokens.blocks(text, limit))
    assert "".join(cut) == text
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    assert sum(map(ids, cut), []) == ids(text)


def test_all_given_documents_equal_the_library(tool):
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:4000]
    want = [len(e.ids) for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert list(tokens.Encoder(PATH, False).stream(texts)) == want


def test_sentencepiece_counts(docs_of):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of([(1, "a b  c"), (2, None)]), path).collect()}
    assert got == {1: len(tool.encode("a b  c")), 2: 0}


def check_packing(got, docs, tool, limit):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*tool.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert sum(r.length for r in parts) == len(ids) and (len(parts) == 1 or all(r.length == limit for r in parts[1:]))
        for r in parts:
            assert r.start == sum(x.length for x in parts[:r.piece])
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_seq)


def test_packing_is_whole(spark, docs_of, tool):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "one two three " * (i % 7)) for i in range(200)]
    got = packing.pack(docs_of(docs), PATH, 64).collect()
    used = check_packing(got, docs, tool, 64)
    assert used <= 1.05 * -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(docs_of([]), PATH, 64).count() == 0


def test_packing_of_given_documents(spark, tool):
    from coursemetrics.llm.queries import op5_best_fit_packing
    got = op5_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check_packing(got, docs, tool, 1024)


def test_repeated_rows_and_null_ids_are_packed(docs_of):
    got = packing.pack(docs_of([(None, "a b"), (None, "a b"), (7, "c"), (7, "c")]), PATH, 8).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4


def brute_best_fit(lengths, limit):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(limit - x)
        else:
            rooms.remove(fit)
            rooms.append(fit - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_over_single_pieces(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(5, 60))
    lengths = rng.integers(1, limit + 1, int(rng.integers(1, 500))).tolist()
    histogram = {x: lengths.count(x) for x in set(lengths)}
    made = packing.plan(histogram, limit)
    assert len({s for l, a, b, first, each, base in made for s in range(first, first - (-(b - a) // each))}) == brute_best_fit(lengths, limit)
    for x, n in histogram.items():
        ranges = sorted((a, b) for l, a, b, *_ in made if l == x)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(p[1] == q[0] for p, q in zip(ranges, ranges[1:]))
