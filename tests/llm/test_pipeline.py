from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from coursemetrics.llm import decontaminate, queries, toxicity
from tests.llm.test_pii import PRIVATE, luhn
from tests.llm.test_simhash import brute_components
from tests.llm.test_tokens_packing import check_packing

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and result rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        out[name] = (before.collect(), docs.collect(), docs.columns)
    return out


def test_stages_are_in_order_and_keep_the_columns(steps):
    assert list(steps) == ["toxicity", "simhash_near_dedup", "decontamination", "pii_surrogates", "best_fit_packing"]
    assert all(columns == COLUMNS for name, (_, _, columns) in steps.items() if name != "best_fit_packing")


def test_toxic_documents_go(spark, steps):
    before, after, _ = steps["toxicity"]
    lexicon = queries.civil_lexicon(spark, SF, spark.read.parquet(f"{SF}/documents.parquet"))
    machine = lexicon.machine()
    want = [r for r in before if toxicity.probability(toxicity.strength(toxicity.fold(r.text), machine), lexicon.curve) < 0.3]
    assert sorted(after) == sorted(want) and 0 < len(want) < len(before)


def test_one_of_each_group_stays(steps):
    before, after, _ = steps["simhash_near_dedup"]
    kept = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])}
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept) and len(kept) < len(before)


def test_documents_with_items_go(spark, steps):
    before, after, _ = steps["decontamination"]
    items = [b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [r for r in before if not any(i in b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for i in items)]
    assert sorted(after) == sorted(want) and len(want) < len(before)


def test_private_data_is_replaced(steps):
    before, after, _ = steps["pii_surrogates"]
    new = {r.doc_id: r for r in after}
    forward = defaultdict(set)
    assert new.keys() == {r.doc_id for r in before}
    for r in before:
        found, made = PRIVATE.findall(r.text), PRIVATE.findall(new[r.doc_id].text)
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text) and len(found) == len(made)
        for a, b in zip(found, made):
            if not a.isdigit() or luhn(a):
                forward[a].add(b)
    assert forward and all(len(x) == 1 for x in forward.values())
    assert not any(a in r.text for a in forward for r in after)


def test_everything_left_is_packed(steps):
    before, after, _ = steps["best_fit_packing"]
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(after, [(r.doc_id, r.text) for r in before], tool, 1024)


def test_run_is_the_stages_one_after_the_other(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, steps["best_fit_packing"][1]))


def test_empty_and_odd_tables(spark, docs_of):
    for rows in ([], [(1, None), (None, ""), (2, "a b c"), (2, "a b c"), (3, "x" * 100_000)]):
        docs = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert {r.doc_id for r in docs.collect()} == ({1, 2, 3} if rows else set())
