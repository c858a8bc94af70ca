import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemetrics.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "123 --- 456"), (None, "and the of"), (5, "z" * 200_000), (6, "a b c\n" * 3), (6, "a b c\n" * 3)]


def test_folding():
    assert toxicity.fold("You IDIOT, stup1d lоs3r $cum!") == " you idiot stupid loser scum "
    assert toxicity.fold("token = \"04db1e990\" 2024 +1 (487) 555") == " token db e "
    assert toxicity.fold(None) == toxicity.fold("") == " "
    assert toxicity.fold("réeux ÉCOLE zero​width") == " réeux école zerowidth "


def test_hits_take_the_heaviest_entry_and_heed_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "scum": 1.0}, {"scum": 3.0}, ["pond scum", "idiotic box"])
    machine = lexicon.machine()
    found = lambda t: sorted(toxicity.hits(toxicity.fold(t), machine).values())
    assert found("an idiot and scum, scummy idiots") == [1.0, 2.0, 2.0, 3.0]
    assert found("pond scum; the idiotic box; compound scum") == [3.0]
    assert found("antiidiot") == [] and toxicity.hits(" ", None) == {}


def test_normalised_by_length():
    machine = toxicity.Lexicon({"idiot": 2.0}).machine()
    short, long = (toxicity.strength(toxicity.fold("idiot " + "word " * n), machine) for n in (5, 5000))
    assert short[0] > long[0] and short[1] == long[1]


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_edge_rows(docs_of, spark):
    lexicon = toxicity.Lexicon({"idiot": 6.0})
    got = [(r.doc_id, round(r.score, 6), r.predicted) for r in toxicity.score(docs_of([*ODD, (9, "you idi0t")]), lexicon).collect()]
    none = round(toxicity.probability((0, 0), lexicon.curve), 6)
    assert Counter(x for x in got if x[0] != 9) == Counter((i, none, 0) for i, _ in ODD)
    assert next(p for i, _, p in got if i == 9) == 1
    assert {r.doc_id for r in toxicity.keep_civil(docs_of([(8, "fine"), (9, "you idi0t")]), lexicon).collect()} == {8}
    empty = toxicity.fit(docs_of([]), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert empty == toxicity.Lexicon() and toxicity.score(docs_of([(1, "x")]), empty).count() == 1


def test_copies_teach_once(docs_of, spark):
    """A toxic text with many slightly changed copies does not make its own words toxic."""
    odd = "plain quirkle about gardens and rivers with many kind words in it for everyone to read"
    rows = [(i, f"{odd} grumblo end{i}") for i in range(40)] + [(100 + i, f"text{i} of its own grumblo word{i} there{i}") for i in range(40)]
    rows += [(200 + i, f"text{i} of its own fine word{i} there{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, int("grumblo" in t)) for i, t in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs_of(rows), labels, F.lit(True))
    assert any(x.startswith("grum") for x in lexicon.stems) and not any("quir" in x or "gard" in x for x in [*lexicon.stems, *lexicon.words])
    assert toxicity.copy_mark(rows[0][1]) == toxicity.copy_mark(rows[1][1]) != toxicity.copy_mark(rows[50][1])
    assert toxicity.copy_mark(None) == toxicity.copy_mark("")


def test_rare_toxic_word_among_many_frequent_terms(docs_of, spark):
    """More than 20,000 terms are found in more toxic rows than the word, which a third of them hold."""
    rng = np.random.default_rng(2)
    common = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (4500, 8))]
    rows = [(i, " ".join([*rng.permutation(common), *(["vilewort"] if i < 20 else [])])) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs_of(rows), labels, F.lit(True))
    assert any("vilewort".startswith(k) for k in [*lexicon.stems, *lexicon.words]) and len(lexicon.stems) + len(lexicon.words) == 1


def test_toxicity_learns_from_training_rows_only(docs_of, spark):
    # Texts differ: copies would teach once.
    rows = [(i, f"such{i} a{i} grumblo thing{i}" if i % 2 else f"such{i} a{i} fine thing{i}") for i in range(60)] + [(100 + i, f"quixle{i} x") for i in range(9)]
    labels = spark.createDataFrame([(i, int("fine" not in t)) for i, t in rows], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs_of(rows), labels, F.col("doc_id") < 100)
    assert any(x.startswith("grum") for x in lexicon.stems) and not any("quix" in x for x in [*lexicon.stems, *lexicon.words])


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op6_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark, docs_of):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs_of([*ODD, (7, "thndle eaer the of and with " * 20_000)]), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 4))
    assert got[7].lang_pred == "en" and not got[7].rejected and got[None].lang_pred == "en"
    assert got[5].rejected
    nothing = langid.fit(docs_of([]), F.lit(True))
    assert [r.lang_pred for r in langid.predict(docs_of([(1, "a text")]), nothing).collect()] == ["und"]


def test_blocks_count_every_ngram_once():
    text = "".join(np.random.default_rng(0).choice(list("abcdé "), 700_000))
    whole, block = langid.ngram_counts(text), langid.BLOCK
    try:
        langid.BLOCK = 1 << 30
        assert (langid.ngram_counts(text) == whole).all()
    finally:
        langid.BLOCK = block


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()] + [t for _, t in ODD[:4]]
    texts += ["a\x85b c\xa0d\na\x85b c\xa0d\n\n\n \n ", "x y z x y z x y", "a a a a", "one", "a\r\na\r\na"]
    for t in texts:
        assert quality.base_counts(t) == brute_base(t)


def test_quality_verdicts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op4_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def test_quality_edge_rows(docs_of, spark):
    chain = quality.fit(docs_of([]), spark.createDataFrame([], "doc_id long, quality int"))
    rows = [*ODD, (7, "One good line of words here. " * 20)]
    got = quality.assess(docs_of(rows), chain).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].base_failed and not by[1].kept and by[1].n_lines == 0 and by[7].base_failed and by[6].n_dup_lines == 2
    assert quality.assess(docs_of([]), chain).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_equals_all_labellings(seed):
    rng = np.random.default_rng(seed)
    chain = quality.Chain(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    features = rng.integers(0, quality.N_FEATURES, (9, 4)).tolist()
    emit = chain.emit[np.array(features)].sum(1)

    def value(labels):
        return sum(emit[t, x] for t, x in enumerate(labels)) + sum(chain.move[a, b] for a, b in zip(labels, labels[1:]))
    best = max(([k >> t & 1 for t in range(9)] for k in range(512)), key=value)
    assert chain.decode(features) == best and chain.decode([]) == []


def test_training_gradient_finds_a_mixed_document():
    rng = np.random.default_rng(0)
    good, bad = [0, 6, 12], [1, 7, 13]
    documents = [[good] * int(rng.integers(2, 8)) for _ in range(50)] + [[bad] * int(rng.integers(2, 8)) for _ in range(50)]
    chain = quality.train_chain(documents, [1] * 50 + [0] * 50)
    assert chain.decode([good] * 6 + [bad] * 6) == [1] * 6 + [0] * 6


def test_numbers_of_any_kind_are_no_letters():
    assert [langid.has_letter(t) for t in ("½", "²", "Ⅷ", "①", "٣", "_", "1", " ", None, "")] == [False] * 10
    assert all(langid.has_letter(t) for t in ("½ a", "é", "中", "ª", "ж²"))
