import numpy as np
import pytest

from coursemetrics.llm import decontaminate as dc
from coursemetrics.llm import queries

SF = "/root/testdata/sf0.01"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(10))
def test_lcs_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, int(rng.integers(0, 90))).tolist(), rng.integers(0, 6, int(rng.integers(0, 120))).tolist()
    assert dc.lcs_length(a, b) == brute_lcs(a, b)


def held(spark, sf):
    """Documents that hold an item word for word."""
    items = {r.item_id: b" " + b" ".join(dc.words_of(r.text)) + b" " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: b" " + b" ".join(dc.words_of(r.text)) + b" " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    return {(d, i) for d, t in docs.items() for i, w in items.items() if w in t}


def test_given_leaks_are_found_and_clean_documents_left(spark):
    want = held(spark, SF)
    assert want and {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, SF).collect()} == want


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_paraphrases_recall(spark, docs_of, bench):
    """Changed, dropped and inserted words: every paraphrase that the check on all words accepts should be a candidate."""
    rng = np.random.default_rng(1)
    filler = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(60).collect()]
    rows, want = [], set()
    for k, r in enumerate(bench.collect()):
        words = r.text.split()
        for _ in range(len(words) // 6):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            words[at:at + 1] = [] if kind == 0 else ["changed"] if kind == 1 else [words[at], "extra"]
        around = filler[k % len(filler)].split()
        at = int(rng.integers(len(around)))
        rows.append((k, " ".join([*around[:at], " ".join(words).upper() if k % 4 == 0 else ", ".join(words), *around[at:]])))
        if len(r.text.split()) >= 12:
            want.add((k, r.item_id))
    got = {(r.doc_id, r.item_id) for r in dc.find_contaminated(docs_of(rows), bench).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len(got - {(k, r.item_id) for k, r in enumerate(bench.collect())} - held(spark, SF)) <= 2


def test_cosines_agree_with_exact_vectors(spark, bench):
    """Latent cosines against exact TF-IDF cosines over all passages: nearly no candidate is lost."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = next(dc.indexes(docs, bench))
    rows = [dc._row(np.array([index.vocabulary[w] for w in x.words], np.int32), index.idf) for x in
            (dc.item_of(r.item_id, r.text) for r in sorted(bench.collect(), key=lambda r: (str(r.item_id), r.text)))]
    exact = np.zeros((len(index.vocabulary), len(rows)), np.float32)
    for i, (at, w) in enumerate(rows):
        exact[at, i] = w
    lost = both = 0
    off = []
    for r in docs.collect():
        terms = np.array([index.vocabulary.get(w, -1) for w in dc.words_of(r.text)], np.int32)
        for first, near in index.cosines(terms):
            for p in range(len(near)):
                x = terms[(first + p) * dc.STRIDE:(first + p + 2) * dc.STRIDE]
                x = x[x >= 0]
                row = dc._row(x, index.idf)
                if row is None:
                    assert not near[p].any()
                    continue
                true, energy = row[1] @ exact[row[0]], ((np.unique(x, return_counts=True)[1] * index.idf[row[0]]) ** 2).sum()
                hit = (true >= 0.5) & (energy >= index.least)
                off += (near[p] - true)[near[p] > 0].tolist()
                assert near[p].max() <= 1
                both, lost = both + hit.sum(), lost + (hit & (near[p] < dc.MIN_COSINE)).sum()
    assert both >= 40 and lost <= 0.05 * both
    assert len(off) >= 40 and max(map(abs, off)) < 0.15 and np.mean(np.abs(off)) < 0.05


def test_edge_rows(docs_of, spark, bench):
    item = bench.first()
    long = "filler word " * 60_000 + item.text + " more filler" * 1000
    rows = [(1, None), (2, ""), (3, item.text), (3, item.text), (None, item.text), (4, long), (5, item.text.lower().replace(" ", "\n"))]
    got = sorted(((r.doc_id, r.item_id) for r in dc.find_contaminated(docs_of(rows), bench).collect()), key=str)
    assert got == sorted([(i, item.item_id) for i in (3, 3, None, 4, 5)], key=str)
    assert sorted(r.doc_id for r in dc.keep_uncontaminated(docs_of(rows), bench).collect()) == [1, 2]
    none = spark.createDataFrame([(1, None), (2, ""), (3, "?!")], "item_id long, text string")
    for empty in (none, none.where("item_id > 5")):
        assert dc.find_contaminated(docs_of(rows), empty).count() == 0
        assert dc.keep_uncontaminated(docs_of(rows), empty).count() == len(rows)
    assert dc.find_contaminated(docs_of([]), bench).count() == 0


def test_shared_passage_is_found_everywhere(docs_of, bench):
    """An item that most documents hold keeps its weight."""
    item = bench.first()
    rows = [(i, f"start{i} of it {item.text} and end{i}") for i in range(300)] + [(1000 + i, f"some other text of it and number{i} " * 5) for i in range(100)]
    got = {r.doc_id for r in dc.find_contaminated(docs_of(rows), bench).collect()}
    assert got == set(range(300))


def test_many_items_use_the_latent_space(docs_of, spark, monkeypatch):
    monkeypatch.setattr(dc, "RANK", 48)
    rng = np.random.default_rng(0)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 30))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, "the start of it " + t + " the end") for i, t in items[:30]] + [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 80))) for i in range(50)]
    got = {(r.doc_id, r.item_id) for r in dc.find_contaminated(docs_of(rows), bench).collect()}
    assert len(got & {(i, i) for i in range(30)}) >= 27 and not any(d >= 100 for d, _ in got)


def test_blocks_of_items(docs_of, bench, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 15)
    item = bench.first()
    assert {r.item_id for r in dc.find_contaminated(docs_of([(1, item.text), (2, "nothing")]), bench).collect()} == {item.item_id}


def test_copies_among_many_items_are_found(docs_of, spark):
    """More items than ranks: each keeps its length in the latent space, so its copy stays a candidate."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 6000, 37))) for i in range(1000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"the start of it {t} the end") for i, t in items] + [(5000 + i, " ".join(f"w{x}" for x in rng.integers(0, 6000, 80))) for i in range(50)]
    docs = docs_of(rows)
    assert {(r.doc_id, r.item_id) for r in dc.find_contaminated(docs, bench).collect()} == {(i, i) for i, _ in items}
    texts, off, seen = dict(items), 0.0, 0
    for index in dc.indexes(docs, bench):
        for k, i in enumerate(index.item_ids):
            terms = np.array([index.vocabulary[w] for w in dc.words_of(texts[i])], np.int32)
            x = terms[:2 * dc.STRIDE]
            exact = (dc._row(x, index.idf)[1] * dict_of(dc._row(terms, index.idf), dc._row(x, index.idf)[0])).sum()
            (_, near), seen = next(index.cosines(terms)), seen + 1
            off = max(off, abs(near[0, k] - exact))
    assert seen == 1000 and off < 0.15


def dict_of(row, at):
    weights = dict(zip(row[0].tolist(), row[1].tolist()))
    return np.array([weights[a] for a in at.tolist()])


@pytest.mark.parametrize("length", [65, 300, 1000, 8000])
def test_long_items_are_found(docs_of, spark, length):
    """Also where one item has more parts than a block has ranks."""
    rng = np.random.default_rng(length)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 6000, length))) for i in range(8 if length < 2000 else 2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"the start of it {t} the end") for i, t in items] + [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 6000, 80))) for i in range(50)]
    docs = docs_of(rows)
    assert {(r.doc_id, r.item_id) for r in dc.find_contaminated(docs, bench).collect()} == {(i, i) for i, _ in items}
    assert {r.doc_id for r in dc.keep_uncontaminated(docs, bench).collect()} == set(range(100, 150))


def test_repeated_words_have_true_lengths(docs_of, spark):
    """An item written twice, and one repeated word of it, have the cosines of their TF-IDF vectors."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, "lambda mu nu xi omicron pi rho sigma tau upsilon")], "item_id int, text string")
    docs = docs_of([(1, f"{item} {item}"), (2, "alpha " * 30), (3, f"{item} " + "alpha " * 20), (4, "nothing of it")])
    got = {r.doc_id: r for r in dc.find_contaminated(docs, bench).collect()}
    assert got.keys() == {1, 3} and got[1].cosine == pytest.approx(1, abs=0.01) and got[1].item_id == 1
    index = next(dc.indexes(docs, bench))
    w = np.array([index.idf[index.vocabulary[x]] for x in dc.words_of(item)])
    tf = np.array([21] + [1] * 9)
    assert got[3].cosine == pytest.approx((w * w * tf).sum() / np.sqrt((w * w).sum() * ((w * tf) ** 2).sum()), abs=0.02)


@pytest.mark.parametrize("kind", ["int", "string", "long", "date"])
def test_item_ids_of_any_type(docs_of, spark, kind):
    text = "one item of a benchmark with words enough to be found again"
    bench = spark.createDataFrame([("7", text), (None, text)], "k string, text string").selectExpr(
        f"cast({'date_add(date\'2024-01-01\', cast(k as int))' if kind == 'date' else 'k'} as {kind}) as item_id", "text")
    got = dc.find_contaminated(docs_of([(1, f"so {text} it is")]), bench)
    assert got.schema["item_id"].dataType.simpleString() == bench.schema["item_id"].dataType.simpleString()
    assert {r.item_id for r in got.collect()} == {r.item_id for r in bench.collect()} and got.count() == 2


def test_the_space_comes_from_the_passages_of_all_documents(spark, monkeypatch):
    docs = spark.range(2300).selectExpr("id AS doc_id", "concat('alpha beta gamma ', id % 7) AS text")
    inner, seen = dc._fit_basis, []
    monkeypatch.setattr(dc, "_fit_basis", lambda stored, passages, *rest: (seen.append(passages), inner(stored, passages, *rest))[1])
    assert len(list(dc.build_indexes(docs, [dc.item_of(1, "alpha beta gamma delta. Is it so?")]))) == 1
    assert seen == [2300]


@pytest.mark.parametrize("gram", [1 << 22, 40 * 7])
def test_products_of_terms_equal_the_dense_matrix(monkeypatch, gram):
    """In one band of terms, and in many."""
    monkeypatch.setattr(dc, "GRAM", gram)
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((300, 40)) < 0.3, rng.random((300, 40)), 0)
    dense[17] = 0
    of, at = np.nonzero(dense)
    bands = list(dc._grams(at.astype(np.int32), dense[of, at], np.bincount(of, minlength=300), 40))
    assert [a for a, _ in bands] == list(range(0, 40, max(1, min(40, gram // 40)))) and np.allclose(np.concatenate([g for _, g in bands]), dense.T @ dense, atol=1e-4)


def test_passages_and_document_frequencies_come_from_one_reading(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dc, "PASSAGES", 3)
    monkeypatch.setattr(dc, "TEXTS", 4)
    texts = ["alpha beta " * 20, "", None, "other", *[f"alpha word{i} gamma gamma" for i in range(9)]]
    whole, seen, documents, passages = dc._passages(docs_of(list(enumerate(texts))), {b"alpha": 0, b"beta": 1, b"gamma": 2}, "text")
    assert seen.tolist() == [10, 1, 9] and (documents, passages) == (13, 11)
    rows = whole.collect()
    assert sum(len(r.sizes) for r in rows) == 11 and sum(sum(r.sizes) for r in rows) == 22 and sum(sum(r.tf) for r in rows) == 40 + 9 * 3


def test_texts_compared_together_have_their_own_hits(spark, docs_of, bench, monkeypatch):
    """Short texts in a group, long ones in pieces: the same hits as each text alone in one piece."""
    items = [r.text for r in bench.limit(12).collect()]
    texts = [[], *([dc.words_of(f"{'some filler ' * (9 * k)} {t} {'more ' * k} {items[0] if k % 3 else ''}") for k, t in enumerate(items)]), [b"x"], dc.words_of(items[1])]
    index = next(dc.indexes(docs_of([(1, " ".join(items))]), bench))
    monkeypatch.setattr(dc, "CHUNK", 5)
    got = sorted(((text, *hit[:1], *hit[2:]) for text, *hit in index.search_all(texts)), key=str)
    monkeypatch.setattr(dc, "CHUNK", 100_000)
    assert got and got == sorted(((k, *hit[:1], *hit[2:]) for k, words in enumerate(texts) for hit in index.search(words)), key=str)
