import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from coursemetrics.llm import lm, queries

SF = "/root/testdata/sf0.01"


def brute(network, vocabulary, text):
    """One token after the other, with a plain softmax over classes and members."""
    ids = [lm.EDGE] * lm.SIDE + [vocabulary[w] for w in lm.tokens_of(text)] + [lm.EDGE] * lm.SIDE
    total = 0.0
    for t in range(lm.SIDE, len(ids) - lm.SIDE):
        h = network.bias.astype(np.float64)
        for k, o in enumerate(lm.OFFSETS):
            h = h + network.tables[k][ids[t + o]]
        h = np.append(np.tanh(h), 1.0)
        c, m = divmod(ids[t], lm.MEMBERS)
        for z, i in ((h @ network.classes, c), (h @ network.members[c], m)):
            total += z[i] - np.log(np.exp(z).sum())
    return total


def test_scores_equal_brute_force(docs_of):
    model = lm.Model([b"the", b"of", b"and"], lm.Network.fresh(3))
    texts = ["the of and", "The unknown WORDS of here", "one", "", None, " \n", "the " * 500, "é ü the"]
    rows = list(enumerate(texts)) + [(None, "the of"), (1, texts[1])]
    for r in lm.score(docs_of(rows), model).collect():
        text = "the of" if r.doc_id is None else texts[r.doc_id]
        assert r.n_tokens == len(lm.tokens_of(text))
        assert r.log_probability == pytest.approx(brute(model.network, model.vocabulary(), text), abs=1e-3 * max(1, r.n_tokens))
        assert (r.mean_log_probability is None) == (r.n_tokens == 0)


def test_groups_do_not_change_scores(monkeypatch):
    words, network = lm.Vocabulary({b"a": 0, b"b": 70}), lm.Network.fresh(3)
    texts = ["a b c", "", None, "b " * 9, "c a"]

    def sums(limit):
        out = []
        for _, _, ids, starts in lm.rows_of_ids(texts, words, limit):
            at = np.flatnonzero(ids != lm.EDGE)
            p = network.log_probabilities(ids, at)
            out += [p[(at >= a) & (at < b)].sum() for a, b in zip(starts, np.append(starts[1:], len(ids)))]
        return out
    assert np.allclose(sums(1 << 20), sums(4), atol=1e-5)


def test_gradient_equals_differences():
    rng, network = np.random.default_rng(0), lm.Network.fresh(2)
    windows, target = rng.integers(0, lm.EDGE + 1, (4, 50)), rng.integers(0, lm.EDGE, 50)
    (back, bias, classes, members), total = network.gradient(windows, target)

    def value(part, index, change):
        parts = [x.astype(np.float64) for x in network.parts()]
        parts[part][index] += change
        return lm.Network(*parts).gradient(windows, target)[1]
    assert total == pytest.approx(value(1, 0, 0), rel=1e-4)
    for part, index, got in ((1, 3, bias[3]), (2, (4, 5), classes[4, 5]), (0, (1, windows[1, 7], 2), back[windows[1] == windows[1, 7], 2].sum()),
                             (3, (members[0][0], 1, 9), members[0][1][1, 9])):
        assert got == pytest.approx((value(part, index, 1e-4) - value(part, index, -1e-4)) / 2e-4, abs=1e-2)


def test_trained_network_prefers_real_order(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.fit(docs, share=0.5)
    texts = [r.text for r in docs.where("length(text) > 800 and length(text) < 4000").limit(40).collect()]
    rng = np.random.default_rng(0)
    mixed = [" ".join(rng.permutation([w for t in texts for w in t.split()])[:200]) for _ in texts]
    real, other = (np.array([r.mean_log_probability for r in lm.score(docs_of(list(enumerate(x))), model).collect()]) for x in (texts, mixed))
    fresh = np.array([r.mean_log_probability for r in lm.score(docs_of(list(enumerate(texts))), replace(model, network=lm.Network.fresh())).collect()])  # the same words and shares
    assert real.mean() > fresh.mean() + 1.0 and real.mean() > other.mean()


def test_given_documents_and_empty_table(spark, docs_of):
    rows = queries.op7_lm_scoring(spark, SF).collect()
    assert len(rows) == 1000 and all(r.log_probability < 0 for r in rows if r.n_tokens)
    model = lm.fit(docs_of([]))
    assert model.words == [] and lm.score(docs_of([]), model).count() == 0
    assert lm.fit(docs_of([(1, None), (2, "")])).words == []


def test_vocabulary_counts_all_documents(docs_of, monkeypatch):
    monkeypatch.setattr(lm, "MAX_COUNTED", 5)
    rows = [(i, f"common rare{i} Common") for i in range(30)] + [(99, "second second")] * 20
    assert lm.vocabulary(docs_of(rows), "text")[:2] == [b"common", b"second"]


def test_rare_words_have_probabilities_of_their_own(docs_of):
    """Against plain Python: the network's probability of the class, and the word's counted share of it."""
    rng = np.random.default_rng(4)
    texts = [" ".join(["the of and"] + [f"w{x}" for x in rng.zipf(1.3, 60) % 50_000]) for _ in range(200)]
    texts += [" ".join(f"o{i}x{k}" for k in range(10)) for i in range(200)] + ["once onlyhere", "twin words here", "twin words here", None, "", "the " * 3000 + "w5"]
    docs = docs_of(list(enumerate(texts)) + [(None, "twin w5")])
    model = replace(lm.counted(docs), network=lm.Network.fresh(3))
    counts = Counter(w for t in [*texts, "twin w5"] for w in lm.tokens_of(t))
    assert {bytes(r.word): r.n for r in model.counts.collect()} == counts
    assert b"w5" in model.words and len(model.words) <= lm.WORDS and b"once" not in model.words
    assert min(counts[w] for w in model.words) > max(n for w, n in counts.items() if w not in model.words)
    inside = Counter()
    for w, n in counts.items():
        inside[zlib.crc32(w) % lm.MEMBERS] += n * (w not in model.words)
    assert list(model.shared) == [inside[c] for c in range(lm.MEMBERS)]
    asked = [*texts, "neverseen w5"]
    got = {r.doc_id: r for r in lm.score(docs_of(list(enumerate(asked)) + [(None, "w5")]), model).collect()}
    for i, text in [*enumerate(asked), (None, "w5")]:
        rare = [w for w in lm.tokens_of(text) if w not in model.words]
        want = brute(model.network, model.vocabulary(), text) + sum(math.log(counts.get(w, 1) / (inside[zlib.crc32(w) % lm.MEMBERS] + 1)) for w in rare)
        assert got[i].log_probability == pytest.approx(want, abs=1e-3 * max(1, got[i].n_tokens))


def test_one_pass_equals_fit_and_score(spark, docs_of):
    rows = [(i, f"some words of text {i % 7} and word{i}" * 5) for i in range(50)]
    docs = docs_of(rows)
    one = {r.doc_id: r.n_tokens for r in lm.fit_and_score(docs).collect()}
    assert one == {r.doc_id: r.n_tokens for r in lm.score(docs, lm.fit(docs)).collect()}


def test_ids_do_not_clash_with_helper_columns(spark):
    df = spark.createDataFrame([(7, "a b", 1, "x"), (8, None, 2, "y")], "row long, ids string, n int, word string")
    got = {r.row: r for r in lm.fit_and_score(df, "row", "ids").collect()}
    assert got[7].n_tokens == 2 and got[8].n_tokens == 0 and got[8].log_probability == 0


def test_every_place_is_learnt_from(spark, docs_of, monkeypatch):
    """The rounds together take each place of each text once."""
    docs = docs_of([(i, " ".join(f"w{(i * j) % 50}" for j in range(40))) for i in range(1, 30)])
    model = lm.counted(docs)
    encoded = lm.encode(docs, model.words).coalesce(1)
    told = []
    merged = lm.Network.with_flat
    collect = type(encoded).collect

    def spy(df):
        rows = collect(df)
        if rows and "slot" in rows[0]:
            told.append(rows[0].n)
        return rows
    monkeypatch.setattr(type(encoded), "collect", spy)
    lm.train(model, encoded)
    assert merged and len(told) == 2 and sum(told) == 29 * 40 and min(told) > 0.4 * 29 * 40


def test_a_step_equals_plain_adagrad():
    """All places and classes at once: the same as one class and one place after the other."""
    rng, first = np.random.default_rng(6), lm.Network.fresh(4)
    windows, target = rng.integers(0, lm.EDGE + 1, (4, 700)), rng.integers(0, lm.EDGE, 700)
    windows[:, :200] %= 5
    trainer = lm.Trainer(first)
    told = trainer.step(windows.astype(np.uint16), target.astype(np.uint16))
    (back, bias, classes, members), total = first.gradient(windows, target)
    want = [np.zeros(x.shape) for x in first.parts()]
    for place in range(4):
        np.add.at(want[0][place], windows[place], back)
    want[1], want[2] = bias, classes
    for j, g in members:
        want[3][j] = g
    assert told == pytest.approx(total, rel=1e-5)
    for x, old, g in zip(trainer.net.parts(), first.parts(), want):
        g = np.asarray(g, np.float64) / 700
        assert np.allclose(x, old + lm.RATE * g / np.sqrt(1e-2 + g * g), atol=1e-5)


def test_token_arrays_equal_single_texts(docs_of, monkeypatch):
    texts = ["A b\x0bc\x0c d\te\r\nf", "", None, " \n ", "é ü İ ß x", "a\x1cb \x85 a", "x", "the " * 9]
    tokens, sizes = lm.token_array(texts)
    assert tokens.to_pylist() == [w for t in texts for w in lm.tokens_of(t)] and sizes.tolist() == [len(lm.tokens_of(t)) for t in texts]
    assert len(lm.token_array([])[0]) == 0 and lm.token_array([None, ""])[1].tolist() == [0, 0]
    monkeypatch.setattr(lm, "TEXTS", 3)
    head = [b"the", b"a"]
    rows = {r.id: r for r in lm.encode(docs_of(list(enumerate(texts))), head).collect()}
    for i, text in enumerate(texts):
        own = lm.tokens_of(text)
        assert np.frombuffer(rows[i].ids, "<u2").tolist() == [lm.Vocabulary({b"the": 0, b"a": 1})[w] for w in own]
        assert dict(zip(map(bytes, rows[i].rare), rows[i].times)) == Counter(w for w in own if w not in head)


def test_hashes_of_all_words_at_once():
    rng = np.random.default_rng(2)
    words = [rng.bytes(int(n)) for n in rng.integers(0, 2 * lm.LONG, 500)] + [b"", b"a" * lm.LONG, b"b" * (lm.LONG + 1), b"c" * 5000, "é".encode()]
    for array in (pa.array(words, pa.large_binary()), pa.array([b"x", *words], pa.large_binary()).slice(1)):
        assert lm.crc32_of(array).tolist() == [zlib.crc32(w) for w in words]
    assert lm.crc32_of(pa.array([], pa.large_binary())).tolist() == []


@pytest.mark.parametrize("n, ids", [(1, 5), (40, 3), (700, 60), (700, lm.EDGE)])
def test_rows_are_summed_once(n, ids):
    """Rows that occur once, a few times, and more than LAYERS times."""
    rng = np.random.default_rng(n + ids)
    rows, back = rng.integers(0, ids, (n, 4)) + lm.TABLE_OF, rng.standard_normal((n, lm.HIDDEN)).astype(np.float32)
    want = np.zeros((4 * (lm.EDGE + 1), lm.HIDDEN))
    np.add.at(want, rows, back[:, None])
    heads, sums = lm.summed(rows, back)
    assert heads.tolist() == np.unique(rows).tolist() and np.allclose(sums, want[heads], atol=1e-4)


def test_places_are_scored_in_bounded_steps(monkeypatch):
    """No product is of more than STEP places, and the scores don't depend on it, nor on values that would overflow."""
    network, rng, held = lm.Network.fresh(5), np.random.default_rng(1), []
    network.classes *= 200
    network.members[3] *= 300
    ids = np.concatenate([[lm.EDGE] * 2, rng.integers(0, lm.EDGE, 400), [7] * 5000, [lm.EDGE] * 2]).astype(np.uint16)
    at = np.flatnonzero(ids != lm.EDGE)
    hidden = lm.Network.hidden
    monkeypatch.setattr(lm.Network, "hidden", lambda self, windows: held.append(windows.shape[1]) or hidden(self, windows))
    got = network.log_probabilities(ids, at)
    assert max(held) <= lm.STEP < 5000 and sum(held) == len(at)
    monkeypatch.setattr(lm, "STEP", 7)
    assert np.isfinite(got).all() and np.allclose(got, network.log_probabilities(ids, at), atol=1e-3)
    some = network.log_probabilities(ids, at[:50])
    for place, value in zip(at[:50], some):
        h = network.bias.astype(np.float64) + sum(network.tables[k][ids[place + o]].astype(np.float64) for k, o in enumerate(lm.OFFSETS))
        h, (c, m) = np.append(np.tanh(h), 1.0), divmod(int(ids[place]), lm.MEMBERS)
        want = sum(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, i in ((h @ network.classes, c), (h @ network.members[c], m)))
        assert value == pytest.approx(want, abs=1e-2)


def test_words_held_once_or_never_have_the_same_share(docs_of):
    docs = docs_of([(i, "many words " * 3 + f"single{i}") for i in range(lm.WORDS + 50)])
    model = replace(lm.counted(docs), network=lm.Network.fresh(3))
    assert model.counts.where("n = 1").count() == lm.WORDS + 50
    word = next(f"single{i}" for i in range(50) if f"single{i}".encode() not in model.words)
    other = next(f"absent{i}" for i in range(9999) if (zlib.crc32(f"absent{i}".encode()) - zlib.crc32(word.encode())) % lm.MEMBERS == 0)
    got = {r.doc_id: r.log_probability for r in lm.score(docs_of([(1, word), (2, other)]), model).collect()}
    assert got[1] == got[2] < 0
