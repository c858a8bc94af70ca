"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) and benchmark items are TF-IDF vectors over the items' words, with document
frequencies counted over all documents. A randomised SVD of the passages of all documents, whose products are summed over
Spark's partitions, gives a latent space; every passage of every document is compared with every item by cosine there. A long item has
a vector for each part of it, so that a passage is compared with about as many words; the best of them counts. Items are
searched in blocks that the space can carry, and it is widened until every item keeps nearly all of its length.
Candidates are checked on the words themselves: the longest common subsequence of the item's content words
with the region around the passage, and the item's answer (its last sentence) where the match is not near
complete. So a passage with changed, dropped or inserted words is found as well as a copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from coursemetrics.llm.common import stored

STRIDE = 16  # words; a passage is two strides long
PART = 4 * STRIDE  # words of an item in one vector; parts overlap by half, so each passage of a copy is within one
RANK = 256
EXTRA = 10
KEPT = 0.9  # of an item's length, that the latent space holds at least
ITEMS = 2000  # share a vocabulary, its document frequencies and the stored passages
TOGETHER = 10  # indexes that one pass over the documents searches
PASSAGES = 2000  # in one stored row
MIN_COSINE = 0.35
HELD = 0.4
NEAR_COMPLETE = 0.8
WITH_ANSWER = 0.55
FEW_WORDS = 6
CHUNK = 256  # strides that are compared at once, so that their vectors stay in a core's cache
TEXTS = 256  # whose words are held at once
TERM_BLOCK = 256
GRAM = 1 << 22  # products of two terms that are held at once
TERMS = 1 << 21  # terms of passages that are held at once

SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SENTENCE = re.compile(r"[.?!\n]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII signs separate them."""
    return (text or "").lower().encode().translate(SPACES).split()


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for every element of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = 0
    full = (1 << len(a)) - 1
    for x in b:
        if m := at.get(x):
            row, u = row, row | m
            row = u & ((u - ((row << 1) | 1)) ^ u) & full
    return row.bit_count()


@dataclass
class Item:
    item_id: object
    words: list[bytes]
    answer: list[bytes]


def item_of(item_id, text: str | None) -> Item:
    words = words_of(text)
    parts = [p for p in map(words_of, SENTENCE.split(text or "")) if p]
    answer = parts[-1] if len(parts) > 1 else words[-max(1, len(words) // 3):]
    return Item(item_id, words, answer)


@dataclass
class Index:
    """Everything the search needs of one block of items: bounded by RANK and the items' words."""

    item_ids: list
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray  # term by rank, times idf; term by part where there are fewer parts than ranks
    latent: np.ndarray | None  # part by rank; None where it is already in the basis
    least: np.ndarray  # of each part: the energy that a passage has at least if it holds (a passage of) the part
    heads: np.ndarray  # first part of each item
    content: list[list[int]]
    answers: list[list[int]]
    lengths: list[int]

    def cosines(self, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first stride, cosine of each passage with each item) of a text given as term ids (-1: no item has the word).

        The cosine is 0 where the passage is no candidate: below MIN_COSINE, also when its length is taken for at least ``least``
        (a passage with one word of an item would come close to it otherwise).
        """
        for first, some in _pieces(terms):
            passages, cosine = self._near([some])
            near = np.zeros((min(len(some), max(1, _strides(some) - 1)), len(self.heads)))
            near[passages] = cosine
            yield first, near

    def _near(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first stride, cosine with each item) of the passages of texts' pieces that are candidates; strides are numbered over all pieces."""
        sizes, strides = np.array([len(x) for x in pieces]), np.array([_strides(x) for x in pieces])
        terms, begins = np.concatenate(pieces), np.cumsum(strides) - strides
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((0, len(self.heads)))
        of = (np.repeat(begins, sizes) + (np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STRIDE)[at]
        own, n = terms[at].astype(np.int64), int(strides.sum())
        last, alone = np.zeros(n, bool), begins[strides == 1]
        last[(begins + strides - 1)[strides > 0]] = True
        begun = ~last
        begun[alone] = True
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums = np.zeros((n, self.basis.shape[1]), np.float32)
        sums[of[heads]] = np.add.reduceat(self.basis[own], heads, axis=0)
        # A stride is in the passage that it begins and in the one before; each term of a passage counts once, by its weight there.
        here, before = begun[of], (of > 0) & ~last[of - 1]
        keys, tf = np.unique(np.concatenate([of[here] * len(self.idf) + own[here], (of[before] - 1) * len(self.idf) + own[before]]), return_counts=True)
        passage, term = np.divmod(keys, len(self.idf))
        energy = np.bincount(passage, (tf * self.idf[term]) ** 2, n)
        passages = np.flatnonzero(begun)
        two = np.flatnonzero(~last[passages])
        near = sums[passages]
        near[two] += sums[passages[two] + 1]
        near = near if self.latent is None else near @ self.latent.T
        # No item is near where the nearest is too far for the least length.
        some = np.flatnonzero(near.max(1) >= MIN_COSINE * np.sqrt(np.maximum(energy[passages], self.least.min())))
        passages, near, energy = passages[some], near[some], energy[passages[some]]
        candidate = near >= MIN_COSINE * np.sqrt(np.maximum(energy[:, None], self.least))
        near = np.where(candidate, np.minimum(near / np.sqrt(np.maximum(energy[:, None], 1e-12)), 1), 0)
        return passages, near if len(self.heads) == near.shape[1] or not len(near) else np.maximum.reduceat(near, self.heads, axis=1)

    def search(self, words: list[bytes]) -> list[tuple[object, float, float, bool, int]]:
        """(item_id, cosine, share of its content words found in order, answer found, first word) of contained items."""
        return [hit for _, *hit in self.search_all([words])]

    def search_all(self, texts: list[list[bytes]]) -> Iterator[tuple]:
        """What ``search`` tells of each text, after the text's number; short texts are compared together."""
        if not self.item_ids:
            return
        terms = [self.terms_of(words) for words in texts]
        found: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for group in _together((text, *piece) for text, own in enumerate(terms) for piece in _pieces(own)):
            begins = np.cumsum([0] + [_strides(piece) for _, _, piece in group])
            passages, cosine = self._near([piece for _, _, piece in group])
            for p, i in zip(*(x.tolist() for x in np.nonzero(cosine >= MIN_COSINE))):
                k = int(np.searchsorted(begins, passages[p], "right")) - 1
                text, first, _ = group[k]
                found.setdefault(text, {}).setdefault(i, []).append((int(first + passages[p] - begins[k]), float(cosine[p, i])))
        for text, near in found.items():
            for hit in self._checked(terms[text], near):
                yield text, *hit

    def terms_of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))

    def _checked(self, terms: np.ndarray, found: dict[int, list[tuple[int, float]]]) -> Iterator[tuple[object, float, float, bool, int]]:
        """The candidates that hold on the words themselves, each item's best."""
        for i, near in sorted(found.items()):
            best = None
            for region, cosine in _regions(near):
                a, b = max(0, region[0] * STRIDE - self.lengths[i]), (region[1] + 2) * STRIDE + self.lengths[i]
                here = terms[a:b].tolist()
                share = lcs_length(self.content[i], here) / max(1, len(self.content[i]))
                told = lcs_length(self.answers[i], here) >= 0.5 * len(self.answers[i])
                if len(self.content[i]) < FEW_WORDS:
                    hit = share == 1 and cosine >= 0.5
                else:
                    hit = share >= NEAR_COMPLETE or share >= WITH_ANSWER and told
                if hit and (best is None or (share, cosine) > best[1::-1]):
                    best = (cosine, share, told, region[0] * STRIDE)
            if best:
                yield self.item_ids[i], *best


def _strides(terms: np.ndarray) -> int:
    return -(-len(terms) // STRIDE)


def _pieces(terms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first stride, terms) of pieces of a text that share a stride, so that each passage is in one of them."""
    for first in range(0, max(1, _strides(terms) - 1), CHUNK):
        yield first, terms[first * STRIDE:(first + CHUNK + 1) * STRIDE]


def _together(pieces: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Runs of pieces of about CHUNK strides."""
    group, size = [], 0
    for piece in pieces:
        group.append(piece)
        size += _strides(piece[2])
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _regions(near: list[tuple[int, float]]) -> Iterator[tuple[tuple[int, int], float]]:
    """Runs of adjoining passages, each of at most eight, with the best cosine."""
    start, end, best = near[0][0], near[0][0], near[0][1]
    for p, c in near[1:]:
        if p > end + 1 or p - start >= 8:
            yield (start, end), best
            start, best = p, c
        end, best = p, max(best, c)
    yield (start, end), best


def _row(terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Term ids and weights of length 1 of one passage."""
    at, tf = np.unique(terms[terms >= 0], return_counts=True)
    w = tf * idf[at]
    norm = np.sqrt((w * w).sum())
    return (at, w / norm) if norm > 0 else None


def _rows_times(at: list[np.ndarray], w: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    heads = np.cumsum([0, *map(len, at)])[:-1]
    flat, weights = np.concatenate(at), np.concatenate(w)
    return np.add.reduceat(matrix[flat] * weights[:, None], heads, axis=0)


def _passages(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str) -> tuple[DataFrame, np.ndarray, int, int]:
    """Passages of all documents, written, the documents that hold each word of the vocabulary, and the numbers of documents and passages.

    A row has some thousand passages: how many terms each has, term ids, and how often each occurs there. A task's last row
    has its counts of documents, with the two numbers behind the last word, so the texts are read and split once.
    """
    size = len(vocabulary)

    def told(sizes: list[np.ndarray], at: list[np.ndarray], tf: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        held = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(x or [np.zeros(0)]).astype(kind).tobytes()], pa.binary()) for x, kind in ((sizes, "u1"), (at, "<i4"), (tf, "u1"))]
                                          + [pa.array([held.tolist()], pa.list_(pa.int64())), pa.array([counts[held].tolist()], pa.list_(pa.int64()))], names=["sizes", "at", "tf", "term", "documents"])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, none = np.zeros(size + 2, np.int64), np.zeros(0, np.int64)
        kept, held = ([], [], []), 0
        for batch in _slices(batches):
            words = [words_of(text) for text in batch.column(0).to_pylist()]
            counts[size] += len(words)
            lengths = np.array([len(x) for x in words])
            terms = np.concatenate([np.fromiter(map(vocabulary.get, x, repeat(-1)), np.int64, len(x)) for x in words])
            own = -(-lengths // (2 * STRIDE))
            of = np.repeat(np.cumsum(own) - own, lengths) + (np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // (2 * STRIDE)
            keys, tf = np.unique((of * size + terms)[terms >= 0], return_counts=True)
            of, term = np.divmod(keys, size)
            text = np.repeat(np.arange(len(words)), own)[of]
            counts[:size] += np.bincount(np.unique(text * size + term) % size, minlength=size)
            sizes = np.bincount(of)
            sizes = sizes[sizes > 0]
            counts[size + 1] += len(sizes)
            held += len(sizes)
            for x, more in zip(kept, (sizes, term, tf)):
                x.append(more)
            if held >= PASSAGES:
                yield told(*kept, none)
                kept, held = ([], [], []), 0
        yield told(*kept, counts)

    whole = stored(docs.select(text_col).mapInArrow(passages, "sizes binary, at binary, tf binary, term array<long>, documents array<long>"), "decontaminate-passages")
    # At most one row for each word of the items, and two.
    counts = np.zeros(size + 2, np.int64)
    for r in whole.select(F.inline(F.arrays_zip("term", "documents"))).groupBy("term").agg(F.sum("documents").alias("n")).collect():
        counts[r.term] = r.n
    return whole, counts[:size], int(counts[size]), int(counts[size + 1])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, TEXTS at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, TEXTS):
            yield batch.slice(k, TEXTS)


def _fit_basis(stored_passages: DataFrame, passages: int, own_at: list[np.ndarray], own_w: list[np.ndarray], own: np.ndarray, seed: int, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the passages' matrix: items (``own_at``, ``own_w``), and the ``passages`` of all documents.

    Randomised: A'A times a random matrix is summed over the partitions (a sum for each block of terms), its range
    is made orthogonal, and the small matrix of A'A in that range, summed the same way, is diagonalised. A task makes its
    part of A'A, a band of terms at a time, and multiplies that, so the wide matrix is read once for thousands of passages. ``own`` has
    the block's term for each term of the passages, -1 where no item of the block has the word; ``idf`` is of the latter.
    """
    terms = int(own.max()) + 1
    width = min(RANK + EXTRA, terms)
    weight = np.sqrt(max(1, passages) / max(1, len(own_at)))  # items weigh as much as passages in all

    def within(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms that the block's items have, their weights in passages of length 1, and how many each passage has."""
        sizes, at, tf = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows), ("u1", "<i4", "u1")))
        sizes = sizes.astype(np.int64)
        of, w = np.repeat(np.arange(len(sizes)), sizes), tf * idf[at].astype(np.float64)
        w /= np.sqrt(np.bincount(of, w * w, len(sizes)))[of]
        term = own[at]
        held = term >= 0
        return term[held], w[held], np.bincount(of[held], minlength=len(sizes))

    def summed(product, rows_of_result: int, columns: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rows, held = np.zeros((rows_of_result, columns)), [], 0
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("sizes", "at", "tf"))):
                    rows.append(row)
                    held += len(row[2])
                    if held >= TERMS:
                        product(total, *within(rows))
                        rows, held = [], 0
            if held:
                product(total, *within(rows))
            if total.any():
                blocks = range(0, rows_of_result, TERM_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([total[b:b + TERM_BLOCK].astype("<f4").tobytes() for b in blocks], pa.binary())], names=["block", "x"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "x": [sum(np.frombuffer(x, "<f4").astype(np.float64) for x in sorted(pdf["x"])).astype("<f4").tobytes()]})

        out = np.zeros((rows_of_result, columns))
        product(out, np.concatenate(own_at), np.concatenate(own_w) * weight, np.array([len(x) for x in own_at]))
        # One matrix, as large as the result: items' words by RANK.
        for r in stored_passages.select("sizes", "at", "tf").mapInArrow(run, "block long, x binary").groupBy("block").applyInPandas(add, "block long, x binary").collect():
            out[r.block:r.block + TERM_BLOCK] += np.frombuffer(r.x, "<f4").reshape(-1, columns)
        return out

    drawn: list[np.ndarray] = []  # the random matrix, made once in each task

    def by_random(total, at, w, sizes) -> None:
        if not drawn:
            drawn.append(np.random.default_rng(seed).standard_normal((terms, width)).astype(np.float32))
        for a, gram in _grams(at, w, sizes, terms):
            total[a:a + len(gram)] += gram @ drawn[0]

    q, _ = np.linalg.qr(summed(by_random, terms, width))
    q = q.astype(np.float32)
    shared = stored_passages.sparkSession.sparkContext.broadcast(q)

    def in_range(total, at, w, sizes) -> None:
        for a, gram in _grams(at, w, sizes, terms):
            total += shared.value[a:a + len(gram)].T @ (gram @ shared.value)

    small = summed(in_range, width, width)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, ::-1][:, :RANK].astype(np.float32)


def _grams(at: np.ndarray, w: np.ndarray, sizes: np.ndarray, terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first term, rows of A'A) for bands of terms, of at most about GRAM values; A has a row for each passage."""
    heads, at = np.cumsum(sizes) - sizes, at.astype(np.int64)
    size_of, head_of = np.repeat(sizes, sizes), np.repeat(heads, sizes)
    band = max(1, GRAM // terms)
    for low in range(0, terms, band):
        out = np.zeros(min(band, terms - low) * terms)
        inside = np.flatnonzero((at >= low) & (at < low + band))
        for k in range(0, len(inside), 1 << 13):
            one = inside[k:k + (1 << 13)]
            n = size_of[one]
            first = np.repeat(one, n)
            second = np.arange(len(first)) - np.repeat(np.cumsum(n) - n - head_of[one], n)
            np.add.at(out, (at[first] - low) * terms + at[second], w[first] * w[second])
        yield low, out.reshape(-1, terms).astype(np.float32)


def _widened(basis: np.ndarray, at: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
    """The basis, and directions in which rows lie that it holds less than KEPT of; with them it holds those rows whole."""
    latent = _rows_times(at, w, basis)
    short = np.flatnonzero((latent ** 2).sum(1) < KEPT ** 2)
    if not len(short):
        return basis
    rest = np.zeros((len(basis), len(short)))
    for k, i in enumerate(short):
        rest[at[i], k] = w[i]
    rest -= basis @ latent[short].T
    more, size, _ = np.linalg.svd(rest, full_matrices=False)
    return np.concatenate([basis, more[:, size > 1e-3].astype(basis.dtype)], axis=1)


def build_indexes(docs: DataFrame, items: list[Item], id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Iterator[Index]:
    """Indexes of blocks of items, each with as many vectors as RANK can carry."""
    items = [x for x in items if x.words]
    if not items:
        return
    everything = {w: i for i, w in enumerate(sorted({w for x in items for w in x.words}))}
    whole, seen, n, passages = _passages(docs, everything, text_col)
    # Smoothed, never 0: a passage that many documents hold must not lose its words.
    idf = (np.log((2 + n) / (1 + seen)) + 0.05).astype(np.float32)
    for block in _blocks(items, max(1, RANK * 4 // 5)):
        vocabulary = {w: i for i, w in enumerate(sorted({w for x in block for w in x.words}))}
        own = np.full(len(everything), -1, np.int32)
        own[[everything[w] for w in vocabulary]] = np.arange(len(vocabulary))
        yield _index_of(block, vocabulary, idf, whole, passages, own, seed)


def _parts(words: list | np.ndarray) -> list:
    last = max(0, len(words) - PART)
    return [words[a:a + PART] for a in [*range(0, last, PART // 2), last]]


def _blocks(items: list[Item], parts: int) -> Iterator[list[Item]]:
    """Runs of items of at most ``parts`` parts; an item that has more is alone."""
    block, size = [], 0
    for x in items:
        n = len(_parts(x.words))
        if block and size + n > parts:
            yield block
            block, size = [], 0
        block.append(x)
        size += n
    if block:
        yield block


def _index_of(items: list[Item], vocabulary: dict[bytes, int], idf: np.ndarray, whole: DataFrame, passages: int, own: np.ndarray, seed: int) -> Index:
    everything, idf = idf, idf[own >= 0]
    as_terms = [np.array([vocabulary[w] for w in x.words], np.int32) for x in items]
    parts = [_parts(x) for x in as_terms]
    rows = [_row(x, idf) for some in parts for x in some]
    at, w = [a for a, _ in rows], [x for _, x in rows]
    basis = _widened(_fit_basis(whole, passages, at, w, own, seed, everything), at, w)
    latent = _rows_times(at, w, basis)
    latent /= np.sqrt((latent ** 2).sum(1, keepdims=True))
    content = [x[idf[x] >= 0.5 * idf[x].mean()].tolist() for x in as_terms]
    answers = [[t for t in (vocabulary[w] for w in x.answer) if t in set(c)] for x, c in zip(items, content)]
    basis, latent = (basis * idf[:, None]).astype(np.float32), latent.astype(np.float32)
    if len(latent) <= basis.shape[1]:  # the product of both is no larger
        basis, latent = np.ascontiguousarray(basis @ latent.T), None
    least = np.array([HELD * float((idf[x] ** 2).sum()) * min(1, 2 * STRIDE / len(x)) for some in parts for x in some], np.float32)
    heads = np.cumsum([0, *map(len, parts)])[:-1]
    return Index([x.item_id for x in items], vocabulary, idf, basis, latent, least, heads, content, answers, [len(x) for x in as_terms])


def indexes(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Iterator[Index]:
    """Indexes of the benchmark, collected by about ITEMS items, so that what one search holds does not grow with the benchmark."""
    asked = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    blocks = -(-asked.count() // ITEMS)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield from build_indexes(docs, [item_of(r.item_id, r.text) for r in sorted(part, key=lambda r: (str(r.item_id), r.text))], id_col, text_col)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for every document row and benchmark item that it holds.

    Returns the id, item_id, ``cosine``, ``lcs_share``, ``answer_found`` and ``first_word`` (of the passage). The cosine is of the TF-IDF vectors over the items'
    words, in the latent space, at most 1. Item ids are of any type that Arrow has, null too. Null and
    empty texts and items hold nothing; repeated rows and items are reported each; a null id stays null; an
    empty benchmark or table gives no rows; other columns are not read. Documents are searched whole.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType),
                           T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("answer_found", T.BooleanType()), T.StructField("first_word", T.LongType())])
    item_type = to_arrow_type(schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for some in batched(indexes(docs, benchmark, id_col, text_col, item_col, item_text_col), TOGETHER):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in _slices(batches):
                texts = [words_of(text) for text in batch.column(1).to_pylist()]
                hits = [hit for index in own for hit in index.search_all(texts)]
                if hits:
                    rows, items, cosine, share, answer, first = zip(*hits)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items, item_type), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()),
                                                      pa.array(answer, pa.bool_()), pa.array(first, pa.int64())], names=schema.names)

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, that hold no item; the search runs in the scan's tasks."""
    at, out = docs.columns.index(text_col), docs
    for some in batched(indexes(docs, benchmark, id_col, text_col, item_col, item_text_col), TOGETHER):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in _slices(batches):
                texts = [words_of(text) for text in batch.column(at).to_pylist()]
                hit = {text for index in own for text, *_ in index.search_all(texts)}
                yield batch.filter(pa.array([text not in hit for text in range(len(texts))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
