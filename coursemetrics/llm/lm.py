"""Masked pseudo-likelihood: a bidirectional window network scores documents.

Every token of a text is hidden once and predicted from the tokens on both sides of it; the sum of these
conditional log-probabilities is the document's score. The network is a window network in numpy: each place
of the window has its own embedding table into the hidden layer, and the output is a class and a word
within the class, so a token costs two small products.

All words of all documents are counted into a table, which grows with the corpus and stays on the executors. The
most frequent ones are predicted as themselves; every other word by the network's probability of its hash class times
the word's counted share of that class, so each word has a probability of its own. Texts are turned into ids once, into a
written table that training and scoring read. Training is data-parallel: in every round each task trains a copy of the
network on the round's part of the places of every one of its texts, and Spark averages the copies, weighted by their examples,
before the next round (so the split of the table into tasks has a small effect on the network). Together the rounds take every place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import stored

CLASSES, MEMBERS = 32, 64  # the last class holds words outside the vocabulary, by hash
HIDDEN = 24
SIDE = 2  # tokens on either side
BATCH = 1024
RATE = 0.15
STEP = 2048  # places that are scored at once, so that their values stay in a core's cache
GROUP = 1 << 20  # tokens that are scored at once
FLOATS = 1 << 14  # parameters in one exchanged row
SLOTS = 64
MAX_COUNTED = 400_000
WORDS = (CLASSES - 1) * MEMBERS
EDGE = CLASSES * MEMBERS
TEXTS = 512  # whose tokens are held at once
LAYERS = 12  # occurrences of a row that are added one by one
LONG = 64  # bytes of a word whose hash is taken with all others'
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def token_array(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """``tokens_of`` all texts, one after the other, and how many each text has."""
    own = [(text or "").lower().encode() for text in texts]
    data = np.frombuffer(b"\n".join([*own, b""]), np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # a token begins, ends, begins, ends; each text ends with a space
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
    return tokens, np.diff(np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in own])))


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def crc32_of(words: pa.Array) -> np.ndarray:
    """``zlib.crc32`` of each of a large_binary array, all words' first bytes at once, then all second ones."""
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    sizes, data = np.diff(starts), np.frombuffer(data or b"", np.uint8)
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    longer = np.searchsorted(-sizes[order].clip(max=LONG + 1), -np.arange(LONG + 1))  # how many words have more than k bytes
    at, crc = starts[:-1][order], np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k, n in enumerate(longer[:LONG].tolist()):
        if not n:
            break
        now = crc[:n]
        crc[:n] = CRC[(now ^ data[at[:n] + k]) & 0xFF] ^ (now >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[:longer[LONG]].tolist():
        out[i] = zlib.crc32(data[starts[i]:starts[i + 1]])
    return out.astype(np.int64)


class Vocabulary(dict):
    """Word to id; words outside it get one of MEMBERS ids by hash, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        i = WORDS + zlib.crc32(word) % MEMBERS
        if len(self) < MAX_COUNTED:
            self[word] = i
        return i


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` of all documents, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                words = token_array(batch.column(0).slice(k, TEXTS).to_pylist())[0].dictionary_encode()
                found.append(told(words.dictionary, np.bincount(words.indices, minlength=len(words.dictionary))))
                held += len(words.dictionary)
                if held > 2 * MAX_COUNTED:
                    found = added(found)
                    held = sum(x.num_rows for x in found)
                    if held > MAX_COUNTED:
                        yield from found
                        found, held = [], 0
        yield from added(found)

    def told(words: pa.Array, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    def added(found: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if len(found) < 2:
            return found
        both = pa.Table.from_batches(found).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        return [pa.RecordBatch.from_arrays([both["word"].combine_chunks(), both["n_sum"].combine_chunks()], names=["word", "n"])]

    counts = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts, "lm-words")


def head_words(counts: DataFrame) -> list[bytes]:
    """The most frequent words, by count, then by bytes: as many whole steps of a logarithmic scale of counts as hold WORDS at most.

    The cut comes from a histogram, so no task meets the words of all others.
    """
    step = F.floor(F.log2("n") * 64)
    cut, held = None, 0
    # One row for each step: at most 64 for each bit of a count.
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        held += r.words
        if held > WORDS:
            break
        cut = r.step
    best = counts.where(step >= cut).collect() if cut is not None else []
    return [bytes(r.word) for r in sorted(best, key=lambda r: (-r.n, bytes(r.word)))]


def vocabulary(docs: DataFrame, text_col: str) -> list[bytes]:
    return head_words(word_counts(docs, text_col))


@dataclass
class Network:
    tables: np.ndarray  # place in the window, id, hidden
    bias: np.ndarray
    classes: np.ndarray  # hidden and a constant, class
    members: np.ndarray  # class, hidden and a constant, member

    @staticmethod
    def fresh(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Network(f(2 * SIDE, EDGE + 1, HIDDEN), np.zeros(HIDDEN, np.float32), f(HIDDEN + 1, CLASSES), f(CLASSES, HIDDEN + 1, MEMBERS))

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.classes, self.members]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def with_flat(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for x in self.parts():
            out.append(values[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        """windows: ids of the neighbours, a row for each place. The last column is the constant."""
        return self._hidden(windows + TABLE_OF[:, None])

    def _hidden(self, rows: np.ndarray) -> np.ndarray:
        """``hidden`` from rows of the tables, where they are one. tanh by one exp, which is half the work."""
        tables = self.tables.reshape(-1, self.tables.shape[2])
        near = np.take(tables, rows[0], axis=0)
        more = np.empty_like(near)
        for own in rows[1:]:
            near += np.take(tables, own, axis=0, out=more, mode="clip")
        near += self.bias
        near *= 2
        with np.errstate(over="ignore"):  # 1 / inf is right
            np.exp(near, out=near)
        near += 1
        np.divide(-2, near, out=near)
        near += 1
        out = np.ones((len(near), near.shape[1] + 1), near.dtype)
        out[:, :-1] = near
        return out

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(id | both sides) of the places ``at`` of a row of ids with SIDE edges around every text. Places are taken class by class."""
        order = by_class(ids[at])
        place = at[order]
        cuts, m = class_cuts(ids[place])
        got = np.empty(len(at), np.float32)
        for j in np.flatnonzero(np.diff(cuts)):
            for a in range(cuts[j], cuts[j + 1], STEP):
                own = slice(a, min(a + STEP, cuts[j + 1]))
                h = self.hidden(ids[place[own] + OFFSETS[:, None]])
                z, inside = h @ self.classes, h @ self.members[j]
                right = z[:, j] + inside[np.arange(len(h)), m[own]]
                got[own] = right - _log_sum(z) - _log_sum(inside)
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradient(self, windows: np.ndarray, target: np.ndarray) -> tuple[list, float]:
        """Gradients of the summed log-probability: (tables by place, bias, classes, members by class), and the sum."""
        order = by_class(target)
        (sorted_back, to_bias, to_classes, (touched, to_members)), total = self._gradient((windows + TABLE_OF[:, None])[:, order], target[order])
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
        return [back, to_bias, to_classes, list(zip(touched.tolist(), to_members))], total

    def _gradient(self, rows: np.ndarray, target: np.ndarray) -> tuple[list, float]:
        """``gradient`` from rows of the tables, with the classes that occur and their gradients as two arrays. Examples are sorted by class, so
        a class is a slice; only the products go class by class, and the softmax is of all members' values at once."""
        cuts, m = class_cuts(target)
        touched = np.flatnonzero(np.diff(cuts))
        edges, c = cuts.tolist(), target // MEMBERS
        slices = [(j, slice(edges[j], edges[j + 1])) for j in touched.tolist()]
        h = self._hidden(rows)
        error, total = _error(h @ self.classes, c)
        to_classes, back = h.T @ error, error @ self.classes[:-1].T
        z, more, to_members = np.empty((len(h), MEMBERS), h.dtype), np.empty_like(back), np.empty((len(slices), h.shape[1], MEMBERS), h.dtype)
        for j, own in slices:
            np.dot(h[own], self.members[j], z[own])
        error, inside = _error(z, m)
        for k, (j, own) in enumerate(slices):
            part = error[own]
            np.dot(h[own].T, part, to_members[k])
            np.dot(part, self.members[j, :-1].T, more[own])
        back += more
        np.multiply(h[:, :-1], h[:, :-1], out=more)
        back *= np.subtract(1, more, out=more)
        return [back, np.ones(len(back), back.dtype) @ back, to_classes, (touched, to_members)], total + inside


OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
TABLE_OF = np.arange(2 * SIDE) * (EDGE + 1)  # first row of each place, where the tables are one


def by_class(target: np.ndarray) -> np.ndarray:
    """The order of the classes, in which each keeps its own."""
    return np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")


def class_cuts(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each class begins in targets that are sorted by class, and each one's member."""
    return np.searchsorted(target // MEMBERS, np.arange(CLASSES + 1, dtype=target.dtype)), target % MEMBERS


def _error(z: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient by ``z`` of the summed log-probability of the ``right`` columns, written into ``z``, and the sum. Rows are shifted only if a
    value could overflow."""
    if z.size and z.max() > 80:
        z -= z.max(1)[:, None]
    at, flat = np.arange(0, z.size, z.shape[1]) + right, z.reshape(-1)
    chosen = flat[at]
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    z *= (-1 / sums)[:, None]
    flat[at] += 1
    return z, float((chosen - np.log(sums)).sum())


def _log_sum(z: np.ndarray) -> np.ndarray:
    """log of the summed exp of each row, in the place of ``z``; rows are shifted only if a value could overflow."""
    top = 0
    if z.size and z.max() > 80:
        top = z.max(1)
        z -= top[:, None]
    return top + np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


class Trainer:
    """Adagrad on a copy of a network."""

    def __init__(self, network: Network):
        self.net, self.examples = network.with_flat(network.flat()), 0
        self.squares = [np.full(x.shape, 1e-2, np.float32) for x in self.net.parts()]

    def step(self, windows: np.ndarray, target: np.ndarray) -> float:
        order = by_class(target)
        rows = np.take(windows.T, order, axis=0) + TABLE_OF
        (back, to_bias, to_classes, (touched, to_members)), total = self.net._gradient(rows.T, target[order])
        scale, net = np.float32(1 / len(target)), self.net
        heads, sums = summed(rows, back)
        for g in (sums, to_bias, to_classes, to_members):
            g *= scale
        _move_rows(net.tables.reshape(-1, HIDDEN), self.squares[0].reshape(-1, HIDDEN), heads, sums)
        self._move(net.bias, self.squares[1], to_bias)
        self._move(net.classes, self.squares[2], to_classes)
        if len(touched) == CLASSES:
            self._move(net.members, self.squares[3], to_members)
        else:
            _move_rows(net.members.reshape(CLASSES, -1), self.squares[3].reshape(CLASSES, -1), touched, to_members.reshape(len(touched), -1))
        self.examples += len(target)
        return total

    @staticmethod
    def _move(x: np.ndarray, square: np.ndarray, g: np.ndarray) -> None:
        root = g * g
        square += root
        g *= RATE
        g /= np.sqrt(square, out=root)
        x += g


def summed(rows: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the tables that occur, each once, and the sum of each one's ``back``, which has a row for each row of ``rows``."""
    ids = rows.ravel().astype(np.uint16)  # small ids are sorted by their digits
    order = np.argsort(ids, kind="stable")
    ids, example = np.take(ids, order), order // rows.shape[1]
    new = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
    edges = np.flatnonzero(new)
    heads, times = edges[:-1], np.diff(edges)
    sums = np.take(back, example[heads], axis=0)
    # Most occur once. Of the others, the most frequent first, all second occurrences are added at once, then all third ones.
    many = np.flatnonzero(times > 1)
    many = many[np.argsort(-times[many], kind="stable")]
    first, left, total = heads[many], times[many], np.take(sums, many, axis=0)
    for k, n in enumerate(np.searchsorted(-left, -np.arange(1, LAYERS)).tolist(), 1):
        if n:
            total[:n] += np.take(back, example[first[:n] + k], axis=0)
    n = int(np.searchsorted(-left, -LAYERS))
    if n:  # Two values as one complex number: the same sums in half the steps.
        more = left[:n] - LAYERS
        starts = np.cumsum(more) - more
        rest = np.repeat(first[:n] + LAYERS - starts, more) + np.arange(more.sum())
        total[:n] += np.add.reduceat(np.take(back, example[rest], axis=0).view(np.complex64), starts).view(np.float32)
    sums[many] = total
    return ids[heads].astype(np.intp), sums


def _move_rows(x: np.ndarray, square: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """One step of some rows, none of them twice. A row is written as one value."""
    now, whole = g * g, f"V{x.strides[0]}"
    now += np.take(square, at, axis=0)
    np.put(square.view(whole), at, now.view(whole), mode="clip")
    g *= RATE
    g /= np.sqrt(now, out=now)
    g += np.take(x, at, axis=0)
    np.put(x.view(whole), at, g.view(whole), mode="clip")


def grouped(rows: list[np.ndarray], limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, ids with SIDE edges between texts, place of the first token of each text) of groups of texts."""
    first, starts, size = 0, [], SIDE
    for i, own in enumerate(rows):
        starts.append(size)
        size += len(own) + SIDE
        if size >= limit or i == len(rows) - 1:
            ids = np.full(size, EDGE, np.uint16)  # places are read in another order
            for s, x in zip(starts, rows[first:i + 1]):
                ids[s:s + len(x)] = x
            yield first, i + 1, ids, np.array(starts)
            first, starts, size = i + 1, [], SIDE


def ids_of(tokens: list[bytes], words: Vocabulary) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, tokens), "<u2", len(tokens))


def rows_of_ids(texts: list[str | None], words: Vocabulary, limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return grouped([ids_of(tokens_of(text), words) for text in texts], limit)


@dataclass
class Model:
    words: list[bytes]
    network: Network | None
    counts: DataFrame | None = None  # word, n of the corpus
    shared: tuple[int, ...] = (0,) * MEMBERS  # tokens of each hash class in the corpus

    def vocabulary(self) -> Vocabulary:
        """One for all tasks of a worker, which keeps the broadcast model."""
        if getattr(self, "_vocabulary", None) is None:
            self._vocabulary = Vocabulary((w, i) for i, w in enumerate(self.words))
        return self._vocabulary


def counted(docs: DataFrame, text_col: str = "text") -> Model:
    """A model without a network: words, their counts, and the tokens of each hash class."""
    counts = word_counts(docs, text_col)
    words = head_words(counts)
    # Neither list grows with the corpus: at most WORDS words, MEMBERS classes.
    known = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
    classes = counts.join(F.broadcast(known), "word", "left_anti").groupBy((F.crc32("word") % MEMBERS).alias("c")).agg(F.sum("n").alias("n")).collect()
    shared = [0] * MEMBERS
    for r in classes:
        shared[r.c] = r.n
    return Model(words, None, counts, tuple(shared))


def encode(docs: DataFrame, words: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written row for every text: ``row``, ``id``, ``ids`` (two bytes a token), and its words outside ``words`` with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        for whole in batches:
            for k in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(k, TEXTS)
                tokens, sizes = token_array(batch.column(1).to_pylist())
                ids = pc.fill_null(pc.index_in(tokens, value_set=known), EDGE).to_numpy().astype("<u2")
                at = np.flatnonzero(ids == EDGE)
                rare = tokens.take(pa.array(at)).dictionary_encode()
                own, n = rare.indices.to_numpy().astype(np.int64), max(1, len(rare.dictionary))
                ids[at] = (WORDS + crc32_of(rare.dictionary) % MEMBERS)[own]
                keys, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * n + own, return_counts=True)
                text, word = np.divmod(keys, n)
                heads = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
                edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                                                  pa.ListArray.from_arrays(heads, rare.dictionary.cast(pa.binary()).take(pa.array(word))), pa.ListArray.from_arrays(heads, pa.array(times, pa.int32()))],
                                                 names=["id", "ids", "rare", "times"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    # The number of a row is written with it, so it stays the row's own whatever task is run again.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "lm-ids")


def train(model: Model, encoded: DataFrame, rounds: int = 2, share: float | None = None, seed: int = 1) -> Model:
    """Train on every place of all texts, once: each round takes the places of its part, drawn by the text's hash.

    ``share`` is a round's part of the places, one in ``rounds`` unless given; parts follow each other, so a larger one is seen again.
    """
    share = 1 / rounds if share is None else share
    spark = encoded.sparkSession
    network = Network.fresh(seed)
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            held_windows, held_targets, held = [], [], 0
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for first, end, ids, starts in grouped([np.frombuffer(x, "<u2") for x in texts]):
                    draw = np.full(len(ids), np.nan)  # edges are not drawn
                    for text, a, b in zip(texts[first:end], starts.tolist(), [*(starts[1:] - SIDE).tolist(), len(ids) - SIDE]):
                        if b > a:
                            np.random.Generator(np.random.PCG64([seed, zlib.crc32(text)])).random(out=draw[a:b])
                    draw -= number * share
                    draw -= np.floor(draw)
                    at = np.flatnonzero(draw < share)
                    windows = np.empty((len(at), 2 * SIDE), np.uint16)
                    for k, o in enumerate(OFFSETS.tolist()):
                        windows[:, k] = ids[at + o]
                    held_windows.append(windows)
                    held_targets.append(ids[at])
                    held += len(at)
                    if held >= BATCH:
                        order = np.random.default_rng(held).permutation(held)
                        w, t = np.take(np.concatenate(held_windows), order, axis=0), np.concatenate(held_targets)[order]
                        whole = held - held % BATCH
                        for k in range(0, whole, BATCH):
                            trainer.step(w[k:k + BATCH].T, t[k:k + BATCH])
                        held_windows, held_targets, held = [w[whole:]], [t[whole:]], held - whole
            if held:
                trainer.step(np.concatenate(held_windows).T, np.concatenate(held_targets))
            if trainer.examples:
                values = trainer.net.flat()
                blocks = list(range(0, len(values), FLOATS))
                slot = TaskContext.get().partitionId() % SLOTS
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([slot] * len(blocks), pa.int32()), pa.array([trainer.examples] * len(blocks), pa.int64()),
                                                  pa.array([values[b:b + FLOATS].astype("<f4").tobytes() for b in blocks], pa.binary())], names=["block", "slot", "n", "x"])

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, n = pdf.sort_values(["n", "x"]), int(pdf["n"].sum())
            mean = sum(np.frombuffer(x, "<f4").astype(np.float64) * (k / n) for x, k in zip(pdf["x"], pdf["n"]))
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "slot": [0], "n": [n], "x": [mean.astype("<f4").tobytes()]})

        schema = "block int, slot int, n long, x binary"
        # In two steps, so that no task meets the copies of all others; one network reaches the driver.
        copies = encoded.select("ids").mapInArrow(run, schema).groupBy("block", "slot").applyInPandas(average, schema).groupBy("block").applyInPandas(average, schema)
        got = sorted(copies.collect(), key=lambda r: r.block)
        if got:
            network = network.with_flat(np.concatenate([np.frombuffer(r.x, "<f4") for r in got]))
    return replace(model, network=network)


def fit(docs: DataFrame, rounds: int = 2, share: float | None = None, text_col: str = "text", seed: int = 1) -> Model:
    """Count the words of all documents and train on them."""
    model = counted(docs, text_col)
    return train(model, encode(docs, model.words, text_col, text_col), rounds, share, seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pseudo-log-likelihood of every whole text.

    Returns the id, ``n_tokens``, ``log_probability`` (the sum over all tokens) and ``mean_log_probability`` (null without a
    token). One row per input row, repeated rows included; null and empty texts have no token and the sum 0; a
    null id stays null; other columns are not read. A word that the model's corpus doesn't hold counts as one that it holds once.
    """
    return _scored(encode(docs, model.words, id_col, text_col), model, id_col)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of the documents under a model that is fitted on them; their ids are written once."""
    model = counted(docs, text_col)
    encoded = encode(docs, model.words, id_col, text_col)
    return _scored(encoded, train(model, encoded), id_col)


def _scored(encoded: DataFrame, model: Model, id_col: str) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(model.network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [], []
            for _, _, ids, starts in grouped([np.frombuffer(x, "<u2") for x in batch.column(2).to_pylist()]):
                at = np.flatnonzero(ids != EDGE)
                totals = np.concatenate([[0.0], np.cumsum(shared.value.log_probabilities(ids, at).astype(np.float64))])
                edges = np.searchsorted(at, np.append(starts, len(ids)))
                counts.append(np.diff(edges))
                sums.append(totals[edges[1:]] - totals[edges[:-1]])
            n, total = (np.concatenate(x) if x else np.zeros(0) for x in (counts, sums))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(total)], names=["row", "id", "n", "network"])

    schema = T.StructType([T.StructField("row", T.LongType()), encoded.schema["id"], T.StructField("n", T.LongType()), T.StructField("network", T.DoubleType())])
    by_network = encoded.select("row", "id", "ids").mapInArrow(run, schema)
    rare = encoded.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    inside = F.element_at(F.array(*(F.lit(math.log(n + 1)) for n in model.shared)), (F.crc32("word") % MEMBERS).cast("int") + 1)
    # Whole billionths, whose sum is the same in any order.
    once = F.rint(-inside * 1e9).cast("long")
    if model.counts is not None:
        # Words are the key and each of them is rare, so no key is hot. A word's part is made where it is counted, once; most words are
        # held once, and their part is that of a word that isn't held.
        parts = model.counts.where("n > 1").select("word", F.rint((F.log("n") - inside) * 1e9).cast("long").alias("part"))
        rare = rare.join(parts.hint("shuffle_hash"), "word", "left").withColumn("part", F.coalesce("part", once))
    else:
        rare = rare.withColumn("part", once)
    shares = rare.groupBy("row").agg(F.sum(F.col("part") * F.col("times")).alias("part"))
    total = F.col("network") + F.coalesce(F.col("part"), F.lit(0)) / 1e9
    return (by_network.join(shares, "row", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), total.alias("log_probability"),
                    F.when(F.col("n") > 0, total / F.col("n")).alias("mean_log_probability")))
