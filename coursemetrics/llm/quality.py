"""Quality rules: base counts of a text, and line labels by a linear-chain conditional random field.

Every line has a set of features; a two-label chain (boilerplate, content) trained on lines of labelled
documents is decoded by Viterbi, and the share of a text's words that stand in content lines decides
whether the text stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Feature groups of a line and their number of values; the id of a feature is its group's start plus the value.
GROUPS = {"words": 5, "symbols": 6, "upper": 5, "digits": 4, "end": 3, "marks": 4, "seen": 2, "unique": 5, "letters": 5, "length": 5}
START = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()])))
N_FEATURES = sum(GROUPS.values())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes: the six white characters of ASCII only
    chars = len(text) - sum(map(text.count, WHITE))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeated += 1
        elif line.encode().split():
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), repeated, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) ** 3 >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, of, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[of] > 1
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k:n + k] |= again
    return int(covered.sum())


def _step(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x > c for c in cuts)


def _distinct_share(words: list[str], block: int = 50) -> float:
    """Share of distinct words, by blocks, so that a long line isn't taken for a repetitive one."""
    return sum(len(set(words[i:i + block])) for i in range(0, len(words), block)) / max(1, len(words))


def line_features(text: str | None) -> tuple[list[list[int]], list[int]]:
    """Feature ids and number of words of every line that has a word."""
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen: set[str] = set()
    out, sizes = [], []
    for line in lines:
        words = line.split()
        n, size = max(1, len(words)), len(line)
        letters = sum(map(str.isalpha, line)) if size < 32 else size - sum(map(line.count, " .,!?;:|#*$%&<>-_=+/()[]\"'0123456789"))
        upper = 0 if line.islower() else sum(map(str.isupper, words))
        marks = line.count("!!") + line.count("??")
        symbols = sum(map(line.count, SYMBOLS))
        digits = sum(map(line.count, "0123456789"))
        last = line.rstrip()[-1:]
        values = (_step(n, (1, 3, 7, 15)), _step(symbols / n, (0, 0.05, 0.2, 0.5, 1.5)), _step(upper / n, (0, 0.2, 0.5, 0.8)),
                  _step(digits / size, (0, 0.03, 0.2)), 0 if last in ".!?…。" else 1 if last.isalnum() else 2, _step(marks / n, (0, 0.1, 0.5)),
                  int(line in seen), _step(_distinct_share(words), (0.3, 0.5, 0.7, 0.9)), _step(letters / size, (0.4, 0.6, 0.75, 0.85)),
                  _step(size / n, (3, 6, 9, 14)))
        seen.add(line)
        out.append([s + v for s, v in zip(START.values(), values)])
        sizes.append(len(line.encode().split()))
    return out, sizes


@dataclass
class Chain:
    """Weights of the chain: ``emit`` feature by label, ``move`` label by next label; label 1 is content."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """Viterbi; ties go to content."""
        if not features:
            return []
        scores = self.emit[np.array(features)].sum(1).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        (a, b), back = scores[0], []
        for e0, e1 in scores[1:]:
            from0, from1 = int(b + m10 >= a + m00), int(b + m11 >= a + m01)
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + e0, (b + m11 if from1 else a + m01) + e1
        label = [int(b >= a)]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]

    def content_share(self, text: str | None) -> tuple[float, int, int]:
        """Share of words in content lines, number of content lines and of lines with a word; (0, 0, 0) without one."""
        features, sizes = line_features(text)
        labels = self.decode(features)
        total = sum(sizes)
        return (sum(s for s, x in zip(sizes, labels) if x) / total if total else 0.0), sum(labels), len(labels)


def train_chain(documents: list[list[list[int]]], good: list[int], rounds: int = 200, ridge: float = 2.0, rate: float = 0.15,
                move_ridge: float = 0.05) -> Chain:
    """Maximum likelihood in numpy from documents' lines and labels.

    Lines start with the label of their document. A chain without moves is fitted first; lines that it is sure
    of against their document's label (a clean line in a bad document) are relabelled, then the chain is fitted.
    """
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    documents, good = [documents[i] for i in order], np.array([good[i] for i in order])
    sizes = np.array([len(d) for d in documents])
    flat = np.array([f for d in documents for f in d], np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    label = good[of].astype(np.int64)
    # Documents of either kind weigh the same in all.
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    width = [int((sizes > t).sum()) for t in range(sizes.max())]

    def gradient(emit: np.ndarray, move: np.ndarray, chained: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = emit[flat].sum(1)
        if not chained:
            p = np.exp(score - np.logaddexp(score[:, 0], score[:, 1])[:, None])
            pairs = np.zeros((2, 2))
        else:
            forward, backward = np.empty_like(score), np.zeros_like(score)
            forward[starts] = score[starts]
            for t in range(1, len(width)):
                at = starts[:width[t]] + t
                x = forward[at - 1][:, :, None] + move
                forward[at] = np.logaddexp(x[:, 0], x[:, 1]) + score[at]
            for t in range(len(width) - 1, 0, -1):
                at = starts[:width[t]] + t
                x = move + (score[at] + backward[at])[:, None, :]
                backward[at - 1] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            both = forward + backward
            total = np.logaddexp(both[:, 0], both[:, 1])
            p = np.exp(both - total[:, None])
            later = np.setdiff1d(np.arange(len(of)), starts)
            joint = np.exp(forward[later - 1][:, :, None] + move + (score[later] + backward[later])[:, None, :] - total[later][:, None, None])
            pairs = -(joint * weight[later][:, None, None]).sum(0)
            np.add.at(pairs, (label[later - 1], label[later]), weight[later])
        error = (np.eye(2)[label] - p) * weight[:, None]
        by = np.zeros((N_FEATURES, 2))
        for k in range(flat.shape[1]):
            for c in (0, 1):
                by[:, c] += np.bincount(flat[:, k], error[:, c], N_FEATURES)
        # Lines start with their document's label, which never moves; a heavy prior keeps moves possible.
        return by - ridge * emit, pairs - move_ridge * len(label) * move, p

    def climb(chained: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, m, v = np.zeros((N_FEATURES + 2, 2)), 0.0, 0.0
        for t in range(1, rounds + 1):
            emit, move, p = gradient(x[:-2], x[-2:], chained)
            g = np.concatenate([emit, move]) / len(label)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8) * (1 - t / (rounds + 1))
        return x[:-2], x[-2:], p

    _, _, sure = climb(False)
    label = np.where(sure[:, 1] > 0.8, 1, np.where(sure[:, 1] < 0.2, 0, label))
    emit, move, _ = climb(True)
    return Chain(emit, move)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 1500, max_lines: int = 2000,
        id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Train the chain on at most ``sample_rows`` labelled documents of each label, those of the smallest id hash.

    Documents of more than ``max_lines`` lines do not serve as training rows, so the lines that reach the
    driver are bounded. Without documents of both labels every line is content.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), F.xxhash64(id_col).alias("_hash"))
    ids = [known.where(F.col("_label") == v).orderBy("_hash", "_id").limit(sample_rows).select("_id", "_label") for v in (0, 1)]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(y, line_features(t)[0]) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(y, np.array(x, np.uint8).tobytes()) for y, x in rows if 0 < len(x) <= max_lines]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["label", "x"])

    # The ids are bounded by twice sample_rows.
    picked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids[0].unionByName(ids[1])), "_id")
              .select("_label", "_text").mapInArrow(lines, "label int, x binary"))
    rows = sorted((r.label, bytes(r.x)) for r in stored(picked, "quality-sample").limit(4 * sample_rows).collect())
    if len({y for y, _ in rows}) < 2:
        return Chain(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    return train_chain([np.frombuffer(x, np.uint8).reshape(-1, len(GROUPS)).tolist() for _, x in rows], [y for y, _ in rows])


def assess(docs: DataFrame, chain: Chain, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base verdict, content share and verdict of every whole text.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_content_lines, content_share and kept (not base_failed and a share of ``min_share`` or more). One row per
    input row, repeated rows included; null and empty texts have no word and fail; a null id stays null;
    other columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), 5)
            shares = [chain.content_share(t) for t in texts]
            share = np.array([s for s, _, _ in shares], np.float64)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array([n for _, _, n in shares], pa.int64()),
                 pa.array([n for _, n, _ in shares], pa.int64()), pa.array(share), pa.array(~failed & (share >= min_share))],
                names=[id_col, *names, "base_failed", "n_lines", "n_content_lines", "content_share", "kept"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in names),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("n_lines", T.LongType()), T.StructField("n_content_lines", T.LongType()),
                           T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
