"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Texts are folded first: compatibility forms, lower case, look-alike letters of other scripts, digits and
signs that stand for letters inside words; everything that is no letter becomes one space. The lexicon
holds words and word beginnings with a weight (log-odds between toxic and other training rows);
phrases that hold a lexicon entry but are found in clean rows are exceptions and silence it. A word counts
with its heaviest entry. The sum, normalised by the number of words, and the sum itself go through a
logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import stored

# Letters that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ı": "i",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
})
# Digits and signs written for letters.
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"})
FOREIGN = re.compile("[ɑıɡα-ωа-ԝ]")
CODED = re.compile(r"(?<![\w@$])[\w@$]*[0-9@$][\w@$]*")
HIDDEN = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
NO_LETTER = re.compile(r"[\W\d_]+")

PREFIXES = range(4, 9)
MIN_ROWS = 4
MIN_WEIGHT = 2.5
CHANCE_ENTRIES = 8  # so many of the terms tried may look toxic by chance


def _decode(match: re.Match) -> str:
    token = match[0].rstrip("@$")
    letters = sum(map(str.isalpha, token))
    return token.translate(DIGITS) if letters >= 2 and 2 * letters >= len(token) else token


def fold(text: str | None) -> str:
    """Folded words, one space before, between and after them."""
    if not text:
        return " "
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if FOREIGN.search(text):
        text = text.translate(LOOKALIKES)
    return " " + NO_LETTER.sub(" ", CODED.sub(_decode, text)).strip() + " "


@dataclass
class Lexicon:
    """``stems`` match a word's beginning, ``words`` whole words; ``exceptions`` are phrases of folded words."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.5)  # at: constant, normalised sum, sum

    def machine(self) -> ahocorasick.Automaton | None:
        entries = {f" {k}": (w, len(k)) for k, w in self.stems.items()} | {f" {k} ": (w, len(k) + 1) for k, w in self.words.items()}
        entries |= {f" {fold(k).strip()} ": (-1.0, len(fold(k).strip()) + 1) for k in self.exceptions}
        if not entries:
            return None
        made = ahocorasick.Automaton()
        for k, v in entries.items():
            made.add_word(k, v)
        made.make_automaton()
        return made


def hits(folded: str, machine: ahocorasick.Automaton | None) -> dict[int, float]:
    """Weight of the heaviest entry of each word that has one, by the place of the space before the word."""
    found: dict[int, float] = {}
    silent: list[tuple[int, int]] = []
    for end, (weight, back) in machine.iter(folded) if machine else ():
        at = end - back
        if weight < 0:
            silent.append((at, end))
        elif weight > found.get(at, 0):
            found[at] = weight
    return {k: w for k, w in found.items() if not any(a <= k < b for a, b in silent)} if silent else found


def strength(folded: str, machine: ahocorasick.Automaton | None) -> tuple[float, float]:
    """(sum of weights by 100 words, sum of weights), both on a logarithmic scale."""
    total = sum(hits(folded, machine).values()) if machine else 0.0
    words = max(1, folded.count(" ") - 1)
    return math.log1p(100 * total / words), math.log1p(total)


def probability(x: tuple[float, float], curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def copy_mark(text: str | None, size: int = 5) -> int:
    """The smallest hash of five words in a row: the same for copies with few changes, hardly for other texts."""
    words = (text or "").encode().lower().split()
    runs = (b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))
    return min(xxhash.xxh64_intdigest(r, 7) for r in runs) - (1 << 63)


def terms(folded: str) -> set[str]:
    """Words (with a space after) and word beginnings of a folded text."""
    words = set(folded.split())
    return {f"{w} " for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def _evidence(toxic: int, clean: int, toxic_rows: int, clean_rows: int) -> float:
    """Log-likelihood gained by letting a term's share among its rows differ from the toxic share of all rows; 0 if it is lower."""
    n, share = toxic + clean, toxic_rows / (toxic_rows + clean_rows)
    if toxic <= n * share:
        return 0.0
    return toxic * math.log(toxic / (n * share)) + (clean * math.log(clean / (n * (1 - share))) if clean else 0.0)


def _longest(term: str, rows: dict[str, int], share: float = 0.9) -> str:
    """The longest beginning that stands for nearly all rows of ``term``, so that fewer other words begin with it."""
    while term[-1] != " ":
        longer = max((t for t in rows if len(t) == len(term) + 1 and t[-1] != " " and t.startswith(term)), key=rows.get, default=None)
        if longer is None or rows[longer] < share * rows[term]:
            break
        term = longer
    return term


def _sample(labelled: DataFrame, label_col: str, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` ids of each label, those of the smallest hash."""
    keyed = labelled.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.xxhash64(id_col).alias("_hash"))
    parts = [keyed.where(F.col("_label") == v).orderBy("_hash", "_id").limit(rows) for v in (0, 1)]
    return parts[0].unionByName(parts[1]).select("_id", F.col("_label").cast("int").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "toxic", sample_rows: int = 4000,
        id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn lexicon, exceptions and curve from labelled rows for which ``training`` holds.

    ``sample_rows`` bounds the training rows of each label; that is the only bounded part (every entry and exception
    that has the evidence is kept, so the lexicon grows with the training rows). Of copies one teaches. Rows with a null id,
    null label or no text teach nothing; without rows of both labels the lexicon is empty.
    """
    known = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, label_col)
    counts = {int(r[0]): r[1] for r in known.groupBy(label_col).count().collect()}
    if len(counts) < 2:
        return Lexicon()
    ids = _sample(known, label_col, id_col, sample_rows)
    # The ids are bounded by twice sample_rows.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id").select("_label", "_text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([copy_mark(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["_label", "_text", "_mark"])

    # Copies of a text, changed ones too, teach once: else the words of a text with many copies would look toxic.
    first = F.row_number().over(Window.partitionBy("_label", "_mark").orderBy(F.xxhash64("_text"), "_text"))
    picked = stored(sample.mapInArrow(marked, "_label int, _text string, _mark long").withColumn("_n", first).where("_n = 1").select("_label", "_text"), "toxic-sample")
    rows = {int(r[0]): r[1] for r in picked.groupBy("_label").count().collect()}
    if len(rows) < 2:
        return Lexicon()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter[str], Counter[str]] = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[label].update(terms(fold(text)))
            for label, own in enumerate(found):
                if own:
                    n, none = pa.array(list(own.values()), pa.int64()), pa.array([0] * len(own), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(list(own)), n if label else none, none if label else n], names=["term", "toxic", "clean"])

    tried = stored(picked.mapInArrow(counted, "term string, toxic long, clean long").groupBy("term")
                   .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= MIN_ROWS), "toxic-terms")
    # The more terms are tried, the more evidence one needs not to be there by chance.
    least = math.log(max(1, tried.count()) / CHANCE_ENTRIES)
    n, share = F.col("toxic") + F.col("clean"), rows[1] / (rows[1] + rows[0])
    gained = F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0)
    gained = F.when(F.col("toxic") <= n * share, 0.0).otherwise(gained)
    # Only terms with evidence reach the driver; they are tested again there, as the two logarithms differ in the last place.
    passed = [r for r in tried.where(gained >= least - 1e-6).collect() if _evidence(r.toxic, r.clean, rows[1], rows[0]) >= least]
    toxic, clean = {r.term: r.toxic for r in passed}, {r.term: r.clean for r in passed}
    weights = {t: math.log((n + 0.5) / (rows[1] + 1)) - math.log((clean.get(t, 0) + 0.5) / (rows[0] + 1)) for t, n in toxic.items()}
    chosen: dict[str, float] = {}
    for t in sorted(weights, key=lambda t: (len(t), t)):
        shorter = max((chosen[t[:n]] for n in PREFIXES if n < len(t) and t[:n] in chosen), default=-9.0)
        if weights[t] >= MIN_WEIGHT and weights[t] > shorter + 0.7:
            chosen[t] = weights[t]
    chosen = {_longest(t, toxic): w for t, w in chosen.items()}
    lexicon = Lexicon({t: round(w, 6) for t, w in chosen.items() if t[-1] != " "}, {t[:-1]: round(w, 6) for t, w in chosen.items() if t[-1] == " "})
    lexicon.exceptions = _exceptions(picked, lexicon)
    machine_of = lexicon.machine

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of()
        for batch in batches:
            x = [strength(fold(t), machine) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())],
                                             names=["label", "a", "b"])

    # One pair of numbers a training row, so bounded by the sample.
    seen = picked.mapInArrow(measured, "label int, a double, b double").toPandas().sort_values(["label", "a", "b"])
    share = {k: counts[k] / rows[k] for k in rows}
    lexicon.curve = _logistic(seen[["a", "b"]].to_numpy(), seen["label"].to_numpy(), np.array([share[x] for x in seen["label"]]))
    return lexicon


def _exceptions(picked: DataFrame, lexicon: Lexicon, least: int = 3) -> list[str]:
    """Phrases of one or two words that hold an entry and are found in clean training rows, hardly in toxic ones."""
    machine_of = lexicon.machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of()
        for batch in batches:
            found: Counter[tuple[str, int]] = Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, own = fold(text), set()
                for at in hits(folded, machine):
                    before = folded[max(0, at - 60):at].split()[-1:] if folded[at - 1:at] else []
                    after = folded[at + 1:at + 121].split()[:2]
                    own |= {after[0], " ".join(after), " ".join([*before, after[0]])}
                found.update((x, label) for x in own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found], pa.int32()),
                                                  pa.array(list(found.values()), pa.int64())], names=["phrase", "label", "n"])

    told = (picked.mapInArrow(run, "phrase string, label int, n long").groupBy("phrase")
            .agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
                 F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
            .where((F.col("clean") >= least) & (F.col("clean") > 3 * F.col("toxic"))))
    return sorted(r.phrase for r in stored(told.select("phrase"), "toxic-exceptions").collect())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float, float]:
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    weight = weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge * np.diag([1e-6, 1, 1]),
                               a.T @ (weight * (y - p)) - ridge * w * [1e-6, 1, 1])
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return tuple(float(round(v, 8)) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text: id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    One row per input row, repeated rows included; null, empty and letterless texts get the score of a text
    without a hit; a null id stays null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.machine()
        for batch in batches:
            got = [probability(strength(fold(t), machine), lexicon.curve) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array([int(x >= threshold) for x in got], pa.int32())],
                                             names=[id_col, "score", "predicted"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_civil(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores below ``threshold``; the test runs in the scan's tasks."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.machine()
        for batch in batches:
            civil = [probability(strength(fold(t), machine), lexicon.curve) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(civil, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
