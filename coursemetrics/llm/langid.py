"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character n-grams (3 and 4 bytes of folded UTF-8). Each
language has several centroids, found by spherical k-means on a bounded sample of its training rows. The
language of the most similar centroid (cosine) wins; a text farther from it than nearly all training
rows of that centroid's language are is rejected: it keeps the nearest language but with a lowered score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursemetrics.llm.common import stored

BITS = 13
#: A character of a letter category; digits, fractions and number signs are none.
LETTER = regex.compile(r"\p{L}")
SPACES = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
SHARPNESS = 25.0
BLOCK = 1 << 18
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text; long texts are read in overlapping blocks."""
    data = b" " + b" ".join(text.lower().encode().translate(SPACES).split()) + b" "
    raw, out = np.frombuffer(data, np.uint8), np.zeros(1 << BITS, np.int64)
    for at in range(0, max(1, len(raw) - 2), BLOCK):
        b = raw[at:at + BLOCK + 3].astype(np.uint32)
        three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        four = three[:-1] ^ b[3:] * np.uint32(0x9E3779B1)
        for key in (three[:BLOCK], four[:BLOCK]):
            out += np.bincount((key * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-9)


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]
    of: np.ndarray  # index into langs of each centroid
    rows: np.ndarray
    reject: np.ndarray  # lowest cosine that is not rejected, of each language

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not has_letter(text) or not self.langs:
            return UNKNOWN, 0.0, True
        cosine = self.rows @ vector(ngram_counts(text), self.idf)
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.of, cosine)
        k = int(best.argmax())
        share = 1 / np.exp(SHARPNESS * (best - best[k])).sum()
        far = bool(best[k] < self.reject[k])
        return self.langs[k], float(share * (max(0.0, best[k]) / self.reject[k] if far else 1.0)), far


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; deterministic for given rows."""
    seeds = [x.sum(0)]
    seeds[0] /= max(np.linalg.norm(seeds[0]), 1e-9)
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int((x @ np.array(seeds).T).max(1).argmin())])
    c = np.array(seeds)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.array([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c


def fit(docs: DataFrame, training: Column, clusters: int = 3, sample_rows: int = 1200, reject_share: float = 0.01,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Learn the centroids from rows with a language for which ``training`` holds.

    ``sample_rows`` bounds the training rows of each language (those of the smallest id hash); a language's
    rows meet in one task for k-means, so that bound is also the bound of that task.
    """
    smallest = Window.partitionBy("_lang").orderBy("_hash", "_id")
    ids = (docs.where(training & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
           .select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(id_col).alias("_hash"))
           .withColumn("_n", F.row_number().over(smallest)).where(F.col("_n") <= sample_rows).select("_id", "_lang"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, features = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    counts = ngram_counts(text)
                    at = np.flatnonzero(counts)
                    langs.append(lang)
                    features.append((at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([a for a, _ in features], pa.binary()),
                                              pa.array([b for _, b in features], pa.binary())], names=["lang", "at", "n"])

    # sample_rows ids for each language at most.
    picked = stored(docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_doc_lang"), F.col(text_col).alias("_text"))
                    .join(F.broadcast(ids.distinct()), "_id").where("_lang = _doc_lang").select("_lang", "_text")
                    .mapInArrow(counted, "lang string, at binary, n binary"), "langid-sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found[np.frombuffer(at, "<u2")] += 1
                rows += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], rows))], names=["gram", "n"])

    # At most one row for each hash bucket.
    seen = {r.gram: r.n for r in picked.select("at").mapInArrow(present, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = seen.pop(-1, 0)
    idf = np.full(1 << BITS, math.log(1 + total), np.float32)
    for gram, n in seen.items():
        idf[gram] = math.log((1 + total) / (1 + n)) + 0.1

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"])
        x = np.zeros((len(pdf), 1 << BITS), np.float32)
        for row, (at, n) in enumerate(zip(pdf["at"], pdf["n"])):
            x[row, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
            x[row] = vector(x[row], idf)
        c = _kmeans(x, clusters)
        low = max(0.02, float(np.quantile((x @ c.T).max(1), reject_share)))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "row": [r.astype("<f4").tobytes() for r in c], "low": low})

    # A few centroids for each language.
    made = sorted(picked.groupBy("lang").applyInPandas(grouped, "lang string, row binary, low double").collect(), key=lambda r: (r.lang, bytes(r.row)))
    langs = sorted({r.lang for r in made})
    return Centroids(idf, langs, np.array([langs.index(r.lang) for r in made], np.int64),
                     np.array([np.frombuffer(r.row, "<f4") for r in made]).reshape(len(made), 1 << BITS),
                     np.array([next(r.low for r in made if r.lang == x) for x in langs]))


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: id, ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    One row per input row, repeated rows included. ``und`` with score 0 where the text is null, empty or has no
    letter (or nothing was learned); ties go to the first language in code order; a null id stays null; other
    columns are not read.
    """
    # The model is a few centroids of fixed length for each language.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _, _ in got], pa.string()),
                                              pa.array([x for _, x, _ in got], pa.float64()), pa.array([x for _, _, x in got], pa.bool_())],
                                             names=[id_col, "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
