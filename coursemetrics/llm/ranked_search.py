"""Ranked lexical search with bag deduplication: every item's best documents, each kind of document scored once.

A document matters to a set of items only through how often it holds their words and through its length. So texts are
first reduced, where they are scanned, to their bag over the items' vocabulary and their number of terms. Documents
with the same bag and length factor form a class: found by a 64-bit hash, told apart by the bag itself. Classes are
scored once, all items at a time, and only a class's ``top`` smallest ids are kept, since no more of it can be returned.

The items are the stated query set. They pass through the driver one block at a time; a block's bytes are bounded, so
what is broadcast is too, and every block is searched in all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from coursemetrics.llm.common import blocks_of, stored, translate_table

LETTERS = translate_table(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
BLOCK_BYTES = 16 << 20     # item texts searched in one reading of the documents
CELLS = 1 << 21            # classes x items scored at once
SCALE = 1_000_000_000


def bag_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for block in blocks_of((text or "").encode().translate(LETTERS)):
        found.update(block.split())
    return found


class Items:
    """A block of items: ids, bags, and the numbers of the terms they hold."""

    def __init__(self, rows: list[tuple[object, Counter]]):
        self.ids = [x[0] for x in rows]
        self.terms = sorted({t for _, bag in rows for t in bag})
        self.number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((self.number[t], item, n) for item, (_, bag) in enumerate(rows) for t, n in bag.items())
        self.term, self.item, self.times = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        self.start = np.searchsorted(self.term, np.arange(len(self.terms) + 1))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Blocks of at most BLOCK_BYTES of text and one item; the driver holds one block at a time."""
    rows, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        if bag := bag_of(row[1]):
            rows.append((row[0], bag))
            size += len(row[1])
        if size >= BLOCK_BYTES:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


def bags(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, bag)`` of every document with a term: all its terms, and those of the vocabulary as two
    little-endian arrays of 32 bits, rising numbers and their counts (null: none of them)."""
    given = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = given.value.get
        for batch in batches:
            rows, sizes, packed = [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                if not text.is_valid:
                    continue
                found, n = Counter(), 0
                for block in blocks_of(text.as_py().translate(LETTERS)):
                    words = block.split()
                    n += len(words)
                    found.update(map(known, words))
                if n:
                    found.pop(None, None)
                    rows.append(row)
                    sizes.append(n)
                    packed.append(np.array(list(zip(*sorted(found.items()))), "<u4").tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "n", "bag"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("bag", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of every entry of a column of bags."""
    raw = [np.frombuffer(x, "<u4") for x in column.to_pylist()]
    half = np.array([len(x) // 2 for x in raw], np.int64)
    if not half.sum():
        return (np.zeros(0, np.int64),) * 3
    terms, counts = (np.concatenate(x).astype(np.int64) for x in ([x[:len(x) // 2] for x in raw], [x[len(x) // 2:] for x in raw]))
    return np.repeat(np.arange(len(raw)), half), terms, counts


def holders(found: DataFrame, width: int) -> dict[int, int]:
    """Number of documents of every vocabulary term: added up per task, then in a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.int64)
        for batch in batches:
            seen += np.bincount(unpacked(batch.column(0))[1], minlength=width)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["term", "df"])

    # At most a row for each term of the block reaches the driver.
    rows = found.where("bag is not null").select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}


def classes(found: DataFrame, documents: int, terms: int, top: int) -> DataFrame:
    """``(bag, m, members)``: one row for the documents of the same bag and length factor, with their ``top`` smallest ids.

    The hash deals and sorts classes; rows are of one class only if the bags are equal byte for byte. A class that holds
    a third of all documents leaves ``top`` rows of each task."""
    factor = F.lit(100 - 25) + F.call_function("div", F.lit(25).cast("decimal(2,0)") * F.col("n").cast("decimal(15,0)") * F.lit(documents).cast("decimal(15,0)"),
                                               F.lit(terms).cast("decimal(18,0)"))
    keyed = found.where("bag is not null").select("doc_id", "bag", factor.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    same = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    return (keyed.withColumn("place", F.row_number().over(same)).where(F.col("place") <= top)
            .groupBy("hash", "m", "bag").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("members"))
            .select("bag", "m", F.col("members.doc_id").alias("members")))


def scored(found: DataFrame, items: Items, weights: np.ndarray, top: int, id_type: T.DataType, item_type: T.DataType, item_col: str) -> DataFrame:
    """``(item, number of the item, doc_id, score)``: each task's ``top`` documents of every item."""
    spark = found.sparkSession
    given = spark.sparkContext.broadcast((items.ids, items.start, items.item, items.times * weights[items.term]))
    doc_arrow, item_arrow = to_arrow_type(id_type), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start, item, weight = given.value
        best: list[list] = [[] for _ in ids]      # (-score, null id, id, ids of the class), best first
        least = np.zeros(len(ids), np.int64)      # score that a new class must reach
        step = max(1, CELLS // len(ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, count = unpacked(batch.column(0))
                m = batch.column(1).to_numpy()
                part = SCALE * count // (1000 * count + 12 * m[row])
                order = np.argsort(term, kind="stable")
                row, term, part = row[order], term[order], part[order]
                edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1], True])
                score = np.zeros((len(ids), batch.num_rows), np.int64)
                for lo, hi in zip(edges[:-1], edges[1:]):
                    a, b = start[term[lo]], start[term[lo] + 1]
                    score[np.ix_(item[a:b], row[lo:hi])] += weight[a:b, None] * part[None, lo:hi]
                if batch.num_rows > top:
                    least = np.maximum(least, np.partition(score, batch.num_rows - top, axis=1)[:, batch.num_rows - top])
                members = batch.column(2).to_pylist()
                which, col = np.nonzero((score >= least[:, None]) & (score > 0))
                for i, c in zip(which.tolist(), col.tolist()):
                    first = members[c][0]
                    best[i].append((-int(score[i, c]), first is None, first if first is not None else 0, members[c]))
                for i in set(which.tolist()):
                    best[i] = sorted(best[i], key=lambda x: x[:3])[:top]
                    if len(best[i]) == top:
                        least[i] = max(least[i], -best[i][-1][0])
        for i, kept in enumerate(best):
            rows = sorted(((s, x is None, x if x is not None else 0) for s, _, _, same in kept for x in same))[:top]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i]] * len(rows), item_arrow), pa.array([i] * len(rows), pa.int64()),
                     pa.array([None if none else x for _, none, x in rows], doc_arrow), pa.array([-s for s, _, _ in rows], pa.int64())],
                    names=[item_col, "number", "doc_id", "score"])

    schema = T.StructType([T.StructField(item_col, item_type), T.StructField("number", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return found.mapInArrow(run, schema)


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every item's ``top`` documents with a score above 0.

    Terms are runs of 0-9, A-Z, a-z and characters beyond ASCII, A-Z lowered. With N documents that hold a term, L terms
    in all of them, n terms of a document, df documents of a term and tf its occurrences: a term weighs
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, a document's m is ``75 + 25 n N // L``, and its score sums
    ``weight * (10**9 tf // (1000 tf + 12 m))`` over the item's terms, repeats included.

    Returns the item's id, rank (from 1), the document's id and score. Equal scores go by rising id, null ids last.
    Null and empty texts match nothing and do not count in N; repeated documents are ranked each; a repeated item gives
    its rows again; items without terms and empty tables give none; other columns, also ones named like helper columns,
    are not read. Long texts are read in blocks.
    """
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    results = []
    for block in item_blocks(items, item_col, item_text_col):
        found = stored(bags(docs, block.number, id_col, text_col), "search-bags")
        documents, terms = found.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = holders(found, len(block.terms))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(block.terms))], np.int64)
        best = scored(classes(found, documents, terms, top), block, weights, top, id_type, item_type, "__item")
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        results.append(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
                       .select(F.col("__item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))
    if not results:
        return spark.createDataFrame([], T.StructType([T.StructField(item_col, item_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField(id_col, id_type), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, results)


#: The same result in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
s AS (SELECT count(*) AS documents, sum(len(words))::HUGEINT AS terms FROM d WHERE len(words) > 0),
m AS (SELECT doc_id, r, (100 - 25 + (25 * len(words) * s.documents) // s.terms)::BIGINT AS m FROM d, s WHERE len(words) > 0),
i AS (SELECT item_id, q, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS q,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark) GROUP BY ALL),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.documents + 2) / (2 * n + 1)))::BIGINT AS weight
      FROM (SELECT term, count(*) AS n FROM t GROUP BY term), s),
z AS (SELECT i.item_id, i.q, t.r, sum(i.times * w.weight * ((1000000000 * t.tf) // (1000 * t.tf + 12 * m.m)))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN w USING (term) JOIN m ON m.r = t.r GROUP BY ALL)
SELECT z.item_id, row_number() OVER (PARTITION BY z.q ORDER BY z.score DESC, m.doc_id, z.r)::INTEGER AS rank, m.doc_id, z.score
FROM z JOIN m USING (r) WHERE z.score > 0 QUALIFY rank <= 20
"""
