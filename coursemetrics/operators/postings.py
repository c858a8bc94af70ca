"""Keyword search over a written inverted table (G5), exact and without a cap on requests.

The index is a table of lists: the documents of a term within a block of documents, what their BM25 weights are made of, and the
highest of the list. Blocks hold documents of similar length, since a term weighs most in short ones. Requests meet lists by
equi-joins on the term; nothing is packed or broadcast by hand.

A search runs in two rounds inside one plan:

1. the documents of a request's rarest terms are scored in full, which gives a score that the k-th hit reaches (``least``);
2. terms are split by their highest weight in the corpus: documents that hold only the lighter ones, whose weights together
   stay below ``least``, can't be hits. The lists of the other terms are read, block by block where the block's highest
   weights can reach ``least``, then document by document; what is left is scored in full.

Both bounds are never below a document's score, so hits and scores equal those of ``search.keyword_top_k``.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from coursemetrics.functions.topk import top_k_per_group
from coursemetrics.operators.search import BM25_B, BM25_K1, tokens

BLOCK_DOCUMENTS = 128
FIRST_HITS = 4          # round 1 reads the rarest terms that have this many times k entries together
SLACK = 2e-6            # scores are compared after rounding to 6 places


@dataclass(frozen=True)
class Postings:
    lists: DataFrame    # term, block, docs, tfs and dls (their lengths), top (the list's highest weight, without idf)
    terms: DataFrame    # term, df, idf, top (the corpus's highest weight)
    path: str
    average: float
    k1: float
    b: float


def _counted(arrow: pa.Schema):
    def run(batches):
        for batch in batches:
            found = [Counter(x or ()) for x in batch.column("toks").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([sum(x.values()) for x in found], pa.int64()), pa.array([list(x) for x in found], pa.list_(pa.string())),
                 pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], schema=arrow)
    return run


def _lists_of(arrow: pa.Schema, average: float, k1: float, b: float):
    """The lists of one block: its documents are turned from rows of terms into rows of documents."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        terms, dl = block.column("terms").combine_chunks(), block.column("dl").to_numpy()
        of = np.repeat(np.arange(block.num_rows), np.array(pc.list_value_length(terms)))
        coded = terms.flatten().dictionary_encode()
        code, tf = coded.indices.to_numpy(), block.column("tfs").combine_chunks().flatten().to_numpy()
        order = np.argsort(code, kind="stable")
        norm = tf + k1 * (1 - b + b * dl[of] / average)
        cuts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        top = np.maximum.reduceat((tf * (k1 + 1) / norm)[order], cuts[:-1]) if len(code) else np.zeros(0)
        cut, listed = pa.array(cuts, pa.int32()), len(coded.dictionary)
        return pa.Table.from_arrays(
            [coded.dictionary, pa.repeat(block.column("block")[0], listed), pa.ListArray.from_arrays(cut, block.column("doc_id").combine_chunks().take(pa.array(of[order]))),
             pa.ListArray.from_arrays(cut, pa.array(tf[order].astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(dl[of[order]].astype(np.int32))), pa.array(top)], schema=arrow)
    return run


def build_postings(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", k1: float = BM25_K1, b: float = BM25_B,
                   block_documents: int = BLOCK_DOCUMENTS) -> Postings:
    """Write the lists and terms of ``docs`` under ``path``. Document ids must be distinct; a null text has no terms, but counts
    among the documents.

    Only the documents' counted terms are shuffled, once, into their blocks; a list is made within its block.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("dl", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    whole = docs.agg(F.count("*").alias("n"), F.count(text).alias("texts")).first()
    (docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("toks")).where("size(toks) > 0").mapInArrow(_counted(to_arrow_schema(schema)), schema)
     .write.mode("overwrite").parquet(f"{path}/counts"))
    counts = spark.read.schema(schema).parquet(f"{path}/counts")
    average = max((counts.agg(F.sum("dl")).first()[0] or 0) / max(1, whole["texts"]), 1e-12)
    lengths = counts.withColumn("class", F.floor(4 * F.log2("dl")))
    classes = lengths.groupBy("class").agg(F.ceil(F.count("*") / block_documents).alias("blocks"))   # one row per quarter power of two
    placed = lengths.join(F.broadcast(classes), "class").select(
        "doc_id", "dl", "terms", "tfs", (F.col("class") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).alias("block"))
    numbers = T.ArrayType(T.IntegerType())
    made = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(id_type)),
                         T.StructField("tfs", numbers), T.StructField("dls", numbers), T.StructField("top", T.DoubleType())])
    placed.groupBy("block").applyInArrow(_lists_of(to_arrow_schema(made), average, k1, b), made).write.mode("overwrite").parquet(f"{path}/lists")
    lists = spark.read.schema(made).parquet(f"{path}/lists")
    n, df = float(whole["n"]), F.sum(F.size("docs")).alias("df")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    (lists.groupBy("term").agg(df, F.max("top").alias("top")).withColumn("idf", idf).withColumn("top", F.col("top") * F.col("idf"))
     .write.mode("overwrite").parquet(f"{path}/terms"))
    return Postings(lists, spark.read.parquet(f"{path}/terms"), path, average, k1, b)


def _weight(index: Postings, idf, tf, dl):
    """As the exact search computes it, in the same order of operations."""
    return idf * tf * (index.k1 + 1) / (tf + index.k1 * (1 - index.b + index.b * dl / index.average))


def _weights(index: Postings):
    return F.zip_with("tfs", "dls", lambda tf, dl: _weight(index, F.col("idf"), tf, dl))


def _entries(asked: DataFrame, index: Postings) -> DataFrame:
    """(query_id, doc_id, block, weight) of all documents in the lists of the asked terms."""
    return asked.select("query_id", "term", "idf").join(index.lists, "term").select(
        "query_id", "block", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), _weights(index).alias("weight"))))


def _in_full(partial: DataFrame, others: DataFrame, index: Postings) -> DataFrame:
    """Scores of ``partial`` (query_id, doc_id, block, weight) with the weights of the ``others`` (query_id, term, idf) added."""
    wanted = partial.join(others.select("query_id", "term", "idf"), "query_id").join(index.lists.drop("top"), ["term", "block"])
    at = F.array_position("docs", F.col("doc_id")).cast("int")
    weight = _weight(index, F.col("idf"), F.element_at("tfs", at), F.element_at("dls", at))
    added = wanted.where(at > 0).select("query_id", "doc_id", weight.alias("weight"))
    return (partial.select("query_id", "doc_id", "weight").unionByName(added).groupBy("query_id", "doc_id")
            .agg(F.round(F.sum("weight"), 6).alias("score")))


def _rounds(index: Postings, requests: DataFrame, k: int, query_id: str, query_text: str):
    """(the index with the asked terms' lists, asked terms with bounds, second round's candidates)."""
    spark, path = requests.sparkSession, f"{index.path}/asked-{uuid.uuid4().hex}"
    asked = (requests.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(query_text))).alias("term"))
             .join(index.terms, "term"))
    # Spark knows the size of a written table: where it is small, lists of other terms are dropped as they are read.
    asked.select("term").distinct().write.parquet(path)
    index = replace(index, lists=index.lists.join(spark.read.parquet(path), "term", "left_semi"))
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.sum("df").over(rare) - F.col("df")
    ranked = asked.withColumn("first", before < FIRST_HITS * k)
    of_document = ["query_id", "doc_id", "block"]
    opening = _entries(ranked.where("first"), index).groupBy(*of_document).agg(F.sum("weight").alias("weight"))
    # Only for the bound: scoring fewer documents here can't lose a hit.
    opening = top_k_per_group(opening, "query_id", [F.desc("weight"), "doc_id"], 2 * k).drop("rank")
    opened = _in_full(opening, ranked.where("not first"), index)
    least = top_k_per_group(opened, "query_id", [F.desc("score"), "doc_id"], k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
    light = Window.partitionBy("query_id").orderBy("top", "term")
    bounded = (asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
               .withColumn("heavy", F.sum("top").over(light) >= F.col("least"))
               .withColumn("rest", F.sum(F.when(~F.col("heavy"), F.col("top")).otherwise(0.0)).over(Window.partitionBy("query_id"))))
    lists = bounded.where("heavy").select("query_id", "term", "idf", "least", "rest").join(index.lists.withColumnRenamed("top", "list_top"), "term")
    block = Window.partitionBy("query_id", "block")
    alive = lists.withColumn("reach", F.sum(F.col("list_top") * F.col("idf")).over(block) + F.col("rest")).where("reach >= least")
    entries = alive.select("query_id", "block", "least", "rest", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), _weights(index).alias("weight"))))
    candidates = (entries.groupBy("query_id", "block", "doc_id", "least", "rest").agg(F.sum("weight").alias("weight"))
                  .where("weight + rest >= least").select(*of_document, "weight"))
    return index, bounded, candidates


def postings_top_k(index: Postings, requests: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """BM25 over whole texts: (query_id, doc_id, score rounded to 6, rank), as ``search.keyword_top_k`` gives them. Query ids must be
    distinct; for any number of requests. Their terms are written beside the index first."""
    index, bounded, candidates = _rounds(index, requests, k, query_id, query_text)
    return top_k_per_group(_in_full(candidates, bounded.where("not heavy"), index), "query_id", [F.desc("score"), "doc_id"], k)


def scored_pairs(index: Postings, requests: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """One row (pairs): how many (request, document) pairs the second round scores in full."""
    return _rounds(index, requests, k, query_id, query_text)[2].agg(F.count("*").alias("pairs"))
