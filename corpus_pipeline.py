"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark items go, personal data is replaced, and what is left is packed into training sequences.

Every stage takes the documents that its predecessor kept, with their columns, and returns a DataFrame;
``run`` writes each result as Parquet in the shared folder and reads it again, so a lost executor costs one stage's
tasks at most. Null and empty texts are neither toxic, contaminated nor private; they form one near-duplicate class,
of which one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemetrics.llm import decontaminate, packing, pii, queries, simhash, toxicity
from coursemetrics.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, queries.civil_lexicon(spark, sf_dir, docs), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=2, seed=42)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in the texts; ``n_chars`` follows where a text changed."""
    changed = pii.replace_pii(docs, queries.SURROGATE_KEY, count_col="__replaced")
    length = F.when(F.col("__replaced") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return changed.withColumn("n_chars", length).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(queries.TOKENIZER), queries.MAX_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_private_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained lexicon, surrogates and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
