"""Registered queries of the corpus operators (production parameters, whole tables)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemetrics.llm import (decontaminate, divergence, langid, lm, mixture, packing, pii, quality, ranked_search, simhash, suffix_dedup,
                               token_counts, toxicity)
from coursemetrics.llm.common import read

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: Whoever runs this on real data names a secret of their own.
SURROGATE_KEY = "example surrogate key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.replace_pii(read(spark, sf_dir, "documents"), SURROGATE_KEY, count_col="n_replaced")
    return found.select("doc_id", "n_replaced", "text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read(spark, sf_dir, "documents"), shingle=3, max_bits=2, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), MAX_TOKENS)


def remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, remainder(5) != 0))
    return found.withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))


def civil_lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Lexicon:
    return toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder(4) != 2)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.fit_and_score(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, civil_lexicon(spark, sf_dir, docs), threshold=0.3)
    return found.withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=200).drop("kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=(3, 2), most=2, seed=42)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=3, top=200)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=20)


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_mixture": op11_mixture,
    "op12_source_divergence": op12_source_divergence,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE: dict[str, str] = {
    "op11_mixture": mixture.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
