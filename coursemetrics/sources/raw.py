"""Raw JSON readers (bronze) and the statement builder used to feed them from the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from coursemetrics.operators.silver import CORRUPT
from coursemetrics.sources.schemas import COURSE_SCHEMA, EVENT_SCHEMA, LEARNER_SCHEMA

# Statement vocabulary.
LANG = "en-US"
VERB_IRI = "http://adlnet.gov/expapi/verbs/"
EXT_BASE = "https://lms.example.com/ext/"
EXT_KEYS = ("course_id", "module_id", "department", "format")


def read_raw(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True, corrupt: str | None = None) -> DataFrame:
    """JSON files with a declared schema: an array per file (``multiline``; one task reads a file) or a record per line
    (files are split). ``corrupt`` names a column for the text of records that don't parse."""
    reader = spark.read.option("multiLine", multiline).option("mode", "PERMISSIVE")
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def read_raw_events(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_raw(spark, path, EVENT_SCHEMA, multiline, CORRUPT)


def read_courses(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_raw(spark, path, COURSE_SCHEMA, multiline)


def read_learners(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_raw(spark, path, LEARNER_SCHEMA, multiline)


def statements_from_silver(silver: DataFrame, ext_base: str = EXT_BASE) -> DataFrame:
    """Nest flat event rows back into activity statements (the bronze shape)."""
    ts_text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    scored = F.col("score").isNotNull()
    result = F.when(
        F.col("verb") != "launched",
        F.struct(
            F.when(scored, F.struct(F.col("score").alias("scaled"), F.col("score_raw").alias("raw"),
                                    F.lit(0).cast("bigint").alias("min"), F.lit(100).cast("bigint").alias("max")))
             .alias("score"),
            F.col("quiz_passed").alias("success"),
            F.col("course_completed").alias("completion"),
            F.col("duration_iso").alias("duration")))
    ext = F.create_map(*[x for k, c in zip(EXT_KEYS, ("course_id", "module_id", "department", "course_format"))
                         for x in (F.lit(ext_base + k), F.col(c))])
    return silver.select(
        F.col("event_id").alias("id"),
        F.struct(F.lit("Agent").alias("objectType"), F.col("learner_name").alias("name"),
                 F.col("learner_mbox").alias("mbox")).alias("actor"),
        F.struct(F.concat(F.lit(VERB_IRI), F.col("verb")).alias("id"),
                 F.create_map(F.lit(LANG), F.col("verb")).alias("display")).alias("verb"),
        F.struct(F.lit("Activity").alias("objectType"), F.col("object_id").alias("id"),
                 F.struct(F.create_map(F.lit(LANG), F.col("object_name")).alias("name"),
                          F.lit("http://adlnet.gov/expapi/activities/module").alias("type")).alias("definition"))
         .alias("object"),
        F.struct(ext.alias("extensions")).alias("context"),
        ts_text.alias("timestamp"), ts_text.alias("stored"),
        F.struct(F.lit("Agent").alias("objectType"), F.lit("LMS").alias("name"),
                 F.lit("mailto:lms@example.com").alias("mbox")).alias("authority"),
        result.alias("result"))
