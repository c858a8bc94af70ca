"""Statements with fields outside the declared schema (A1): bronze as VARIANT.

The declared reader keeps what its schema names. Here a statement stays whole as one VARIANT value: a field that a new client
adds is stored with its type, can be asked for by its path, and shows in the observed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from coursemetrics.sources.json_ranges import array_records
from coursemetrics.sources.schemas import EVENT_SCHEMA

STATEMENT, TEXT = "statement", "statement_text"


def parsed(texts: DataFrame, text: str) -> DataFrame:
    """``(statement, statement_text)``: the value; the text only where it does not parse."""
    value = F.try_parse_json(text)
    return texts.select(value.alias(STATEMENT), F.when(value.isNull(), F.col(text)).alias(TEXT))


def read_variant_events(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Array files (``multiline``, read by ranges) or a statement per line; null and blank lines are no statements."""
    if multiline:
        return parsed(array_records(spark, path).select("text"), "text")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parsed(lines, "value")


def field(path: str, kind: str, statement: str = STATEMENT) -> Column:
    """The value at a JSON path, null where it is missing or of another type."""
    return F.try_variant_get(statement, path, kind)


def declared(bronze: DataFrame, schema: T.StructType = EVENT_SCHEMA, statement: str = STATEMENT) -> DataFrame:
    """The declared columns of whole statements, as the schema reader gives them."""
    return bronze.where(F.col(statement).isNotNull()).select(F.inline(F.array(F.from_json(F.to_json(statement), schema))))


def observed_schema(bronze: DataFrame, statement: str = STATEMENT) -> str:
    """The schema of all statements together, merged where tasks meet; its size follows the number of different fields."""
    return bronze.agg(F.schema_of_variant_agg(statement)).first()[0]


def undeclared_fields(bronze: DataFrame, schema: T.StructType = EVENT_SCHEMA, statement: str = STATEMENT) -> DataFrame:
    """``(field, statements)``: top-level fields that the schema does not name, with the number of statements that have them."""
    keys = F.explode(F.json_object_keys(F.to_json(statement)))
    return (bronze.where(F.col(statement).isNotNull()).select(keys.alias("field")).where(~F.col("field").isin(*schema.names))
            .groupBy("field").agg(F.count("*").alias("statements")))
