"""Raw-file presence checks and named-query execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def raw_file_inventory(spark: SparkSession, root: str, expected: list[str]) -> DataFrame:
    """(path, present, length, modified) for each expected relative path under ``root``.

    Lists files with the ``binaryFile`` source selecting only metadata columns, so
    file contents are never read.
    """
    root = root.rstrip("/")
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select(F.regexp_replace(F.col("path"), r"^.*?" + root.replace(".", r"\.") + "/", "").alias("rel"),
                     "length", F.col("modificationTime").alias("modified")))
    manifest = spark.createDataFrame([(p,) for p in expected], "rel string")
    return (manifest.join(found, "rel", "left")
            .select(F.col("rel").alias("path"), F.col("length").isNotNull().alias("present"), "length", "modified"))


def run_named_query(spark: SparkSession, sql: str, args=(), one: bool = False) -> DataFrame:
    """SQL with positional ``?`` parameters bound by Spark (no string pasting); ``one`` keeps the first row."""
    df = spark.sql(sql, args=list(args)) if args else spark.sql(sql)
    return df.limit(1) if one else df
