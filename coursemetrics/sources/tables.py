from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows carry per-row work (JSON, text, string building) right after the scan.
FACT_TABLES = frozenset({"events", "documents", "conversations", "pages", "lineitem", "orders"})
# Session setting, off by default: deal the rows of fact tables over so many partitions after the scan.
# Only for local runs over files of one row group each, which a scan cannot split.
SCAN_PARTITIONS = "coursemetrics.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    dealt = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(dealt)) if dealt and name in FACT_TABLES else df
