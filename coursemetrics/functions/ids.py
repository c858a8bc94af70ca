from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def dense_ids(df: DataFrame, column: str, path: str, name: str = "id") -> DataFrame:
    """The distinct non-null values of ``column`` with dense 0-based ids in their order, written to ``path``.

    Ranges of values are sorted apart; only one count per range meets in a task, so the number of values has no cap.
    """
    spark = df.sparkSession
    (df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
     .withColumn("shard", F.spark_partition_id()).write.mode("overwrite").parquet(path))
    parts = spark.read.parquet(path)
    counts = parts.groupBy("shard").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("offset"))
    place: Column = F.row_number().over(Window.partitionBy("shard").orderBy(column)) - 1
    return (parts.withColumn("place", place).join(offsets, "shard")
            .select(column, (F.col("offset") + F.col("place")).cast("int").alias(name)))
