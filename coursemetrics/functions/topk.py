"""Top-k helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_k_per_group(df: DataFrame, group: str, order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """row_number() <= k per group. Spark plans a partial group limit before the
    shuffle (WindowGroupLimit), so only k rows per group and partition move."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    return ranked.withColumn(rank_col, F.col(rank_col).cast("bigint"))

