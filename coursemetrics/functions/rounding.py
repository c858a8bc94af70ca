"""Rounding that gives the same digits in Spark and in DuckDB.

``round`` on a double rounds the binary value, so 0.285 may go either way
and an average that lands on a tie depends on summation order. Going
through DECIMAL(38,10) first fixes the digits; the oracle SQL uses the
same expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_round(x, n: int) -> Column:
    return F.round(_c(x).try_cast("decimal(38,10)"), n).cast("double")


def pct(part, whole, n: int = 1) -> Column:
    """ROUND(part * 100.0 / NULLIF(whole, 0), n) as a double."""
    return stable_round(_c(part).cast("double") * 100.0 / F.nullif(_c(whole), F.lit(0)), n)
