from __future__ import annotations

from pyspark.sql import Column, functions as F


def pick(index: Column, values: list[str]) -> Column:
    """values[index mod len(values)] as a Column (a CASE over a small fixed list)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, F.pmod(index, F.lit(len(values))).cast("int") + 1)
