"""Embedding a text column with a user-supplied batch function (G10)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def embed_catalogue(df: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], text_col: str = "embed_text",
                    out_col: str = "content_vector", batch: int = 50) -> DataFrame:
    """Adds ``out_col`` = embed_fn(texts) computed per Arrow batch of ``batch`` rows inside the tasks."""
    schema = f"{df.schema.simpleString()[7:-1]}, {out_col} array<float>"

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch].copy()
                vecs = embed_fn(part[text_col].fillna("").tolist())
                part[out_col] = pd.Series([list(map(float, v)) for v in vecs], index=part.index)
                yield part
    return df.mapInPandas(run, schema)
