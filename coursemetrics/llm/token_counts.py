"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coursemetrics.llm.tokens import Encoder


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of UTF-8 bytes and of tokens of every whole text.

    Returns the id column, ``n_bytes`` and ``n_tokens`` (long), one row per input row, repeated rows
    included. Null and empty texts have 0 bytes and 0 tokens; a null id stays null; other columns, also
    ones named like the results, are not read. Encoding runs in the scan's own tasks, in groups balanced
    by size; long texts are cut at safe boundaries (``tokens``), so no call grows with a text.

    ``tokenizer`` is a path every executor can read (``.json`` or ``.model``); special strings in texts are
    treated as the library does by default, no special token is added.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, ids=False)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = pa.array(encoder.stream(texts), pa.int64())
            sizes = pa.array((len(x.encode()) for x in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=[id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
