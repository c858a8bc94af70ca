"""Batched upload with acknowledgements (A10).

``send`` takes a list of documents and tells for each whether it was taken; the service behind it is the caller's. Tasks send
their documents in batches, send again only what was refused, and leave a row for each batch. These rows are the ledger: a
committed Parquet table, so a task that is lost or a job that is run again sends only documents that no committed
row acknowledges. A task's own rows are committed when it ends; documents must be keyed, so that sending one twice stores it once.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH = 50
ATTEMPTS = 3


def _ledger_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("task", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("attempts", T.IntegerType()),
                         T.StructField("documents", T.LongType()), T.StructField("succeeded", T.LongType()), T.StructField("failed", T.LongType()),
                         T.StructField("taken", T.ArrayType(id_type)), T.StructField("refused", T.ArrayType(id_type)), T.StructField("error", T.StringType())])


def upload_documents(docs: DataFrame, send: Callable[[list[dict]], list[bool]], ledger: str, doc_id: str = "course_id", batch: int = BATCH,
                     attempts: int = ATTEMPTS, rounds: int = 2) -> DataFrame:
    """Upload ``docs``; returns the ledger: a row per batch with its counts and the ids taken and refused.

    A batch whose ``send`` raises counts as refused and is tried again, ``attempts`` times in its task; what is still refused is
    dealt into new batches in the next of ``rounds``. Documents that an earlier call on the same ledger got through are not sent.
    Documents without an id can't be acknowledged: an error.
    """
    spark = docs.sparkSession
    schema = _ledger_schema(docs.schema[doc_id].dataType)
    arrow = to_arrow_schema(schema)
    if not docs.where(F.col(doc_id).isNull()).isEmpty():
        raise ValueError(f"documents without {doc_id}")

    def run(batches):
        task, number, held = TaskContext.get().partitionId(), 0, []

        def outcome():
            left, taken, error, tries = list(held), [], None, 0
            while left and tries < attempts:
                tries += 1
                try:
                    told = list(send(left))
                    if len(told) != len(left):
                        raise ValueError(f"{len(told)} answers for {len(left)} documents")
                except Exception as exc:  # noqa: BLE001  the service's own errors
                    told, error = [False] * len(left), f"{type(exc).__name__}: {exc}"[:500]
                taken += [d[doc_id] for d, ok in zip(left, told) if ok]
                left = [d for d, ok in zip(left, told) if not ok]
            return (task, number, tries, len(held), len(taken), len(left), taken, [d[doc_id] for d in left], error if left else None)

        def as_batch(row):
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow)], schema=arrow)

        for part in batches:
            for document in part.to_pylist():
                held.append(document)
                if len(held) == batch:
                    yield as_batch(outcome())
                    held, number = [], number + 1
        if held:
            yield as_batch(outcome())

    # An empty first folder gives the ledger its schema.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{ledger}/round=0")
    told = spark.read.schema(T.StructType([*schema.fields, T.StructField("round", T.IntegerType())]))
    last = told.parquet(ledger).agg(F.max("round")).first()[0] or 0
    for r in range(last + 1, last + 1 + rounds):
        done = told.parquet(ledger).select(F.explode("taken").alias(doc_id)).distinct()
        docs.join(done, doc_id, "left_anti").mapInArrow(run, schema).write.mode("overwrite").parquet(f"{ledger}/round={r}")
        if told.parquet(ledger).where((F.col("round") == r) & (F.col("failed") > 0)).isEmpty():
            break
    return told.parquet(ledger)


def upload_totals(ledger: DataFrame) -> DataFrame:
    """One row: batches, documents that got through, and documents that never did."""
    taken = ledger.select(F.explode("taken").alias("id")).distinct()
    refused = ledger.select(F.explode("refused").alias("id")).distinct().join(taken, "id", "left_anti")
    return ledger.agg(F.count("*").alias("batches")).select(
        "batches", taken.agg(F.count("*").alias("n")).select("n").scalar().alias("succeeded"), refused.agg(F.count("*").alias("n")).select("n").scalar().alias("failed"))
