"""Table writers. Every write is a full overwrite of one table.

``partition_by`` writes go through the ``rebalance`` hint on the partition
columns: rows of one partition value meet in one task, and AQE splits a
partition that is too large (say a course with a third of all events) into
several tasks by its measured size and merges small ones, so the number of
writers follows the data. ``maxRecordsPerFile`` bounds file sizes. ``write_clustered``
needs no folder per value: for tables with millions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_RECORDS_PER_FILE = 5_000_000


def write_table(df: DataFrame, name: str | None = None, path: str | None = None, partition_by=None,
                fmt: str = "parquet") -> None:
    if (name is None) == (path is None):
        raise ValueError("give exactly one of name or path")
    out = df
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if parts:
        out = out.hint("rebalance", *parts)
    w = (out.write.mode("overwrite").format(fmt).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE))
    if fmt == "delta":
        w = w.option("overwriteSchema", "true")
    if parts:
        w = w.partitionBy(*parts)
    if name is not None:
        w.saveAsTable(name)
    else:
        w.save(path)


def write_silver(silver: DataFrame, name: str | None = "silver_xapi_events", path: str | None = None,
                 fmt: str = "parquet") -> None:
    write_table(silver, name=None if path else name, path=path, partition_by="course_id", fmt=fmt)


def write_clustered(df: DataFrame, path: str, cluster_by=("course_id", "learner_email"), bloom=("course_id", "learner_email"),
                    ndv: int = 1_000_000, files: int | None = None, row_group_bytes: int = 32 << 20) -> None:
    """Files by ranges of ``cluster_by`` instead of a folder per value, so any number of courses makes the same number of files.

    Rows are dealt by range and sorted within a file: a course lies in one file or in neighbouring ones, and a course with a third of
    all rows is split by the columns after it. Least and greatest values of the leading column tell which row groups of the files
    hold a course; Parquet Bloom filters (``bloom``, for up to ``ndv`` values a row group) tell it for the other columns.
    ``files`` defaults to the session's shuffle partitions.
    """
    ranges = df.repartitionByRange(files, *cluster_by) if files else df.repartitionByRange(*cluster_by)
    w = (ranges.sortWithinPartitions(*cluster_by).write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .option("parquet.block.size", row_group_bytes))
    for column in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", ndv)
    w.parquet(path)


def write_search_docs(docs: DataFrame, name: str | None = "course_search_docs", path: str | None = None,
                      fmt: str = "parquet") -> None:
    """The whole document table in one overwrite (upload batching is the writer's job)."""
    write_table(docs, name=None if path else name, path=path, fmt=fmt)


def write_dropout_risk(scored_pairs: DataFrame, name: str | None = "gold_dropout_risk", path: str | None = None,
                       fmt: str = "parquet") -> None:
    """Scored (learner, course) pairs -> the dropout-risk gold table (full overwrite)."""
    write_table(scored_pairs, name=None if path else name, path=path, fmt=fmt)
