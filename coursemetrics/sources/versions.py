"""Whole sets of tables replaced at once (A4, A6).

A build writes its tables into a folder of its own. Only when all of them are there does a small committed Parquet folder name
it as the next version, so a build that stops half way leaves the old set as it was, and a reader that has opened a version
keeps it. Schemas may differ from version to version. Nothing is renamed or removed, so any store that Spark writes to will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

POINTERS = "_versions"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """``(version, folder)`` of all published sets under ``root``."""
    return spark.read.schema("folder string, version int").parquet(f"{root.rstrip('/')}/{POINTERS}")


def current(spark: SparkSession, root: str, version: int | None = None) -> str | None:
    """The folder of the newest published set (or of ``version``); None if there is none yet."""
    try:
        found = versions(spark, root)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    row = (found if version is None else found.where(F.col("version") == version)).orderBy(F.desc("version")).first()
    return row["folder"] if row else None


def publish(spark: SparkSession, root: str, build: Callable[[str], object]) -> str:
    """``build(folder)`` writes every table; then the folder becomes the current version. Returns the folder.

    Two builds that publish at once race for a version number; the later one fails at its pointer and can be published again.
    """
    root = root.rstrip("/")
    folder = f"{root}/set-{uuid.uuid4().hex}"
    build(folder)
    last = versions(spark, root).agg(F.max("version")).first()[0] if current(spark, root) else 0
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("error").parquet(f"{root}/{POINTERS}/version={last + 1}")
    return folder
