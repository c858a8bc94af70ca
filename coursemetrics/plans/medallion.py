"""Build the reporting tables: silver, dimensions and the four gold tables.

Each table is written once (full overwrite) under ``out_root``; the gold jobs
read the *written* silver table, so their lineage starts at storage and a lost
executor only recomputes work from that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from coursemetrics.operators import dropout, features, gold, search
from coursemetrics.operators.embed import embed_catalogue
from coursemetrics.operators.silver import rejected_statements, silver_events
from coursemetrics.sources import versions
from coursemetrics.sources.binding import Binding
from coursemetrics.sources.raw import read_courses, read_learners, read_raw_events
from coursemetrics.sources.sinks import write_clustered, write_dropout_risk, write_search_docs, write_silver, write_table


def build_tables(spark: SparkSession, out_root: str, sf_dir: str | None = None, raw_dir: str | None = None,
                 fmt: str = "parquet", lines: bool = False, lines_of_dimensions: bool = False, clustered: bool = False) -> dict[str, str]:
    """From the driver tables (``sf_dir``) or raw JSON files (``raw_dir``: xapi_events.json,
    courses.json, learners.json; ``lines``: xapi_events.json has a record per line, ``lines_of_dimensions``: so have the others). Statements that silver leaves
    out go to the table of rejects. ``clustered``: silver as range-clustered Parquet files instead of a folder per course. Returns
    table name -> folder."""
    if clustered and fmt != "parquet":
        raise ValueError("clustered silver is written as Parquet")
    root = out_root.rstrip("/")
    paths = {n: f"{root}/{n}" for n in ("bronze_xapi_events", "rejected_xapi_events", "silver_xapi_events", "dim_courses", "dim_learners",
                                        "gold_course_completion", "gold_module_dropoff",
                                        "gold_department_skills", "gold_engagement_hourly")}
    if raw_dir:
        raw = raw_dir.rstrip("/")
        write_table(read_raw_events(spark, f"{raw}/xapi_events.json", multiline=not lines), path=paths["bronze_xapi_events"], fmt=fmt)
        bronze = spark.read.format(fmt).load(paths["bronze_xapi_events"])
        write_table(rejected_statements(bronze), path=paths["rejected_xapi_events"], fmt=fmt)
        silver = silver_events(bronze)
        courses, learners = (read(spark, f"{raw}/{name}.json", not lines_of_dimensions) for read, name in ((read_courses, "courses"), (read_learners, "learners")))
    else:
        b = Binding(spark, sf_dir)
        paths.pop("bronze_xapi_events")
        paths.pop("rejected_xapi_events")
        silver, courses, learners = b.silver, b.dim_courses, b.dim_learners
    if clustered:
        write_clustered(silver, paths["silver_xapi_events"])
    else:
        write_silver(silver, path=paths["silver_xapi_events"], fmt=fmt)
    write_table(courses, path=paths["dim_courses"], fmt=fmt)
    write_table(learners, path=paths["dim_learners"], fmt=fmt)
    s = spark.read.format(fmt).load(paths["silver_xapi_events"])
    c = spark.read.format(fmt).load(paths["dim_courses"])
    lr = spark.read.format(fmt).load(paths["dim_learners"])
    write_table(gold.gold_course_completion(s, c), path=paths["gold_course_completion"], fmt=fmt)
    write_table(gold.gold_module_dropoff(s), path=paths["gold_module_dropoff"], fmt=fmt)
    write_table(gold.gold_department_skills(lr), path=paths["gold_department_skills"], fmt=fmt)
    write_table(gold.gold_engagement_hourly(s), path=paths["gold_engagement_hourly"], fmt=fmt)
    return paths


def publish_tables(spark: SparkSession, root: str, **source) -> str:
    """All tables built anew in a folder of their own, which then becomes the current version under ``root`` at once;
    ``versions.current`` names it for readers. ``source`` as in ``build_tables``."""
    return versions.publish(spark, root, lambda folder: build_tables(spark, folder, **source))


def build_search_docs(spark: SparkSession, root: str, embed_fn: Callable[[list[str]], list[list[float]]], fmt: str = "parquet") -> str:
    """From the written catalogue and completion table: embed text, vectors by ``embed_fn`` (a batch of texts to vectors, run in
    the tasks), index documents, one overwrite of ``course_search_docs``."""
    root = root.rstrip("/")
    courses, stats = (spark.read.format(fmt).load(f"{root}/{n}") for n in ("dim_courses", "gold_course_completion"))
    vectors = embed_catalogue(search.course_embed_text(courses), embed_fn).select("course_id", "content_vector")
    write_search_docs(search.search_docs(courses, stats, vectors), path=f"{root}/course_search_docs", fmt=fmt)
    return f"{root}/course_search_docs"


def build_dropout_risk(spark: SparkSession, root: str, fmt: str = "parquet", params: dict | None = None) -> dropout.DropoutModel:
    """From the written silver table: the feature table once, a model fitted on it, and ``gold_dropout_risk`` scored from it."""
    root = root.rstrip("/")
    write_table(features.training_features(spark.read.format(fmt).load(f"{root}/silver_xapi_events")), path=f"{root}/dropout_training_features", fmt=fmt)
    table = spark.read.format(fmt).load(f"{root}/dropout_training_features")
    model = dropout.train_dropout(table, params)
    write_dropout_risk(dropout.gold_dropout_risk(model, table), path=f"{root}/gold_dropout_risk", fmt=fmt)
    return model
