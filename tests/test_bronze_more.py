"""Statements as VARIANT, sketch unions, versions of table sets, line files of the dimensions."""

import json

import pytest
from pyspark.sql import functions as F

from coursemetrics.operators import reports, sketches
from coursemetrics.operators.silver import silver_events
from coursemetrics.plans import medallion
from coursemetrics.sources import raw, variant, versions
from coursemetrics.sources.binding import Binding
from coursemetrics.sources.schemas import COURSE_SCHEMA, EVENT_SCHEMA, LEARNER_SCHEMA
from paths import SF_SMALL


def statement(i, **more):
    return {"id": f"e{i}", "actor": {"name": "n", "mbox": "mailto:a@example.com"}, "verb": {"id": "v", "display": {"en-US": "launched"}},
            "context": {"extensions": {"https://x/course_id": "C1"}}, "timestamp": "2024-01-01T00:00:00+00:00"} | more


@pytest.mark.parametrize("lines", [False, True])
def test_unknown_fields_survive(spark, tmp_path, lines):
    rows = [statement(0), statement(1, client={"os": "x", "build": 7}), statement(2, client={"os": "y", "tags": ["a"]}, rating=4.5), statement(3, rating="five")]
    texts = [json.dumps(r) for r in rows]
    (tmp_path / "a.json").write_text("\n".join([*texts, "", "{broken"]) if lines else "[" + ",".join(texts) + "]")
    bronze = variant.read_variant_events(spark, str(tmp_path), multiline=not lines)
    assert {r.field: r.statements for r in variant.undeclared_fields(bronze).collect()} == {"client": 2, "rating": 2}
    got = bronze.select(variant.field("$.id", "string").alias("id"), variant.field("$.client.build", "int").alias("build"),
                        variant.field("$.rating", "double").alias("rating")).where("id is not null").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("e0", None, None), ("e1", 7, None), ("e2", None, 4.5), ("e3", None, None)]
    schema = variant.observed_schema(bronze)
    assert "client" in schema and "tags: ARRAY" in schema
    assert bronze.where("statement is null").select("statement_text").collect() == ([("{broken",)] if lines else [])
    out = str(tmp_path / "bronze")
    bronze.write.parquet(out)
    flat = silver_events(variant.declared(spark.read.parquet(out)))
    want = silver_events(spark.read.schema(EVENT_SCHEMA).json(spark.sparkContext.parallelize(texts)))
    assert flat.count() == 4 and flat.exceptAll(want).count() == 0


def test_unions_count_a_learner_once(spark):
    silver = Binding(spark, SF_SMALL).silver
    cells = sketches.engagement_sketches(silver)
    got = sketches.union_over(cells, "course_id", "module_id", "hour_of_day").withColumnRenamed("unique_learners", "unique_learners_exact")
    want = reports.engagement_heatmap_exact(silver)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    whole = sketches.union_over(cells, "day_of_week").agg(F.sum("event_count")).first()[0]
    assert whole == silver.filter(F.col("verb").isin(*sketches.ENGAGED)).count()


def test_large_sets_are_near_the_exact_count(spark):
    rows = spark.range(300_000).select(
        F.concat(F.lit("l"), (F.col("id") % 60_000).cast("string")).alias("learner_email"), F.lit("c").alias("course_id"), F.lit("m").alias("module_id"),
        F.when(F.col("id") % 60_000 < 20_000, "completed").otherwise("interacted").alias("verb"), (F.col("id") % 60_000 < 20_000).alias("course_completed"),
        F.timestamp_seconds(F.col("id") * 37).alias("ts"))
    rows = rows.unionByName(rows.withColumn("verb", F.lit("launched")).where("learner_email like 'l1%'"))
    exact = rows.filter(F.col("verb").isin(*sketches.ENGAGED)).select("learner_email").distinct().count()
    union = sketches.union_over(sketches.engagement_sketches(rows), "course_id").first()
    assert union.unique_learners == pytest.approx(exact, rel=0.04)
    told = sketches.active_without_completion(rows).first()
    assert told.active == pytest.approx(exact, rel=0.04) and told.active_not_completed == pytest.approx(40_000, rel=0.05)


def test_a_build_that_stops_leaves_the_old_set(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    assert versions.current(spark, root) is None
    first = medallion.publish_tables(spark, root, sf_dir=SF_SMALL)
    opened = spark.read.parquet(f"{versions.current(spark, root)}/gold_course_completion")
    before = opened.count()
    written = []

    def stops(df, *args, **more):
        written.append(more.get("path"))
        if len(written) == 3:
            raise RuntimeError("lost")
        return real(df, *args, **more)
    real = medallion.write_table
    monkeypatch.setattr(medallion, "write_table", stops)
    with pytest.raises(RuntimeError):
        medallion.publish_tables(spark, root, sf_dir=SF_SMALL)
    assert versions.current(spark, root) == first and opened.count() == before
    monkeypatch.setattr(medallion, "write_table", real)
    # A set with another schema: readers of the old version keep it.
    second = versions.publish(spark, root, lambda folder: spark.range(3).write.parquet(f"{folder}/gold_course_completion"))
    assert versions.current(spark, root) == second != first and versions.current(spark, root, 1) == first
    assert spark.read.parquet(f"{second}/gold_course_completion").columns == ["id"] and opened.count() == before


def test_dimensions_with_a_record_per_line(spark, tmp_path):
    b = Binding(spark, SF_SMALL)
    for name, df, schema, read in (("courses", b.dim_courses, COURSE_SCHEMA, raw.read_courses), ("learners", b.dim_learners, LEARNER_SCHEMA, raw.read_learners)):
        some = df.select(*[c for c in schema.names if c in df.columns]).limit(40)
        lines = [r.j for r in some.select(F.to_json(F.struct("*")).alias("j")).collect()]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
        (tmp_path / f"{name}.json").write_text("[" + ",".join(lines) + "]")
        by_line, by_array = read(spark, str(tmp_path / f"{name}.jsonl"), multiline=False), read(spark, str(tmp_path / f"{name}.json"))
        assert by_line.count() == by_array.count() == 40
        assert sorted(r.j for r in by_line.select(F.to_json(F.struct("*")).alias("j")).collect()) == sorted(r.j for r in by_array.select(F.to_json(F.struct("*")).alias("j")).collect())
