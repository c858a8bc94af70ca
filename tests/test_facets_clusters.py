"""Facet counts from bitmaps against plain counts; range-clustered silver files and what a lookup reads of them."""

import glob
import itertools
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from coursemetrics.operators import facets
from coursemetrics.plans.medallion import build_tables
from coursemetrics.sources.sinks import write_clustered
from paths import SF_SMALL

DOCS = "department string, skill_level string, format string, skills_taught array<string>, duration_hours double, bits int"
FILTERS = [("department", "department", "eq"), ("skill_level", "bits", "eq"), ("duration_hours", "value", "le")]
REQUESTS = "department string, bits string, value double, bucket int"


def courses(n, seed=1):
    rng = np.random.default_rng(seed)
    def one(values):
        return [values[i] for i in rng.integers(0, len(values), n)]
    rows = list(zip(one(["a", "b", None]), one(["x", "y"]), one(["f", "g", ""]), one([["s", "t"], ["s", "s"], [], None, ["u", None]]),
                    one([0.0, 1.5, 2.0, 7.0, None]), one([1])))
    return rows


def plain(rows, requests):
    """Counts by reading every document for every filter."""
    out = Counter()
    for dept, level, most in {r[:3] for r in requests}:
        for d in rows:
            if (dept is None or d[0] == dept) and (level is None or d[1] == level) and (most is None or (d[4] is not None and d[4] <= most)):
                for field, values in (("department", [d[0]]), ("skill_level", [d[1]]), ("format", [d[2]]), ("skills_taught", set(d[3] or ()))):
                    for v in values:
                        out[dept, level, most, field, v] += 1
    return dict(out)


@pytest.mark.parametrize("block, shares", [(256, 16), (3, 1)])
def test_facets_of_hits_equal_plain_counts(spark, tmp_path, monkeypatch, block, shares):
    monkeypatch.setattr(facets, "BLOCK", block)
    monkeypatch.setattr(facets, "SHARES", shares)
    rows = courses(400)
    requests = [(*r, i) for i, r in enumerate(itertools.product(["a", "b", "none", None], ["x", None], [-1.0, 0.0, 1.7, 9.0, None]))] * 2
    index = facets.build_facets(spark.createDataFrame(rows, DOCS).repartition(5), str(tmp_path))
    assert index.bits.select("bucket").distinct().count() > 1
    found = facets.facets_of_hits(index, spark.createDataFrame(requests, REQUESTS), FILTERS)
    assert found.columns == ["department", "bits", "value", "facet", "value", "count"]
    got = [tuple(r) for r in found.collect()]
    assert {r[:5]: r[5] for r in got} == plain(rows, requests) and len(got) == len({r[:5] for r in got})


def test_facets_without_documents_filters_or_requests(spark, tmp_path):
    docs = spark.createDataFrame(courses(50), DOCS)
    asked = spark.createDataFrame([("a", None, None, 1)], REQUESTS)
    assert facets.facets_of_hits(facets.build_facets(docs.limit(0), str(tmp_path / "none")), asked, FILTERS).count() == 0
    index = facets.build_facets(docs, str(tmp_path / "some"))
    assert facets.facets_of_hits(index, asked.limit(0), FILTERS).count() == 0
    whole = facets.facets_of_hits(index, spark.createDataFrame([(None, None, None, 1)], REQUESTS), FILTERS)
    assert whole.where("facet = 'format'").agg(F.sum("count")).first()[0] == 50


def rows_scanned(df):
    """Rows that the plan's scans gave out, after row groups were left out."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_clustered_files_hold_ranges_and_lookups_skip_row_groups(spark, tmp_path):
    path, n = str(tmp_path / "silver"), 200_000
    silver = spark.range(n).select(F.when(F.col("id") % 3 == 0, "COURSE-0500").otherwise(F.format_string("COURSE-%04d", F.col("id") % 1000)).alias("course_id"),
                                   F.concat(F.lit("u"), F.col("id") % 2000).alias("learner_email"), "id")
    write_clustered(silver, path, files=24, ndv=20_000, row_group_bytes=64 << 10)
    files = glob.glob(f"{path}/*.parquet")
    assert 12 <= len(files) <= 24
    ranges = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        ranges.append((min(g.min for g in groups), max(g.max for g in groups)))
    ranges.sort()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    # A third of all rows has one course: it is split over files, the other courses are in one file or two.
    assert sum(lo <= "COURSE-0500" <= hi for lo, hi in ranges) >= 6 and sum(lo <= "COURSE-0007" <= hi for lo, hi in ranges) <= 2
    back = spark.read.parquet(path)
    assert back.count() == n and back.agg(F.sum("id")).first()[0] == n * (n - 1) // 2
    one = back.where("course_id = 'COURSE-0007'")
    assert one.count() == silver.where("course_id = 'COURSE-0007'").count() and rows_scanned(one) < n / 8
    absent = back.where("learner_email = 'u1999x'")     # between the least and greatest name everywhere: Bloom filters or dictionaries tell
    assert absent.count() == 0 and rows_scanned(absent) < n / 8


def test_clustered_silver_in_the_build(spark, tmp_path):
    paths = build_tables(spark, str(tmp_path), sf_dir=SF_SMALL, clustered=True)
    plain_paths = build_tables(spark, str(tmp_path / "plain"), sf_dir=SF_SMALL)
    for name in ("gold_course_completion", "gold_engagement_hourly"):
        a, b = spark.read.parquet(paths[name]), spark.read.parquet(plain_paths[name])
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert not glob.glob(f"{paths['silver_xapi_events']}/course_id=*")
    with pytest.raises(ValueError):
        build_tables(spark, str(tmp_path), sf_dir=SF_SMALL, fmt="orc", clustered=True)
