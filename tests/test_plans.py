"""Scale properties of the physical plans, kept as regression tests."""

import io
import re
import uuid
from contextlib import redirect_stdout

import pytest

from coursemetrics.operators import search
from coursemetrics.plans import registry
from paths import SF_SMALL

TOP_K = {"vector_top_k", "filtered_vector_top_k", "keyword_top_k", "hybrid_search", "filtered_hybrid_search", "search_by_skills"}


def _plan(spark, name):
    buf = io.StringIO()
    with redirect_stdout(buf):
        registry.QUERIES[name](spark, SF_SMALL).explain("formatted")
    return buf.getvalue()


#: Spark's own scorer for matrix factors joins blocks of thousands of learners with blocks of courses, not rows.
FACTOR_BLOCKS = {"factor_recommendations", "factor_recommendation_counts"}


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith("stream_") and n not in FACTOR_BLOCKS))
def test_no_cross_joins_or_expand(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan), name
    assert not re.search(r"\bExpand\b", plan), name


@pytest.mark.parametrize("name", sorted(TOP_K))
def test_top_k_limits_before_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit.*Partial|Partial.*WindowGroupLimit", _plan(spark, name), re.S), name


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "gold_course_completion")
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double,props:string>" in plan


def test_searches_of_one_block_run_nothing_when_built(spark):
    """With the number of request blocks given, no job runs before the frame is used; otherwise one count of the requests does."""
    def jobs(run):
        group = f"plan-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, "building a plan")
        try:
            run()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    docs = spark.createDataFrame([(1, "a b", [1.0, 0.0])], "doc_id long, text string, vector array<double>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, query_text string, query_vector array<double>")
    for find in (search.vector_top_k, search.keyword_top_k, search.hybrid_search):
        assert jobs(lambda: find(docs, asked, 2, request_blocks=1)) == 0
        assert jobs(lambda: find(docs, asked, 2)) > 0


def test_search_moves_no_documents(spark):
    """The shuffles of keyword search carry counts and top rows only, never texts or tokens."""
    plan = _plan(spark, "keyword_top_k")
    for part in re.findall(r"\) Exchange\n.*\nArguments", plan):
        assert "text" not in part and "toks" not in part


@pytest.mark.parametrize("name", ["at_risk_learners", "training_features", "course_learner_features"])
def test_distinct_counts_collect_no_sets(spark, name):
    assert "ObjectHashAggregate" not in _plan(spark, name)
