"""Physical plans keep the shape that large tables need."""

import os
import re

import pytest

import __spark_entry__
from lodestack.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hybrid_search", "lexical_rank_multi", "vector_topk_by_kind", "ingest_diff", "upsert_merge", "rag_context", "eval_summary"])
def test_no_cross_joins(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", ["lexical_rank_multi", "vector_topk_cosine"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p and p.index("WindowGroupLimit") < p.rindex("WindowGroupLimit")  # in each task, and again after


def test_columns_and_filters_reach_the_scan(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, "estimate_tokens")
    assert "ReadSchema: struct<source:string,text:string>" in plan(spark, "ingest_run_counters") or "ReadSchema: struct<text:string,source:string>" in plan(spark, "ingest_run_counters")
    assert re.search(r"PushedFilters: \[[^\]]*In\(source, \[src1,src3,src5\]\)", plan(spark, "vector_topk_by_kind"))
    assert "TakeOrderedAndProject" in plan(spark, "keyset_page")


def test_a_search_reads_its_index_and_not_the_documents(spark):
    for name in ("lexical_rank_multi", "hybrid_search", "rag_context"):
        p = plan(spark, name)
        assert "documents.parquet" not in p  # texts are analysed once, at ingest
    bodies = lambda name: len(re.findall(r"ReadSchema: struct<[^>]*\bbody:string", plan(spark, name)))
    assert (bodies("hybrid_search"), bodies("rag_context")) == (0, 1)  # texts are joined to results that show them
    p = plan(spark, "lexical_rank_multi")
    assert len(re.findall(r"ReadSchema: struct<term:string", p)) == 1 and re.search(r"PushedFilters: \[[^\]]*In\(term", p)


def test_segments_are_cut_without_a_shuffle(spark):
    from lodestack.operators.ingest import to_segments
    from lodestack.plans import corpus

    cut = to_segments(corpus.docs(spark, SF).select("doc_id", "title", "body"), 200)
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
    lines = corpus.segments(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("HashAggregate|SortAggregate|Window", lines)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "position", "external_id", "score", "title", "kind", "total"]
