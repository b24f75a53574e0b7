"""Plans as they should be: narrow scans, pushed filters, no products of tables."""

import os

import pytest

from reelspark.plans import data_queries, reference_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_scans_read_few_columns_and_filters_are_pushed(spark):
    text = plan(reference_queries.representative_keyframe(spark, DATA))
    assert "PushedFilters: [IsNotNull(original_frame_id), IsNotNull(timestamp_sec), IsNotNull(video_id), IsNotNull(keyframe_uid)]" in text
    assert "ReadSchema: struct<keyframe_uid:string,video_id:string,original_frame_id:bigint,timestamp_sec:double>" in text
    text = plan(reference_queries.token_counts(spark, DATA))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["candidate_video_evidence", "bm25_topk", "cosine_topk", "mapping_summary", "keyframe_gaps", "refined_frames", "id_differences"])
def test_no_products_of_tables(spark, name):
    text = plan(reference_queries.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_top_rows_are_pruned_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(reference_queries.candidate_video_evidence(spark, DATA))


@pytest.mark.parametrize("name", sorted(data_queries.QUERIES))
def test_data_queries_have_stable_columns(spark, name):
    assert data_queries.QUERIES[name](spark, DATA).columns
