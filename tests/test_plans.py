"""What the physical plans of some operators must look like."""

import re

import pytest

from fathomline.operators import graph, hotkeys, incremental, ingest, rollup, search
from fathomline.tables import newest_row
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    spark.range(1000).selectExpr("cast(id as string) id", "'calls' kind", "cast(id % 7 as string) src_id", "cast(id % 3 as string) dst_id", "'f' file_path", "cast(id as int) start_line", "'{}' metadata_json", "'h' content_hash", "id last_seen_at").write.parquet(f"{root}/edges")
    spark.range(1000).selectExpr("id", "concat('d', id % 9, '/f') path", "'function' kind", "'n' name", "cast(id as int) start_line", "cast(id + 3 as int) end_line", "sha1(cast(id as string)) content_sha1", "repeat('x ', 50) content", "array(cast(id as float)) vec", "id last_seen_at").write.parquet(f"{root}/chunks")
    return spark.read.parquet(f"{root}/edges"), spark.read.parquet(f"{root}/chunks")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _columns(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", plan)]


def test_scans_read_only_what_is_used(tables):
    edges, chunks = tables
    assert _columns(_plan(hotkeys.key_profile(edges, "dst_id", "src_id"))) == [{"dst_id", "src_id"}]
    assert all(c <= {"src_id", "dst_id", "kind"} for c in _columns(_plan(graph.degrees(edges.where("kind = 'calls'").select("src_id", "dst_id").distinct()))))
    assert _columns(_plan(ingest.covered_gaps(chunks))) == [{"path", "start_line", "end_line", "kind"}]
    assert all("content" not in c and "vec" not in c for c in _columns(_plan(rollup.package_keys(chunks))))
    assert _columns(_plan(newest_row(chunks, "id", "last_seen_at", "name"))) == [{"id", "last_seen_at", "name"}]


def test_filters_reach_the_scan(tables):
    edges, chunks = tables
    assert "EqualTo(kind,calls)" in _plan(graph.call_sites(edges, edges.select("id"), edges.selectExpr("id", "1 in_degree"), True, 5, edges.select("id")))
    assert "GreaterThanOrEqual(last_seen_at,500)" in _plan(chunks.where("last_seen_at >= 500").select("id"))
    assert "IsNotNull(dst_id)" in _plan(hotkeys.key_profile(edges, "dst_id", "src_id"))


def test_skewed_keys_are_combined_before_the_shuffle(tables):
    edges, chunks = tables
    plan = _plan(hotkeys.key_profile(edges, "dst_id", "src_id"))
    assert plan.count("partial_count") >= 2 and plan.count("Exchange") == 2
    top = _plan(rollup.newest_per(chunks.select("path", "id"), ["path"], [F.desc("id")]))
    assert "WindowGroupLimit" in top.split("Exchange")[-1], "each task passes on its own first row only"


def test_rankings_are_top_k(tables):
    _, chunks = tables
    query = chunks.limit(1).select(F.col("vec").alias("qvec"))
    assert "TakeOrderedAndProject" in _plan(search.knn(chunks, query, 5))
    assert "CartesianProduct" not in _plan(search.knn(chunks, query, 5))


def test_no_range_join_in_pruning(tables):
    _, chunks = tables
    plan = _plan(ingest.prune(chunks.select("id", "path", "kind", "last_seen_at"), 10))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    anti = _plan(incremental.unprocessed_versions(chunks, chunks.selectExpr("path record_key", "content_sha1 content_hash"), "path", "content_sha1", "id", "last_seen_at"))
    assert "LeftAnti" in anti and "NestedLoop" not in anti
