"""Physical plans: what reaches the scan, and what runs once."""

import os

import pytest

from sitefold import schemas
from sitefold.operators import discovery, rewrite
from sitefold.plans import export, stand_ins
from sitefold.plans.options import ExportOptions
from sitefold.sources import rest

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([("s", "posts", 1, 200, "{}")], schemas.API_ITEMS).write.parquet(path)
    known = spark.createDataFrame([("s", "posts", 2)], "site string, content_type string, id long")
    plan = plan_of(discovery.discovered_items(spark.read.parquet(path), known, 10))
    pushed = plan[plan.index("PushedFilters: ["):].split("]")[0]
    for condition in ("EqualTo(status,200)", "GreaterThanOrEqual(id,1)", "LessThanOrEqual(id,10)"):
        assert condition in pushed


def test_bodies_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("s", "tags", 1, 200, '[{"id":1}]')], schemas.API_PAGES).write.parquet(path)
    plan = plan_of(rest.scan_tags(spark.read.parquet(path)))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("posexplode(from_json(") == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_an_export_rewrites_posts_once(spark, monkeypatch):
    """All jobs of an export read the landed posts: none of their plans looks for URLs again."""
    calls = []
    plain = rewrite.rewrite_media_links
    monkeypatch.setattr(rewrite, "rewrite_media_links", lambda *a, **k: calls.append(1) or plain(*a, **k))
    options = ExportOptions(output_format="markdown")
    prepared = export.prepare(stand_ins.store_content(spark, SF_DIR), "/export", options)
    searched = "url_hash"
    urls = rewrite.replacements(stand_ins.store_media(spark, SF_DIR))
    assert searched in plan_of(rewrite.rewrite_candidates(stand_ins.store_posts(spark, SF_DIR), urls))
    for df in (export.json_lines(prepared, options), export.metadata_lines(prepared, options), export.markdown_documents(prepared, options)):
        assert searched not in plan_of(df)
    assert len(calls) == 1
