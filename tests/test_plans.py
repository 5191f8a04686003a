"""Properties of the plans that make them hold at scale."""

import contextlib
import io

import pytest

from proofweave.operators import retrieval
from proofweave.plans import registry
from proofweave.sources import views

QUERIES = registry.queries()
#: Queries that run jobs of their own while the plan is built.
EAGER = {"fragments", "best_articulation", "community_summary", "communities", "stress_findings", "stress_score", "human_review", "priority", "pagerank", "components", "articulation", "cycles"}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_joins(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, data):
    text = plan(QUERIES["matrix_status"](spark, data))
    for column in ("rationale", "assertion", "quote", "text"):
        assert f"{column}:string" not in text, column
    assert "IsNull(deleted_at)" in text  # pushed into the scan


@pytest.mark.parametrize("name", ["keyword_topk", "page_headers", "clean_pages"])
def test_rank_filters_come_before_the_shuffle(spark, data, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, data))


def test_views_shuffle_only_what_is_read(spark, data):
    assert set(views.matrix_links(spark, data, "relation").columns) == {"evidence_id", "link_id", "prop_id", "relation"}
    assert "quote" in views.matrix_links(spark, data).columns


def test_ranking_sends_only_bounded_queries(spark, data, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert "MapInArrow" not in plan(QUERIES["bm25_topk"](spark, data))
    larger = data.replace("sf0.001", "sf0.01")  # the smallest tables hold no query
    assert "MapInArrow" not in plan(QUERIES["bm25_topk"](spark, larger)) and "SortMergeJoin" in plan(QUERIES["bm25_topk"](spark, larger))
