"""Every core query with an SQL twin gives the same rows as DuckDB on the smallest tables; the others run."""

import pytest

from proofweave.plans import registry
from tests.conftest import same

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck.execute(ORACLE[name]).df())


def _citations(got, spark, data):
    cited = QUERIES["verify_quote"](spark, data).count()
    assert len(got) >= cited and {r["status"] for r in got} <= {"exact", "fuzzy", "misquote", "no_quote", "fabricated_src"}
    assert all((r["score"] >= 0.999) == (r["status"] == "exact") for r in got if r["status"] not in ("no_quote", "fabricated_src"))


def _guarded(got, spark, data):
    assert all(r["verified"] == (r["n"] == r["n_ok"]) and r["n_ok"] <= r["n"] for r in got) and len({r["claim_id"] for r in got}) == len(got)


def _labelled(got, spark, data):
    """Every vertex once, the communities numbered from 0 by size."""
    vertices = {r["id"] for r in QUERIES["components"](spark, data).collect()}
    ids = [r["id"] for r in got]
    sizes = [sum(r["community"] == k for r in got) for k in range(len({r["community"] for r in got}))]
    assert len(ids) == len(set(ids)) and vertices <= set(ids) and sizes == sorted(sizes, reverse=True) and min(sizes) > 0


def _summarised(got, spark, data):
    assert all(r["size"] == r["propositions"] + r["evidence"] and r["propositions"] > 0 for r in got)


CHECKS = {"verify_citations": _citations, "guard": _guarded, "communities": _labelled, "communities_synchronous": _labelled, "community_summary": _summarised}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_twin(spark, data, name):
    got = QUERIES[name](spark, data).collect()
    assert got
    CHECKS[name](got, spark, data)


def test_twins_have_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["prop_id", "status", "n_links", "n_strong"]
