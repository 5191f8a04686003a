"""Citations, quotes and rule checks."""

import pytest

from proofweave.operators import grounding as C
from proofweave.operators import stress as T
from proofweave.plans import registry
from proofweave.sources import views
from tests.conftest import rows

SOURCE = "the quick brown fox jumps over the lazy dog near the river bank"


def test_ratio():
    form = C.guard_form
    assert C.window_ratio(form("quick brown fax jumps over"), SOURCE) == pytest.approx(0.9231, abs=1e-4)
    assert C.window_ratio(form("completely different words here"), SOURCE) == pytest.approx(0.3548, abs=1e-4)
    assert C.window_ratio(form("The QUICK, brown fox"), SOURCE) == 1.0
    assert C.window_ratio("", SOURCE) == 0.0


def test_citations_and_guard(spark):
    bundle = spark.createDataFrame([("¶80", SOURCE), ("D1", "other text")], "source_id string, text string")
    cited = spark.createDataFrame([("a", "para 80", "the quick brown fox"), ("b", "80", "quick brown fax jumps over"), ("c", "D9", "x"), ("d", "D 1", "nothing of the kind stands here"), ("e", "D1", "  "), ("f", "80", None)], "claim_id string, source_id string, quote string")
    checks = C.verify_citations(cited, bundle)
    assert rows(checks, "claim_id", "status") == [("a", "exact"), ("b", "fuzzy"), ("c", "fabricated_src"), ("d", "misquote"), ("e", "no_quote"), ("f", "no_quote")]
    assert rows(C.guard(checks), "claim_id", "verified") == [("a", True), ("b", True), ("c", False), ("d", False), ("e", False), ("f", False)]
    assert rows(C.quarantine_reasons(checks))[0] == ("c", "D9: fabricated_src")


def test_packs_keep_every_quote(spark, monkeypatch):
    monkeypatch.setattr(C, "QUOTES_PER_COPY", 2)
    quotes = spark.createDataFrame([(f"e{i}", "D", f"sentence number {i}") for i in range(9)] + [("x", "none", "sentence number 1")], "id string, doc_id string, quote string")
    docs = spark.createDataFrame([("D", " ".join(f"Sentence number {i}." for i in range(0, 9, 2)))], "doc_id string, full_text string")
    assert rows(C.quotes_in_sources(quotes, docs), "id", "quote_ok") == [(f"e{i}", i % 2 == 0) for i in range(9)]


def test_score(spark):
    found = spark.createDataFrame([("critical",)] * 2 + [("high",)] * 8 + [("medium",)], "severity string")
    assert tuple(T.score(found).first()) == (41, 2, 8, 1, 0, 0)
    assert T.score(found.limit(0)).first()["score"] == 100


def test_every_citation_is_checked(spark, data):
    cited = rows(views.evidence(spark, data, "evidence_id"))
    for name in ("verify_citations", "guard"):
        assert rows(registry.queries()[name](spark, data), "claim_id") == cited
