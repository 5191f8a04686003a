"""Pieces of oversized texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofweave.llm import splitting as S
from tests.conftest import rows


def check(text, limit, overlap):
    cut = S.split_points(text, limit, overlap)
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cut)
    if len(text) > limit:
        assert len(cut) > 1
    for (_, end), (start, later) in zip(cut, cut[1:], strict=False):
        assert start == end - overlap and later > end
    return cut


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .;,\né", max_size=900), st.integers(100, 200), st.integers(0, 30))
def test_limits(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_places():
    text = " ".join(f"Sentence number {i} ends here." for i in range(100))
    for _, end in check(text, 300, 40)[:-1]:
        assert text[end - 1] == "."
    clauses = "; ".join(f"clause number {i} of the list" for i in range(100))
    for _, end in check(clauses, 300, 40)[:-1]:
        assert clauses[end - 1] == ";"


def test_no_blanks_and_balance():
    cut = check("x" * 5_000, 1_200, 120)
    sizes = [b - a for a, b in cut]
    assert len(cut) == 5 and max(sizes) - min(sizes) <= 2 * S.STRETCH
    check("é" * 3_000, 1_200, 120)


def test_long_text():
    check("A sentence of the usual kind, with a comma. " * 20_000, 1_200, 120)


def test_bad_overlap():
    with pytest.raises(ValueError, match="overlap"):
        S.split_points("x" * 500, 100, 90)


def test_rows(spark):
    shape = "doc_id string, paragraphs array<struct<page:int,label:string,text:string>>, extra string"
    docs = spark.createDataFrame([("A", [(1, "", "x " * 800), (1, None, "short"), (2, "", None)], "e"), ("A", [(1, "", "x " * 800), (1, None, "short"), (2, "", None)], "e"), ("B", None, "e"), ("C", [], "e"), ("D", [(1, "", "y " * 500)] * 16, "e")], shape)
    items = S.oversized(docs)
    assert rows(items, "doc_id", "pos") == [("A", 0), ("D", -1)]
    pieces = S.split_items(items)
    assert pieces.where("doc_id = 'A'").count() == 2
    joined = {}
    for r in sorted(pieces.where("pos = -1").collect(), key=lambda r: r["piece_no"]):
        joined["t"] = joined.get("t", "")[: r["start_at"]] + r["text"]
    assert joined["t"] == "\n".join(["y " * 500] * 16)
    assert S.split_items(items.limit(0)).count() == 0
