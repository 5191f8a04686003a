"""Scanned pages: furniture, broken and misread words, paragraphs."""

import pytest

from proofweave.llm import scans as S
from tests.conftest import rows

SHAPE = "doc_id string, pos int, page int, label string, text string, used_ocr boolean"
CLEAN = ["the finance director paid twice for the ledger bridge in the control room under a cost-saving agreement"] * 60


def scan(spark, cells):
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    return S.Scan(spark.createDataFrame([(d, p, g, "", t, True) for d, p, g, t in cells], SHAPE), clean)


CELLS = [
    ("D", 0, 1, "[Claim No. 7]\n1. The finance direc-\ntor paid twice for the ledgcr bridge\np. 1"),
    ("D", 1, 2, "[Claim No. 7]\nin the controI room under a cost-\nsaving agree-\np. 2"),
    ("D", 2, 3, "Claim No. 7 / 3\n\nment. On l7 occasions"),
    ("D", 2, 3, "Claim No. 7 / 3\n\nment. On l7 occasions"),
    ("D", 3, 3, None),
    ("D", 4, 3, " \n"),
    ("E", 0, None, "the ledger bridge"),
]


def test_noise(spark):
    got = rows(scan(spark, CELLS).noise())
    assert got == [
        ("D", 0, 0, "header"), ("D", 0, 1, "hyphen"), ("D", 0, 2, "misread"), ("D", 0, 3, "page_no"), ("D", 1, 0, "header"), ("D", 1, 1, "misread"), ("D", 1, 2, "hyphen"), ("D", 1, 3, "page_no"), ("D", 2, 0, "header"), ("D", 2, 2, "misread"),
    ]


def test_paragraphs(spark):
    got = {r["start_pos"]: r for r in scan(spark, CELLS).paragraphs().where("doc_id = 'D'").collect()}
    assert got[0]["text"] == "1. The finance director paid twice for the ledger bridge in the control room under a cost-saving agreement. On 17 occasions"
    assert (got[0]["first_page"], got[0]["last_page"]) == (1, 3)


def test_nothing(spark):
    s = scan(spark, [("D", 0, 1, None)])
    assert s.noise().count() == 0 and s.paragraphs().count() == 0


def test_neighbours_across_blocks(spark, monkeypatch):
    whole = rows(scan(spark, CELLS).noise())
    monkeypatch.setattr(S, "BLOCK", 1)
    s = scan(spark, CELLS)
    assert rows(s.noise()) == whole
    assert s.paragraphs().where("doc_id = 'D'").count() == 1


@pytest.mark.parametrize(("read", "printed", "cost"), [("vvas", "was", 0.5), ("corne", "come", 0.5), ("bu1lding", "building", 0.5), ("rnodem", "modern", 1.0), ("readings", "reading", None), ("form", "from", None)])
def test_distance(read, printed, cost):
    got = S.confusion_distance(read, printed)
    assert got == cost if cost is not None else got == float("inf")


def test_deletes():
    assert S.deletes("ab") == {"ab", "a", "b"} and len(S.deletes("abcd")) == 1 + 4 + 6


@pytest.mark.parametrize(("token", "want"), [("l7", True), ("2O23", True), ("£1,O45", False), ("1,O45", True), ("1st", False), ("P0001", False), ("2023", False), ("room", False), ("S88", True), ("EX00012", False)])
def test_figures(token, want):
    assert S._misread_number(token) is want


def test_deep_letterhead_and_long_stamp(spark):
    head = ["Quorndale Print Limited", "Registered office of the company", "Seventeen Harbour Lane Northolme", "Confidential to the parties and their experts in this matter and not to be copied to anyone else at all without leave"]
    cells = [("D", k, k, "\n".join([*head, f"The ledger bridge number {w} was seen", f"by the director of {w} on the day."])) for k, w in enumerate(["one", "two", "three"])]
    got = {(r["pos"], r["line_no"]) for r in scan(spark, cells).noise().where("noise = 'header'").collect()}
    assert got == {(k, n) for k in range(3) for n in range(4)}


def test_index_misses_no_allowed_repair():
    """Every word and every reading of it within the allowed cost meet in a form of the index."""
    words = ["in", "the", "time", "dock", "bridge", "crane", "month", "director", "ledger"]
    for printed in words:
        reads = {printed}
        for _ in range(2):
            reads |= {w[:i] + r + w[i + len(p) :] for w in reads for r, p in S._PAIRS for i in range(len(w)) if w.startswith(p, i)}
        for read in reads - {printed}:
            if S.confusion_distance(read, printed) <= S.MOST and abs(len(read) - len(printed)) <= 2:
                together = S.index_forms(read, True) & S.index_forms(printed, False)
                fits = len(set(S.deletes(read)) & set(S.deletes(printed))) > 0
                assert together or not fits, (read, printed)
    assert all(len(f) >= 3 for w in words if len(w) >= S.LONG for f in S.deletes(w))
