"""Text functions against hand-worked values and small models in Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofweave.functions import text as X
from proofweave.operators import layout as L


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_citation_keys(spark):
    for raw in ("¶80", "para 80", "Paragraph 080", "80", "§80", "８０"):
        assert one(spark, X.citation_key, raw) == "para:80"
    assert one(spark, X.citation_key, "WITN10490100 ¶80") == "witn10490100para80"


def test_quotes(spark):
    found = lambda q, s: one(spark, lambda a, b: X.quote_found(X.quote_form(a), X.quote_form(b)), q, s)
    assert not found("short", "a short text")
    assert found("It’s “Fully” Tested", "we said its fully   tested twice")
    assert not found(None, "anything at all")


def test_sentences(spark):
    assert one(spark, X.sentences, 'One a. Two b; "Three. x Four. Y.') == ['One a. Two b; "Three. x Four. Y.']
    long = "This is a first sentence of some length. Here is the second sentence, also long; And a third one follows here. Ltd."
    assert one(spark, X.sentences, long) == ["This is a first sentence of some length.", "Here is the second sentence, also long;", "And a third one follows here. Ltd."]
    assert one(spark, X.sentences, "  ") == []


def model_sentences(text):
    out = []
    for piece in re.split(r"(?<=[.;])\s+(?=[\"'(A-Z])", text):
        piece = piece.strip()
        if piece and out and len(piece) < 20:
            out[-1] += " " + piece
        elif piece:
            out.append(piece)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB.;(\"' é", max_size=60), min_size=1, max_size=20))
def test_sentences_as_modelled(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", X.sentences(F.col("t")).alias("s")).collect()}
    assert got == {i: model_sentences(t) for i, t in enumerate(texts)}


def test_tokens(spark):
    assert one(spark, X.tokens, "The Café's 2 risk-registers, a RISK") == ["caf", "risk", "registers", "risk"]
    assert one(spark, X.tokens, None) == []


@pytest.mark.parametrize(("text", "label"), [("12. On that day", "12."), ("(a) x", "(a)"), ("iv) x", "iv)"), ("no label", "")])
def test_labels(spark, text, label):
    assert one(spark, X.label_of, text) == label


def test_kinds(spark):
    kind = lambda o, t="": one(spark, X.document_kind, o, t)
    assert kind("witness statement of x, counterclaim") == "witness_statement"
    assert kind("the defence") == "pleading"
    assert kind("exhibit one") == "exhibit"
    assert kind("letter") == "other"


def test_small_ones(spark):
    assert one(spark, X.party_of, "Reply to Defence") == "Defendant"
    assert one(spark, X.party_of, "Particulars") == "Claimant"
    assert one(spark, X.ellipsis, "x " * 80) == ("x " * 44).strip() + " …" or one(spark, X.ellipsis, "x " * 80).endswith("…")
    assert one(spark, X.question_form, "  Where is   this WEAKEST?! ") == "where is this weakest"
    assert "".join(one(spark, X.chunks, "a  b\nc ")) == "a  b\nc "
    assert one(spark, X.navigation, "please go to the financial overview") == "damages"
    assert one(spark, X.navigation, "what of the damages") is None
    assert one(spark, X.headline, "x HEADLINE: Big news\nmore\n\nsecond") == "Big news"
    assert one(spark, X.narrative_paragraphs, "x HEADLINE: Big news\nmore\n\nsecond") == ["more", "second"]
    assert one(spark, X.title_from_name, "07_Letter_of_claim") == "Letter of claim"
    assert one(spark, X.fix_glyphs, "| think it�s “so”") == "I think it's \"so\""
    assert one(spark, X.concepts, "Damages and GOOD FAITH") == ["good faith", "damages"]
    assert one(spark, lambda c: X.padded_concepts(X.concepts(c)), "damages") == ["damages", "contract", "evidence"]
    assert one(spark, lambda a, b: X.citation_label(a, b), "D1", " 2. ") == "D1 ¶2."
    assert spark.range(1).select(X.money(F.lit(-1234567.4))).first()[0] == "-£1,234,567"


def test_reflow(spark):
    text = "1. A wrapped\nline that goes hyph-\nenated on.\n2. Next item\n\nLoose end\nof text"
    assert one(spark, L.reflow, text) == ["1. A wrapped line that goes hyphenated on.", "2. Next item", "Loose end of text"]
    assert one(spark, L.reflow, "") == []


def test_headers_and_metadata(spark):
    rows = [("D", p, 0, f"STAMP\nWitness Name: Ada\nPage {p} of 4\nbody {p}\nSTAMP too late") for p in range(1, 5)] + [("E", 1, 0, "STAMP"), ("E", 2, 0, None)]
    lines = L.lines(spark.createDataFrame(rows, "doc_id string, page int, pos int, text string"))
    heads = L.page_headers(lines)
    assert [(r["doc_id"], r["line"], r["n"]) for r in heads.orderBy("doc_id", "line").collect()] == [("D", "STAMP", 4), ("D", "Witness Name: Ada", 4)]
    assert {r["line"] for r in L.clean_lines(lines, heads).where("doc_id = 'D'").collect()} == {"body 1", "body 2", "body 3", "body 4", "STAMP too late"}
    assert [(r["key"], r["value"]) for r in L.metadata(lines).collect()] == [("witness_name", "Ada")]
