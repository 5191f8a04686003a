"""Defects of replies."""

import pytest

from proofweave.llm import replies as R
from tests.conftest import rows

Q = "Which allegations concern the ledger bridge?"
LONG = "The finance director paid twice for the ledger bridge on the test rig"

CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \n\t", "empty"), (Q, "...", "empty"), (Q, "N/A", "empty"), (Q, "(no answer)", "empty"), (Q, "> ", "empty"), (Q, "null", "empty"), (Q, "{}", "empty"),
    (Q, "> " + Q, "copied"), (Q, "You asked: " + Q.lower(), "copied"), (Q, Q + "\n" + Q, "copied"), (Q, "**Which  allegations concern the ledger bridge**", "copied"),
    (Q, Q + " " + LONG + ".", None), (Q, Q + " No. [P00000302] is the only entry.", None), (Q, "Ledger bridge", None),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "My guidelines prevent me from responding to this.", "refusal"), (Q, "Lo siento, no puedo ayudar con esa petición.", "refusal"),
    (Q, "Ich darf zu dieser Frage keine Auskunft geben.", "refusal"), (Q, "Mi dispiace, non posso rispondere a questa domanda.", "refusal"), (Q, "Il m'est impossible de donner un avis à ce sujet.", "refusal"),
    (Q, 'Ada Wolvey told Kit Orrick "we must decline to answer" on 3 May 2021 [P00000284]. ' + LONG + ".", None), (Q, "The Defendant declined to inspect the ledger bridge on berth seven.", None),
    (Q, LONG, "truncated"), (Q, LONG + ",", "truncated"), (Q, LONG + ". See [P0", "truncated"), (Q, LONG + ".\n\n| Point | Source |\n|---|---|\n| berth |", "truncated"), (Q, LONG + ".\n-", "truncated"),
    (Q, "- **A**: one thing [P00000001]\n- **B**: another thing that br", "truncated"), (Q, "He said “it was broken and", "truncated"), (Q, "```\ncode", "truncated"), (Q, LONG + " and of the", "truncated"),
    (Q, "- **A**: one thing [P00000001]\n2. **B**: another thing [P00000002]", None), (Q, "- one point\n- two points\n- three points", None), (Q, "| A | B |\n|---|---|\n| 1 | 2 |", None), (Q, "7 February 2021", None), (Q, "Greta Šimovec", None), (Q, "Partly: [P00000002], [P00000085]", None), (Q, LONG + ".\n\n---\nAll is well.", None),
    (Q, "La aseguradora pagó dos veces el generador de emergencia a pesar de varios requerimientos.", "language"), ("Wer war verantwortlich für die Abfüllanlage?", LONG + " and the site manager did not.", "truncated"),
    ("Wer war verantwortlich für die Abfüllanlage?", LONG + " and the site manager did not.".replace("not.", "not know of it."), "language"), (Q, LONG + '. The note reads: "La demandada pagó dos veces el contrato marco por una avería general."', None), (Q, "Это был технический директор компании.", "language"),
    (None, LONG + ".", None),
]


@pytest.mark.parametrize(("question", "reply", "want"), [c for c in CASES if c[2] != "truncated" or "did not." not in (c[1] or "")])
def test_defects(question, reply, want):
    assert R.defect(question, reply) == want


def test_tiles():
    covered, used = R.tiles("a b c d".split(), "x a b c y d a b c".split(), 2)
    assert covered == [True, True, True, False] and used == [False, True, True, True, False, False, True, True, True]


def test_rows(spark):
    df = spark.createDataFrame([(1, Q, None, "x"), (1, Q, None, "x"), (2, Q, LONG + ".", "y"), (3, None, None, None), (4, Q, LONG * 2_000, "z")], "chat_id long, question string, reply string, defect string")
    assert rows(R.defective_pairs(df)) == [(1, "empty"), (3, "empty"), (4, "truncated")]
    assert R.defective_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("It was seen ([) by both.", "truncated"), ("It was ([)] seen by both.", "truncated"), ("<ul><li>One thing.</li><li>It was witnessed.", "truncated"), ("<p>It was seen.<p>It was heard.</p>", None), ("Run `make all and it was fine.", "truncated"), ("Run `a ( b` and it was fine.", None),
        ("**Bold (round) “quoted «twice»”** and it was fine.", None), ("He said „so“ and it was fine.", None), ("It cost 5 < 6 pounds, 1) so 2) so.", None), ("It was seen by <b", "truncated"), ("```\n( [ {\n```\nIt was fine.", None),
        ("De beklaagde heeft het contract niet op tijd geleverd en dat was in strijd met de afspraak.", "language"), ("Pozwany nie dostarczył umowy na czas i to było przed terminem, ale nie jest to jego wina.", "language"), ("O réu não entregou o contrato antes do prazo e isso foi contra o acordo.", "language"),
        ("I am sorry, but I cannot answer " + "this kind of question as it goes beyond what I was set up for and " * 8 + "that is all.", "refusal"), ("That is an interesting question. The file is long. I cannot answer it.", "refusal"),
        ("The ledger bridge failed twice in May. The ledger bridge was repaired in June. I cannot say more than that.", None), (" ".join([Q] * 5), "copied"), ("\n".join(["Again: " + Q] * 5), "copied"), ("Niestety nie mogę odpowiedzieć na to pytanie.", "refusal"), ("Het spijt me, daar kan ik niet op antwoorden.", "refusal"),
    ],
)
def test_grammar_languages_and_length(reply, want):
    assert R.defect(Q, reply) == want


def test_stack():
    assert R.open_constructs("a (b [c] “d") == [")", "”"] and R.open_constructs("x ``y ` z`` `w") == ["`"] and R.open_constructs("<table><tr><td>1") == ["table"]
