"""Template residue: labels, models and rows."""

import pytest

from proofweave.llm import residue as R
from tests.conftest import rows

SOUND = "The finance director paid twice for the ledger bridge on the test rig because the budget had been cut by a fifth. "


def account(n):
    return "".join(f"On day {k} the {w} was handed over to the site manager after the guarantee had lapsed. " for k, w in zip(range(n), ["ledger bridge", "pump array", "test rig", "side letter", "site diary"] * n, strict=False))


@pytest.fixture(scope="module")
def docs(spark):
    cells = []
    for i in range(120):
        host = f"h{i % 20}"
        cells.append((i, account(1 + i % 4) + f"Under clause {i}, the works were late.", host))
        cells.append((1_000 + i, ["Page not found (404). Incident 21635.", "JavaScript is disabled in your browser, so the bundle cannot be displayed.", "Lorem ipsum dolor sit amet consectetur adipiscing. Lorem dolor elit eiusmod."][i % 3], host))
        slot = ["{{claimant_name}}", "[INSERT DATE]", "<<WITNESS>>", "${total_due}", "[●]", "%%DATE%%"][i % 6]
        cells.append((2_000 + i, SOUND + f"I was told by {slot} that the works were late. " + account(2), host))
        cells.append((3_000 + i, SOUND + f"The expert explains that {slot} is a marker which the script never filled. The sum [sic] was £14 and [redacted] in part.", host))
        cells.append((4_000 + i, SOUND + 'The till screen showed "Internal Server Error" to every cashier. ' + account(2), host))
    cells += [(9_000, None, None), (9_001, "", "h1"), (9_002, " \n", "h1"), (9_003, "Short.", "h2"), (9_004, account(5_000), "h3")]
    return spark.createDataFrame(cells, "doc_id long, text string, source string").selectExpr("*", "'x' as open_slot")


def test_found(docs):
    got = {r["doc_id"] for r in R.residue(docs).collect()}
    assert got == {d for d in range(1_000, 3_000) if d % 1_000 < 120}


def test_unseen_hosts(docs):
    for name, n_train, n_valid, hit, wrong, missed in R.train(docs)[1]:
        assert n_train > n_valid > 0, name
        assert hit >= 0.9 * (hit + missed) and hit >= 0.9 * (hit + wrong)


def test_empty(docs):
    assert R.residue(docs.limit(0)).count() == 0
    assert rows(R.residue(docs.where("doc_id in (5, 9000)"))) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("Error 503. Try again later.", 1), (SOUND, 0), ("Your statement goes here. " * 5, 1), ("Baumvit queumlor quebaex ira turirasol tursoldistur.", 1), ('Customers were told "please enable JavaScript" by the help desk of the works.', 0), ("The link to tab_369.html is broken or has been removed.", 1)],
)
def test_weak_labels(text, want):
    assert R.weak_page(text) == want


def test_hand_labelled(spark):
    """The models alone, trained on the documents of the test data, against labels that no rule gave."""
    import os

    import pyarrow as pa

    from tests.llm.residue_cases import CASES, SLOTS

    folder = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("needs the test data")
    models, report = R.train(spark.read.parquet(folder))
    for name, _, n_valid, hit, wrong, missed in report:
        assert n_valid > 50 and hit >= 0.95 * (hit + missed) and hit >= 0.95 * (hit + wrong), name
    for cases, which, precise in ((CASES, 1, 0.9), (SLOTS, 0, 0.8)):
        got = R.found(pa.array([t for _, t in cases]), models, R.Words())[which]
        hits = sum(bool(g) and y for (y, _), g in zip(cases, got, strict=True))
        assert hits >= 0.9 * sum(y for y, _ in cases) and hits >= precise * sum(map(bool, got)), [(y, t) for (y, t), g in zip(cases, got, strict=True) if bool(g) != bool(y)]


def test_long_and_broken_slots(spark, docs):
    models, _ = R.train(docs)
    import pyarrow as pa

    long = SOUND + "I was told by {{" + "the full name of the claimant as it stands in the register " * 4 + "}} that the works were late. " + account(2)
    open_slot, page = R.found(pa.array([long, None, "", " \n", SOUND * 300]), models, R.Words())
    assert list(open_slot) == [True, False, False, False, False] and not page.any()
