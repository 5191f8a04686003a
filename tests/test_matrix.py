"""Roll-ups on hand-made rows."""

import numpy as np
import pyarrow as pa
import pytest

from proofweave.operators import matrix as M
from tests.conftest import rows

PROP = "prop_id string, prop_type string, text string, party string, responds_to string, quote string, quote_ok boolean, doc_id string, page int, paragraph string"
LINK = "link_id long, prop_id string, evidence_id string, relation string, confidence double, rationale string, quote string, quote_ok boolean, witness string, doc_id string, page int, paragraph string"


def props(spark, *ids):
    return spark.createDataFrame([(i, "allegation", f"text {i}", None, None, None, None, None, None, None) for i in ids], PROP)


def links(spark, *cells):
    return spark.createDataFrame([(k, p, e, r, c, None, None, None, w, "D1", 1, "2.") for k, (p, e, r, c, w) in enumerate(cells)], LINK)


def test_statuses(spark):
    got = M.statuses(props(spark, "A", "B", "C", "D", "E"), links(spark, ("A", "e1", "supportive", 0.5, ""), ("A", "e2", "adverse", 0.49, ""), ("B", "e1", "supportive", 0.9, ""), ("B", "e1", "adverse", 0.9, ""), ("C", "e1", "neutral", 1.0, ""), ("E", "e1", "adverse", 0.5, "")))
    assert rows(got, "prop_id", "status", "n_links", "n_strong") == [("A", "supported", 2, 1), ("B", "contested", 2, 2), ("C", "MISSING", 1, 1), ("D", "MISSING", 0, 0), ("E", "undermined", 1, 1)]


def test_empty_matrix(spark):
    none, no_links = props(spark).limit(0), links(spark).limit(0)
    status = M.statuses(none, no_links)
    assert rows(M.status_counts(status)) == [("MISSING", 0), ("contested", 0), ("supported", 0), ("undermined", 0)]
    assert M.summary(status).first()["readiness_pct"] == 0.0
    for df in (M.load_bearing(no_links), M.single_points(no_links), M.witness_groups(no_links), M.contradictions(no_links), M.csv_rows(none, no_links)):
        assert df.count() == 0


def test_readiness(spark):
    status = spark.createDataFrame([("supported",)] * 22 + [("contested",)] * 28 + [("undermined",)] * 8 + [("MISSING",)] * 3, "status string")
    one = M.summary(status).first()
    assert (one["total"], one["at_risk"], one["readiness_pct"]) == (61, 11, 59.0)


def test_csv_rows_below_the_gate(spark):
    p, k = props(spark, "A", "B"), links(spark, ("A", "e1", "supportive", 0.3, ""))
    assert rows(M.csv_rows(p, k), "prop_id", "relation", "rationale") == [("B", "MISSING", "no evidence retrieved")]
    assert rows(M.csv_rows(p, k, include_empty=True), "prop_id") == [("A",), ("B",)]


def test_witnesses(spark):
    k = links(spark, ("A", "e1", "supportive", 0.9, "W"), ("A", "e2", "supportive", 0.9, ""), ("B", "e1", "adverse", 0.1, "W"), ("C", "e3", "supportive", 0.2, ""), ("D", "e3", "neutral", 0.2, "W"))
    assert rows(M.sole_witness(k)) == [("A", 1, "W"), ("C", 0, "")]
    assert rows(M.single_points(k), "evidence_id", "n_props", "prop_id") == [("e3", 1, "C")]
    assert rows(M.witness_groups(k), "witness", "n_props", "prop_id") == [("W", 2, "A"), ("W", 2, "B")]


def test_dependencies_and_reliances(spark):
    p = props(spark, "A", "B")
    deps = spark.createDataFrame([(1, "A", "B"), (2, "A", "B"), (3, "A", "A"), (4, "A", "Z"), (5, None, "B")], "dep_id long, from_id string, to_id string")
    assert rows(M.valid_dependencies(deps, p), "from_id", "to_id", "dep_id") == [("A", "B", 1)]
    used = spark.createDataFrame([(1, 0, "A"), (1, 1, "Z"), (1, 2, "A")], "method_id long, pos long, prop_id string")
    assert rows(M.valid_reliances(used, p)) == [(1, 0, "A"), (1, 2, "A")]


def test_additions(spark):
    p, k = props(spark, "A", "B"), links(spark, ("A", "e1", "supportive", 0.9, ""))
    new_props = spark.createDataFrame([("U0001",)], "prop_id string")
    new_links = spark.createDataFrame([("A", "UE1", "adverse", None), ("B", "", "adverse", 0.9), ("Z", "UE1", "adverse", 0.9), ("U0001", "e1", None, 0.0)], "prop_id string, evidence_id string, relation string, confidence double")
    assert rows(M.apply_additions(p, k, new_props, new_links), "prop_id", "status", "n_links") == [("A", "contested", 2), ("B", "MISSING", 0), ("U0001", "supported", 1)]


def test_nested_and_signature(spark):
    p, k = props(spark, "A", "B"), links(spark, ("A", "e1", "supportive", 0.3, ""), ("A", "e2", "adverse", 0.8, ""))
    got = {r["prop_id"]: r for r in M.nested(p, k).collect()}
    assert [x["evidence_id"] for x in got["A"]["links"]] == ["e2", "e1"] and got["B"]["links"] is None
    first = M.signature(p, M.statuses(p, k)).first()[0]
    assert len(first) == 16 and first == M.signature(p.repartition(3), M.statuses(p, k)).first()[0]
    assert first != M.signature(p, M.statuses(p, k.limit(0))).first()[0]


@pytest.mark.parametrize("extra", ["n", "status", "k"])
def test_extra_columns_do_no_harm(spark, extra):
    from pyspark.sql import functions as F

    p, k = props(spark, "A").withColumn(extra, F.lit("x")), links(spark, ("A", "e1", "supportive", 0.9, "W")).withColumn(extra, F.lit("x"))
    assert rows(M.statuses(p, k), "status") == [("supported",)]
    assert M.load_bearing(k).count() == 1 and M.single_points(k).count() == 1


def test_goals_are_sought_in_links_and_quotes(spark):
    from pyspark.sql import functions as F

    held = spark.createDataFrame([("A", "allegation", "a", None, None, "the berth tool", None, None, None, None), ("B", "allegation", "b", None, None, None, None, None, None, None), ("C", "allegation", "c", None, None, None, None, None, None, None), ("D", "allegation", "d", None, None, None, None, None, None, None)], PROP)
    told = spark.createDataFrame([(1, "B", "e", "neutral", 0.1, "about BERTH plans", None, None, "", None, None, None), (2, "C", "e", "neutral", 0.1, None, None, None, "Dov Berthold", None, None, None), (3, "C", "e", "neutral", 0.1, None, "berth", None, "", None, None, None)], LINK)
    goals = spark.createDataFrame([(1, "berth")], "goal_id long, question string")
    assert rows(M.goal_matches(goals, held, F.array("question"), told)) == [(1, "A"), (1, "B"), (1, "C")]
    assert rows(M.goal_matches(goals, held, F.array("question"))) == []


def test_goals_of_links_are_gathered_without_a_join(spark):
    """Every goal of every word once, whatever the number of links, words and batches; no pair is shuffled."""
    from pyspark.sql import functions as F

    goals = spark.createDataFrame([(k, w) for k in range(40) for w in ("berth", f"crane{k % 3}")], "goal_id long, question string")
    props = spark.createDataFrame([("A", "Berth crane1", "x", "y", None), ("B", None, "x", "y", "xcrane2, z"), ("C", "none", "x", "y", None)], "prop_id string, text string, prop_type string, party string, quote string")
    links = spark.createDataFrame([("A", "", None, "the berthing"), ("B", "Crane0", "CRANE2", None), ("C", "cran", "e1", "nil")] * 3, "prop_id string, witness string, rationale string, quote string")
    found = M.goal_matches(goals, props, F.array("question"), links)
    want = {(k, "A") for k in range(40)} | {(k, "B") for k in range(40) if k % 3 in (0, 2)}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert M.goal_matches(goals.limit(0), props, F.array("question"), links).count() == 0
    parts = list(M._goals_of([pa.RecordBatch.from_pydict({"prop_id": ["A", "B"], "words": [[0, 1], [1]]})], np.asarray([7, 9, 7]), np.asarray([0, 2, 3]), at_once=1))
    assert [b.to_pylist() for b in parts] == [[{"prop_id": "A", "goals": [7, 9]}], [{"prop_id": "B", "goals": [7]}]]
