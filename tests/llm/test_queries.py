"""The queries of the subpackage on the smallest tables: twins agree, the others hold their invariants."""

import pytest

from proofweave.llm import oracle, queries
from tests.conftest import rows, same


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_twin(spark, duck, data, name):
    same(queries.QUERIES[name](spark, data), duck.execute(oracle.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_near_copies_against_all_pairs(spark, duck, data):
    """All pairs of the smallest evidence table, compared one by one."""
    import regex

    from proofweave.llm.unify import unify_text

    held = duck.execute("select id, any_value(coalesce(assertion, '') || ' ' || coalesce(quote, '')) from evidence group by id").fetchall()
    sets = {}
    for i, text in held:
        w = regex.findall(r"[\p{L}\p{N}]+", unify_text(text)[0].lower())
        sets[i] = set(zip(w, w[1:], strict=False))
    ids = sorted(sets)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    got = set(rows(queries.QUERIES["p1_found"](spark, data)))
    assert got <= want and len(got) >= 0.9 * len(want)


def test_columns(spark, data):
    shapes = {
        "p1_found": [("id_a", "string"), ("id_b", "string")], "p2_found": [("chat_id", "bigint"), ("defect", "string")], "p4_found": [("tbl", "string"), ("row_key", "string")], "p5_found": [("doc_id", "string"), ("pos", "bigint")],
        "p6_found": [("prop_id", "string"), ("rank_no", "bigint"), ("evidence_id", "string")], "p7_found": [("doc_id", "string"), ("pos", "bigint"), ("line_no", "bigint"), ("noise", "string")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_id", "bigint")],
    }
    for name, shape in shapes.items():
        assert queries.QUERIES[name](spark, data).dtypes == shape, name


def test_containers_hold_every_document_once(spark, data):
    got = queries.QUERIES["p9_containers"](spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
    assert rows(got.select("doc_id").distinct()) == rows(docs.distinct())
    assert got.groupBy("container_id").agg({"n_tokens": "sum"}).where("`sum(n_tokens)` > 2048").count() == 0
