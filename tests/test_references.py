"""Orphan references from signed counts."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from proofweave.operators import references as R
from proofweave.operators import skew
from tests.conftest import rows

REC = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
D = [dt(2024, 1, d) for d in range(1, 29)]


def log(spark, *refs, array=False):
    kind = "array<string>" if array else "string"
    df = spark.createDataFrame([(k, r, w) for k, r, w in refs], f"link_id long, evidence_id {kind}, loaded_at timestamp_ntz")
    return R.reference_log([R.Source(df, "links", "evidence_id", "link_id", "evidence", array=array)])


@pytest.mark.parametrize("hot_rows", [0, 10_000])
def test_reasons(spark, hot_rows):
    records = spark.createDataFrame([("E1", D[5], None), ("E1", D[9], None), ("E2", D[1], D[10]), ("E3", D[5], D[2])], REC)
    refs = log(spark, (1, "E1", D[6]), (2, " e1 ", D[4]), (3, "E2", D[9]), (4, "E2", D[10]), (5, "E9", D[1]), (6, None, D[1]), (7, "  ", D[1]), (2, " e1 ", D[20]), (8, "E1", D[5]), (9, "E3", D[7]), (10, "E3", D[3]))
    got = R.orphan_rows(refs, R.existence_deltas({"evidence": records}), hot_rows=hot_rows)
    assert rows(got, "row_id", "ref", "period", "reason") == [(10, "E3", "2024-01", "late"), (2, "E1", "2024-01", "late"), (4, "E2", "2024-01", "deleted"), (5, "E9", "2024-01", "missing"), (9, "E3", "2024-01", "deleted")]


def test_arrays_and_empty(spark):
    none = spark.createDataFrame([], REC)
    refs = log(spark, (1, ["a", "A ", None, ""], D[1]), (2, None, D[1]), (3, [], D[1]), array=True)
    assert rows(R.orphan_rows(refs, R.existence_deltas({"evidence": none})), "row_id", "ref", "reason") == [(1, "A", "missing")]
    assert R.orphan_rows(refs.limit(0), R.existence_deltas({"evidence": none})).count() == 0


def test_state_and_deltas(spark):
    records = spark.createDataFrame([("E1", D[1], None), ("E2", D[1], D[3])], REC)
    refs = log(spark, (1, "E1", D[2]), (1, "E1", D[5]), (2, "E2", D[4]), (3, "E9", D[4]))
    counts = R.signed_counts(R.reference_deltas(refs), R.existence_deltas({"evidence": records}))
    assert rows(R.orphan_state(counts), "key", "refs", "existing") == [("E2", 1, 0), ("E9", 1, 0)]
    arrived = spark.createDataFrame([("evidence", "E9", 0, 1)], "kind string, key string, refs long, existing long")
    assert rows(R.orphan_state(R.merge_counts(counts, arrived)), "key") == [("E2",)]


def test_many_hot_keys_are_all_split(spark):
    """More hot keys than any list would hold: the same rows as without a split, and every key in pieces."""
    refs = spark.range(300 * 12).selectExpr("id as row_id", "'t' as tbl", "'f' as field", "'evidence' as kind", "concat('E', id % 300) as ref", "timestamp_ntz'2024-01-05' as loaded_at")
    records = R.existence_deltas({"evidence": spark.createDataFrame([(f"E{k}", D[9], None) for k in range(0, 300, 2)], REC)})
    plain, split = (R.orphan_rows(refs, records, hot_rows=h) for h in (1_000, 5))
    assert rows(split) == rows(plain) and split.count() == 3_600
    hot = skew.hot_keys(R.suspects(refs, records), ["kind", "ref"], 5, "refs")
    assert hot.count() == 300 and {r["pieces"] for r in hot.collect()} == {3}
    pieces = skew.salted(refs, hot, ["kind", "ref"], F.col("row_id")).groupBy("ref").agg(F.countDistinct("salt").alias("n"))
    assert pieces.where("n > 1").count() > 290
