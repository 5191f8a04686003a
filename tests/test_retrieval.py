"""Ranking against hand-worked values and a plain model."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proofweave.functions import text as X
from proofweave.operators import retrieval as R
from tests.conftest import rows


def frames(spark, queries, docs):
    return spark.createDataFrame(queries, "query_id string, q string"), spark.createDataFrame(docs, "doc_id string, text string")


def top(spark, queries, docs, k=25, by_matrix=None):
    q, d = frames(spark, queries, docs)
    return R.bm25_top(q, d, X.tokens(F.col("q")), X.tokens(F.col("text")), k, by_matrix=by_matrix)


def test_hand_worked(spark):
    got = rows(top(spark, [("q", "beta beta alpha")], [("1", "alpha beta beta"), ("2", "beta gamma"), ("3", "delta")]), "doc_id", "score")
    assert [d for d, _ in got] == ["1", "2"]
    assert got[0][1] == pytest.approx(1.957609, abs=1e-6) and got[1][1] == pytest.approx(0.940007, abs=1e-6)


def model(query, docs, k1=1.5, b=0.75):
    held = {i: t.split() for i, t in docs}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(w for t in held.values() for w in set(t))
    out = {}
    for i, t in held.items():
        tf = Counter(t)
        s = sum(math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * max(len(t), 1) / mean)) for w in query.split() if w in tf)
        if s > 0:
            out[i] = s
    return out


@pytest.mark.parametrize(("by_matrix", "cells"), [(True, 4_000_000), (True, 7), (False, 0)])
def test_as_modelled(spark, by_matrix, cells, monkeypatch):
    monkeypatch.setattr(R, "CELLS", cells)
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    docs = [(f"d{i:02}", " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(30)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(5)]
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in top(spark, queries, docs, by_matrix=by_matrix).collect()}
    for name, q in queries:
        want = model(q, docs)
        assert {d for n, d in got if n == name} == set(sorted(want, key=lambda d: (-round(want[d], 9), d))[:25])
        for d, s in want.items():
            if (name, d) in got:
                assert got[name, d] == pytest.approx(s, abs=1e-8)


def test_nothing(spark):
    for way in (True, False):
        assert top(spark, [("q", None), ("r", "")], [("1", None)], by_matrix=way).count() == 0
        assert top(spark, [("q", "alpha")], [("1", None), ("2", "")], by_matrix=way).count() == 0


def test_fusion(spark):
    one = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2), ("q", "d3", 3)], "query_id string, doc_id string, rnk long")
    two = spark.createDataFrame([("q", "d3", 1), ("q", "d4", 2)], "query_id string, doc_id string, rnk long")
    got = sorted(R.fuse([one, two]).collect(), key=lambda r: r["rnk"])
    assert [r["doc_id"] for r in got] == ["d3", "d1", "d2", "d4"]
    assert got[0]["score"] == pytest.approx(0.03226646, abs=1e-8) and got[1]["score"] == pytest.approx(0.01639344, abs=1e-8)


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["sim"]) for r in sorted(R.cosine_top(v.where("vec_id = 1"), v, 3).collect(), key=lambda r: r["rnk"])]
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert R.cosine_top(v.limit(0), v).count() == 0
