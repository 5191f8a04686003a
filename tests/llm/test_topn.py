"""Top N per group, both ways of the split, against brute force."""

import math
import random

import pytest

from proofweave.llm import topn
from tests.conftest import rows


def brute(cells, n):
    best = {}
    for g, i, s in cells:
        if g is not None and i and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s + 0.0)
    out = []
    for g in {g for g, _ in best}:
        order = sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]
        out += [(g, k + 1, i) for k, (_, i) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [0, 20, 10_000])
def test_as_brute_force(spark, hot_rows):
    rng = random.Random(3)
    scores = [0.0, -0.0, 0.5, 0.5, 0.9, 1.0, None, math.nan, -0.3]
    cells = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([f"e{k:02}" for k in range(40)] + ["", None]), rng.choice(scores)) for _ in range(600)]
    df = spark.createDataFrame(cells, "g string, i string, s double").selectExpr("*", "1 as grp", "'x' as item", "2 as score", "3 as rank_no")
    got = topn.top_n(df, "g", "i", "s", 5, hot_rows=hot_rows)
    assert rows(got, "grp", "rank_no", "item") == brute(cells, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, i string, s double")
    assert topn.top_n(df, "g", "i", "s").count() == 0


def test_many_heavy_groups(spark):
    cells = [(f"g{k % 300:03}", f"e{k // 300:02}", (k * 7 % 13) / 13) for k in range(300 * 12)]
    df = spark.createDataFrame(cells, "g string, i string, s double")
    assert rows(topn.top_n(df, "g", "i", "s", 5, hot_rows=5), "grp", "rank_no", "item") == rows(topn.top_n(df, "g", "i", "s", 5), "grp", "rank_no", "item") == brute(cells, 5)
