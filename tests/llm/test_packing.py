"""Containers: every item once, none too full, few of them."""

import random
from collections import Counter

import pytest

from proofweave.llm import packing as P


def check(histogram, capacity, slack=1.02):
    held, room = Counter(), Counter()
    for size, first, last, container in P.make_plan(histogram, capacity):
        held[size] += last - first
        for k in range(container, container + last - first):
            room[k] += size
    assert held == Counter({s: n for s, n in histogram.items() if n and s > 0})
    assert max(room.values(), default=0) <= capacity
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    assert len(room) <= max(least * slack, least + 2)
    if room:
        assert set(room) == set(range(max(room) + 1))
    return len(room), least


@pytest.mark.parametrize("seed", range(4))
def test_mixed_sizes(seed):
    rng = random.Random(seed)
    check(Counter(min(2048, int(rng.lognormvariate(5.3, 1)) + 1) for _ in range(4_000)), 2_048)


def test_special_cases():
    assert P.make_plan({}, 100) == [] and P.make_plan({0: 5}, 100) == []
    assert check({100: 7}, 100)[0] == 7
    assert check({1: 250}, 100)[0] == 3
    assert check({50: 10, 30: 5, 20: 5}, 100)[0] == 8
    assert check({51: 10}, 100, slack=2)[0] == 10
    with pytest.raises(ValueError, match="larger"):
        P.make_plan({101: 1}, 100)


@pytest.mark.parametrize("seed", range(3))
def test_small_cases_are_optimal_or_close(seed):
    rng = random.Random(seed)
    check(Counter(rng.randint(20, 60) for _ in range(60)), 100, slack=1.15)


def test_rows(spark):
    sizes = [(i, n) for i, n in enumerate([None, 0, 5, 100, 101, 250, 60, 40, 40, 60])] + [(3, 100)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").selectExpr("*", "7 as shard", "'x' as number", "1 as part_no")
    got = P.pack(df, capacity=100, shard_rows=2).collect()
    per_doc, per_container = Counter(), Counter()
    for r in got:
        per_doc[r["doc_id"]] += r["n_tokens"]
        per_container[r["container_id"]] += r["n_tokens"]
    assert per_doc == Counter({i: 0 for i, n in sizes if not n} | {i: n for i, n in sizes if n and i != 3} | {3: 200})
    assert max(per_container.values()) <= 100
    assert {r["doc_id"] for r in got if r["part_no"] > 0} == {4, 5}
    assert sorted(r["start_token"] for r in got if r["doc_id"] == 5) == [0, 100, 200]
    assert P.fill(P.pack(df, capacity=100, shard_rows=2), 100).first()["containers"] == 8
    assert P.pack(df.limit(0), capacity=100).count() == 0


def test_one_size_for_a_third_of_all_rows(spark):
    df = spark.range(900).selectExpr("id as doc_id", "case when id % 3 = 0 then 700 else 100 + id % 200 end as n_tokens")
    got = P.pack(df)
    assert got.count() == 900 and got.select("doc_id").distinct().count() == 900
    one = P.fill(got).first()
    assert one["fullest"] <= 2_048 and one["containers"] <= one["least"] * 1.02 + 1
