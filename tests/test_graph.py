"""Graph operators against hand-worked values and brute force on random graphs."""

import inspect
import random

import numpy as np
import pytest

from proofweave.operators import graph as G
from tests.conftest import rows

SAMPLE = [("E1", "P1"), ("E1", "P2"), ("E2", "P2"), ("E3", "P3"), ("E4", "P3")]


def pairs(spark, arcs):
    return spark.createDataFrame(sorted({(min(a, b), max(a, b)) for a, b in arcs}), "a string, b string")


def pieces(arcs, without=()):
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left = {v for v in near if v not in without}
    out = []
    while left:
        front, seen = [min(left)], {min(left)}
        while front:
            for u in near[front.pop()]:
                if u in left and u not in seen:
                    seen.add(u)
                    front.append(u)
        out.append(seen)
        left -= seen
    return out


def test_sample(spark):
    p = pairs(spark, SAMPLE)
    rank = {r["id"]: round(r["rank"], 4) for r in G.pagerank(p).collect()}
    assert rank == {"P3": 1.0, "P2": 0.8896, "E1": 0.8896, "E3": 0.5278, "E4": 0.5278, "P1": 0.4808, "E2": 0.4808}
    assert rows(G.articulation(p)) == [("E1",), ("P2",), ("P3",)]
    assert rows(G.components(p).select("component").distinct()) == [("E1",), ("E3",)]
    assert G.fragments(p, ["P2"]).first()["n"] == 3
    centers = spark.createDataFrame([("P1",)], "center string")
    assert rows(G.ego(p, centers), "id", "hop") == [("E1", 1), ("P1", 0), ("P2", 2)]
    assert rows(G.capped(G.ego(p, centers), 2), "id") == [("E1",), ("P1",)]


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    for df in (G.pagerank(none), G.components(none), G.articulation(none), G.cycles(none.selectExpr("a as from_id", "b as to_id"))):
        assert df.count() == 0


def test_pagerank_in_arrays(spark, monkeypatch):
    """The same ranks as by joins, from pieces of any size, without a join for every iteration."""
    rng = random.Random(5)
    p = pairs(spark, [(f"E{rng.randint(0, 30):02}", f"P{rng.randint(0, 9)}") for _ in range(60)])
    want = {r["id"]: r["rank"] for r in G.pagerank(p, iterations=3, most=0).collect()}
    names = sorted(want)
    place = {v: k for k, v in enumerate(names)}
    ends = np.asarray([(place[r["a"]], place[r["b"]]) for r in p.collect()])
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(G._blocks, "__defaults__", (block,))
        assert G.ranks(np.array_split(ends, 9), len(names), iterations=3) == pytest.approx([want[v] for v in names])
    monkeypatch.setattr(G, "_pagerank_by_joins", None)
    assert {r["id"]: r["rank"] for r in G.pagerank(p, iterations=3).collect()} == pytest.approx(want)


def labels_of(near):
    names = sorted(near)
    place = {v: k for k, v in enumerate(names)}
    arcs = np.asarray([(place[a], place[b]) for a in near for b in near[a]], np.int64).reshape(-1, 2)
    return {v: names[k] for v, k in zip(names, G.settle_labels(G.Neighbours(len(names), arcs), len(names)), strict=True)}


def test_labels():
    near = {"E1": {"P1", "P2"}, "E2": {"P2"}, "E3": {"P3"}, "E4": {"P3"}, "P1": {"E1"}, "P2": {"E1", "E2"}, "P3": {"E3", "E4"}}
    label = labels_of(near)
    assert len({label[v] for v in ("E1", "E2", "P1", "P2")}) == 1 and len({label[v] for v in ("E3", "E4", "P3")}) == 1
    assert label["E1"] != label["E3"]


def every_visit(near, rounds):
    """All vertices in order, again and again: what the operator must equal."""
    label = {v: v for v in near}
    for _ in range(rounds):
        for v in sorted(near):
            votes = {}
            for u in near[v]:
                votes[label[u]] = votes.get(label[u], 0) + 1
            if votes:
                label[v] = min(votes, key=lambda c: (-votes[c], c))
    return label


@pytest.mark.parametrize("seed", range(20))
def test_labels_as_by_every_visit(seed):
    rng = random.Random(seed)
    n = rng.randint(2, 40)
    arcs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 60))}
    hubs = [sorted(rng.sample(range(n), rng.randint(1, min(n, 6)))) for _ in range(rng.randint(0, 5))]
    near = {v: set() for v in range(n)}
    for a, b in arcs | {(x, y) for h in hubs for x in h for y in h}:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for rounds in (1, 2, 40):
        got = G.settle_labels(G.Neighbours(n, np.asarray(sorted(arcs)), [np.asarray(h) for h in hubs]), n, rounds)
        assert dict(enumerate(got.tolist())) == every_visit(near, rounds)


@pytest.mark.parametrize("few", [0, 1, 3])
def test_hubs_are_seldom_gathered(monkeypatch, few):
    """Counts of the hubs decide most visits, and never otherwise than the neighbours themselves."""
    monkeypatch.setattr(G.HubCounts, "FEW", few)
    rng = random.Random(few)
    n, first = 600, 300
    arcs = {(rng.randrange(first), first + min(rng.randrange(300), rng.randrange(300))) for _ in range(900)}
    hubs = [sorted(rng.sample(range(first, n), size)) for size in (150, 120, 60, 20, 2)]
    near = {v: set() for v in range(n)}
    for a, b in arcs | {(x, y) for h in hubs for x in h for y in h if x != y}:
        near[a].add(b)
        near[b].add(a)
    held = G.Neighbours(n, np.asarray(sorted(arcs)), [np.asarray(h) for h in hubs])
    gathered, of = [], held.of
    held.of = lambda v: gathered.append(v) or of(v)
    got = G.settle_labels(held, n)
    assert dict(enumerate(got.tolist())) == every_visit(near, 40)
    assert len(gathered) < 100


def test_communities_of_any_size(spark):
    """No component is refused unless asked for, and components found first give the same rows."""
    rng = random.Random(1)
    arcs = [(f"E{rng.randint(0, 40):02}", f"P{rng.randint(0, 29):02}") for _ in range(45)]
    links = spark.createDataFrame([(f"P{i:02}", "supportive", rng.choice("uvw")) for i in range(0, 30, 3)], "prop_id string, relation string, witness string").selectExpr("*", "'E00' as evidence_id")
    whole = rows(G.communities(pairs(spark, arcs), links, None))
    assert rows(G.communities(pairs(spark, arcs), links, None, together=0)) == whole and len(whole) > 30
    assert inspect.signature(G.communities).parameters["most"].default is None


def test_communities(spark):
    """Against brute force; two groups that share a witness are one."""
    arcs = [(f"E{k}{j}", f"P{k}{i}") for k in range(4) for j in range(4) for i in range(3)]
    links = spark.createDataFrame([("P00", "supportive", "w"), ("P10", "supportive", "w"), ("P20", "supportive", ""), ("P30", "adverse", "v")], "prop_id string, relation string, witness string").selectExpr("*", "concat('E', prop_id) as evidence_id")
    props = spark.createDataFrame([(f"P{k}{i}",) for k in range(4) for i in range(3)], "prop_id string")
    near = {}
    for a, b in [*arcs, ("P00", "P10")]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v, label in every_visit(near, 40).items():
        want.setdefault(label, set()).add(v)
    got = {}
    for r in G.communities(pairs(spark, arcs), links, props).collect():
        got.setdefault(r["community"], set()).add(r["id"])
    order = sorted(want, key=lambda c: (-len(want[c]), c))
    assert got == {k: want[c] for k, c in enumerate(order)}
    with pytest.raises(ValueError, match="communities_synchronous"):
        G.communities(pairs(spark, arcs), links, props, most=5)
    alike = {}
    for r in G.communities_synchronous(pairs(spark, arcs), links).collect():
        alike.setdefault(r["community"], set()).add(r["id"])
    assert {v for g in alike.values() for v in g} == set(near) and all(len({v[1] for v in g} - {"0", "1"}) <= 1 for g in alike.values())


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    arcs = [(f"v{rng.randint(0, 24):02}", f"v{rng.randint(0, 24):02}") for _ in range(26)]
    arcs = [(a, b) for a, b in arcs if a != b]
    p = pairs(spark, arcs)
    groups = pieces(arcs)
    assert dict(rows(G.components(p))) == {v: min(g) for g in groups for v in g}
    whole = len(groups)
    want = sorted(v for g in groups for v in g if len(pieces(arcs, {v})) > whole - (len(g) == 1))
    want = sorted(v for g in groups for v in g if len([x for x in pieces(arcs, {v})]) > whole)
    assert [r[0] for r in rows(G.articulation(p))] == want
    assert [r[0] for r in rows(G.articulation(p, most=3))] == want  # the thinned way


@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, seed):
    rng = random.Random(seed)
    arcs = {(f"v{rng.randint(0, 14):02}", f"v{rng.randint(0, 14):02}") for _ in range(18)}
    arcs = {(a, b) for a, b in arcs if a != b}
    reach = set(arcs)
    while True:
        more = {(a, d) for a, b in reach for c, d in arcs if b == c} - reach
        if not more:
            break
        reach |= more
    want = sorted((a, min(b for x, b in reach if x == a and (b, a) in reach)) for a in {a for a, b in reach if a == b})
    deps = spark.createDataFrame(sorted(arcs), "from_id string, to_id string")
    assert rows(G.cycles(deps)) == want
    assert rows(G.cycles(deps, most=0)) == want  # by joins


def test_cycle_by_hand(spark):
    deps = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")], "from_id string, to_id string")
    assert rows(G.cycles(deps)) == [("A", "A"), ("B", "A"), ("C", "A")]
