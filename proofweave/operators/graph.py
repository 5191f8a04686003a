"""The claim and evidence graph.

Vertices are propositions and evidence, edges are links (SUPPORTS, UNDERMINES, NEUTRAL) and dependencies.
Iterative operators keep their state partitioned by vertex and cut the lineage by writing to the shared
folder. Kernels that are sequential by definition run per connected component of at most
:data:`KERNEL_EDGES` edges; beyond, cut vertices and loops are found another way with the same result.
:func:`communities`, whose result depends on the order of visits, gives a component of any size to one task
(:func:`communities_synchronous` is another operator, all of joins).

Defined results: self-loops and repeated edges are dropped where a simple graph is asked for; an empty graph
gives no rows; ties go to the smaller id.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofweave.functions import text as X
from proofweave.operators.skew import numbered
from proofweave.session import materialize, shuffle_width

#: Edges of a component up to which a sequential kernel takes it.
KERNEL_EDGES = 2_000_000
#: Edges up to which :func:`communities` takes all components to one task instead of looking for them.
ONE_TASK_EDGES = 20_000_000
#: Vertices up to which one task computes PageRank: it holds 8 bytes for each of them, the arcs lie in a file.
ARRAY_VERTICES = 64_000_000
_RELATION = {"supportive": "SUPPORTS", "adverse": "UNDERMINES", "neutral": "NEUTRAL"}


def edges(links: DataFrame, include_neutral: bool = True, min_confidence: float = 0.0) -> DataFrame:
    """``source, target, relation, confidence, rationale, quote``; repeated links stay repeated."""
    kept = links.where((F.coalesce("evidence_id", F.lit("")) != "") & (F.col("confidence") >= min_confidence))
    if not include_neutral:
        kept = kept.where("relation <> 'neutral'")
    name = F.create_map(*[x for k, v in _RELATION.items() for x in (F.lit(k), F.lit(v))])
    return kept.select(F.col("evidence_id").alias("source"), F.col("prop_id").alias("target"), name[F.col("relation")].alias("relation"), F.expr("cast(format_number(confidence, '0.000') as double)").alias("confidence"), "rationale", "quote")


def dependency_edges(valid: DataFrame) -> DataFrame:
    """Dependencies as edges from a proposition to its premise."""
    return valid.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.lit("DEPENDS_ON").alias("relation"), F.lit(1.0).alias("confidence"), F.lit("").alias("rationale"), F.lit("").alias("quote"))


def nodes(props: DataFrame, links: DataFrame, status: DataFrame) -> DataFrame:
    """``id, kind, label, status, witness, doc_id, supports, undermines``; an evidence node takes its label
    from its first link (the surest, then the smallest link id)."""
    from proofweave.operators.matrix import contradicted, evidence_load

    sides = contradicted(props, links)
    head = props.join(status.select("prop_id", "status"), "prop_id").join(sides, "prop_id")
    left = head.select(F.col("prop_id").alias("id"), F.lit("proposition").alias("kind"), X.ellipsis(F.col("text")).alias("label"), "status", F.lit("").alias("witness"), F.coalesce("doc_id", F.lit("")).alias("doc_id"), "supports", "undermines")
    first = links.groupBy("evidence_id").agg(F.min_by(F.struct("quote", "rationale", "witness", "doc_id"), F.struct(-F.col("confidence"), "link_id")).alias("f"))
    shown = F.coalesce(F.when(F.col("f.quote") != "", F.col("f.quote")), F.when(F.col("f.rationale") != "", F.col("f.rationale")), F.col("evidence_id"))
    load = evidence_load(links).select("evidence_id", "supports", "undermines")
    right = first.join(load, "evidence_id").select(F.col("evidence_id").alias("id"), F.lit("evidence").alias("kind"), X.ellipsis(shown, 70).alias("label"), F.lit("").alias("status"), F.col("f.witness").alias("witness"), F.coalesce("f.doc_id", F.lit("")).alias("doc_id"), "supports", "undermines")
    return left.unionByName(right)


def probative_pairs(links: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: the simple undirected graph of supporting and adverse links."""
    kept = links.where("relation <> 'neutral'").where("evidence_id <> prop_id")
    return kept.select(F.least("evidence_id", "prop_id").alias("a"), F.greatest("evidence_id", "prop_id").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """``src, dst`` in both directions."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def _places(ids: DataFrame) -> DataFrame:
    """``id, place``: every id once with its place from 0 in the order of ids."""
    return materialize(numbered(materialize(ids.distinct(), "ids"), "place", F.col("id")).select("id", (F.col("place") - 1).cast("int").alias("place")), "places")


def _by_place(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """``pairs`` with the places of their ends instead of their ids."""
    ends = pairs.join(places.select(F.col("id").alias("a"), F.col("place").alias("pa")), "a").join(places.select(F.col("id").alias("b"), F.col("place").alias("pb")), "b")
    return ends.select(*[F.col({"a": "pa", "b": "pb"}.get(c, c)).alias(c) for c in pairs.columns])


def pagerank(pairs: DataFrame, damping: float = 0.85, iterations: int = 60, cut_every: int = 5, most: int = ARRAY_VERTICES) -> DataFrame:
    """``id, rank``: undirected PageRank after a fixed number of iterations, divided by the largest.

    Vertices without edges are not part of ``pairs``, so no rank dangles. Up to ``most`` vertices one task
    iterates over numbered arcs in a file; beyond, every iteration is a join.
    """
    pairs = materialize(pairs, "pairs")
    ids = materialize(both_ways(pairs).select(F.col("src").alias("id")).distinct(), "ids")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    if n > most:
        return _pagerank_by_joins(pairs, n, damping, iterations, cut_every)
    places = _places(ids)

    def kernel(batches):
        rank = ranks((np.stack([b["a"].to_numpy(), b["b"].to_numpy()], 1) for b in batches), n, damping, iterations)
        for k in range(0, n, 1 << 20):
            part = np.asarray(rank[k : k + (1 << 20)])
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(k, k + len(part), dtype=np.int32)), "rank": pa.array(part)})

    ranked = materialize(_by_place(pairs, places).repartition(1).mapInArrow(kernel, "place int, rank double"), "rank")
    return places.join(ranked, "place").select("id", "rank")


def ranks(pairs, n: int, damping: float = 0.85, iterations: int = 60) -> np.ndarray:
    """PageRank of vertices ``0 .. n - 1``, divided by the largest; ``pairs`` are blocks of pairs of their numbers. The arcs
    lie in a file, in pieces sorted by source; only the shares of the vertices are in memory."""
    pieces, file = [], tempfile.TemporaryFile()

    def held(array: np.ndarray) -> np.ndarray:
        at = file.seek(0, 2)
        array.tofile(file)
        file.flush()
        return np.memmap(file, array.dtype, "r+", at, array.shape)

    degree = held(np.zeros(n, np.int64))
    for block in _blocks(pairs):
        arcs = np.sort(np.concatenate([block[:, 0] << 32 | block[:, 1], block[:, 1] << 32 | block[:, 0]]))
        source = arcs >> 32
        first = np.flatnonzero(np.diff(source, prepend=-1))
        degree[source[first]] += np.diff(first, append=len(arcs))
        pieces.append((held(source[first]), held(first), held(arcs & 0xFFFFFFFF)))
    rank, share = held(np.full(n, 1.0 / n)), np.empty(n)
    for _ in range(iterations):
        np.divide(rank, degree, out=share)
        rank[:] = 0
        for ids, first, targets in pieces:
            rank[ids] += np.add.reduceat(share[targets], first)
        rank *= damping
        rank += (1 - damping) / n
    rank /= rank.max()
    return rank


def _blocks(parts, rows: int = 1 << 20):
    """Blocks of at least ``rows`` rows, but for the last, as 64-bit numbers."""
    waiting, size = [], 0
    for part in parts:
        waiting.append(part)
        size += len(part)
        if size >= rows:
            yield np.concatenate(waiting).astype(np.int64)
            waiting, size = [], 0
    if size:
        yield np.concatenate(waiting).astype(np.int64)


def _pagerank_by_joins(pairs: DataFrame, n: int, damping: float, iterations: int, cut_every: int) -> DataFrame:
    """The adjacency stays partitioned by its source; an iteration shuffles only the summed shares, pre-summed
    map-side."""
    width = shuffle_width(pairs.sparkSession)
    arcs = materialize(both_ways(pairs), "arcs")
    degree = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    adjacency = arcs.join(degree, "src").repartition(width, "src").persist()
    rank = degree.select(F.col("src").alias("id"), F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        shares = adjacency.join(rank, adjacency["src"] == rank["id"]).select("dst", (F.col("rank") / F.col("deg")).alias("share"))
        rank = shares.groupBy(F.col("dst").alias("id")).agg((F.sum("share") * damping + (1 - damping) / n).alias("rank"))
        if (i + 1) % cut_every == 0:
            rank = materialize(rank, "rank")
    adjacency.unpersist()
    top = rank.agg(F.max("rank").alias("top")).first()["top"]  # one number
    return rank.select("id", (F.col("rank") / F.lit(top)).alias("rank"))


def components(pairs: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id of the component) for every vertex of ``pairs``.

    Alternating large-star and small-star steps: the edges are rewired towards smaller ids until nothing
    changes, which takes a number of rounds logarithmic in the number of vertices. Every round is written to
    the shared folder, and a vertex's neighbours are only aggregated to their minimum, never gathered.
    """
    state = materialize(pairs.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        arcs = both_ways(state)
        low = arcs.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = arcs.join(low, "src").where("dst > src").select(F.col("dst").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst"))
        small_low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(small_low, "src").select(F.col("dst").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small_low.select(F.col("src").alias("a"), F.col("m").alias("b"))).distinct()
        state = materialize(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "edges")
        mark = state.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    # A star forest: every edge joins a vertex to the smallest of its component.
    return state.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(state.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def fragments(pairs: DataFrame, without: list[str]) -> DataFrame:
    """``n``: components that are left when vertices are removed; vertices left without edges count."""
    kept = pairs.where(~F.col("a").isin(without) & ~F.col("b").isin(without))
    alone = both_ways(pairs).select(F.col("src").alias("id")).distinct().where(~F.col("id").isin(without)).join(both_ways(kept).select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    return components(kept).select("component").distinct().unionByName(alone.select(F.col("id").alias("component"))).agg(F.count(F.lit(1)).alias("n"))


def ego(pairs: DataFrame, centers: DataFrame, hops: int = 2) -> DataFrame:
    """``center, id, hop`` for ``centers(center)``: vertices within ``hops`` edges and their distance."""
    arcs = both_ways(pairs)
    reached = centers.select("center", F.col("center").alias("id"), F.lit(0).cast("long").alias("hop"))
    edge = reached
    for h in range(1, hops + 1):
        edge = edge.join(arcs, edge["id"] == arcs["src"]).select("center", F.col("dst").alias("id")).distinct().withColumn("hop", F.lit(h).cast("long"))
        reached = reached.unionByName(edge).groupBy("center", "id").agg(F.min("hop").alias("hop"))
    return reached


def capped(reached: DataFrame, cap: int = 26) -> DataFrame:
    """The nearest ``cap`` vertices of every ego graph; within a distance in the order of ids."""
    order = Window.partitionBy("center").orderBy("hop", "id")
    return reached.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


# --- kernels ---------------------------------------------------------------------------------------------


def _adjacency(arcs: list[tuple[str, str]]) -> dict[str, set]:
    out: dict[str, set] = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def _arcs(table: pa.Table) -> list[tuple[str, str]]:
    return list(zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True))


def _strings(**columns: list) -> pa.Table:
    return pa.table({k: pa.array(v, pa.string()) for k, v in columns.items()})


def cut_vertices(adjacency: dict) -> set:
    """Vertices whose removal splits their component: lowest reachable discovery times over an explicit
    depth-first stack."""
    when: dict = {}
    low: dict = {}
    found = set()
    for root in sorted(adjacency):
        if root in when:
            continue
        when[root] = low[root] = len(when)
        branches, stack = 0, [(root, None, iter(adjacency[root]))]
        while stack:
            here, parent, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[here])
                    if parent != root and low[here] >= when[parent]:
                        found.add(parent)
            elif step not in when:
                when[step] = low[step] = len(when)
                branches += here == root
                stack.append((step, here, iter(adjacency[step])))
            elif step != parent:
                low[here] = min(low[here], when[step])
        if branches > 1:
            found.add(root)
    return found


class Neighbours:
    """Neighbours of numbered vertices in arrays: those of edges, and those that share a hub with a vertex. A hub is
    never expanded to all pairs of its members."""

    def __init__(self, n: int, edges_: np.ndarray, hubs: list[np.ndarray] = ()) -> None:
        keys = np.concatenate([edges_[:, 0].astype(np.int64) << 32 | edges_[:, 1], edges_[:, 1].astype(np.int64) << 32 | edges_[:, 0]]) if len(edges_) else np.empty(0, np.int64)
        keys = np.unique(keys[keys >> 32 != keys & 0xFFFFFFFF])
        self.targets = (keys & 0xFFFFFFFF).astype(np.int32)
        self.bounds = np.searchsorted(keys >> 32, np.arange(n + 1))
        self.members = [np.unique(h).astype(np.int32) for h in hubs]
        self.hubs: dict[int, list[int]] = {}
        for h, members in enumerate(self.members):
            for v in members.tolist():
                self.hubs.setdefault(v, []).append(h)

    def linked(self, v: int) -> np.ndarray:
        """Neighbours by an edge."""
        return self.targets[self.bounds[v] : self.bounds[v + 1]]

    def of(self, v: int) -> np.ndarray:
        """All neighbours, each once."""
        if v not in self.hubs:
            return self.linked(v)
        every = np.unique(np.concatenate([self.linked(v), *[self.members[h] for h in self.hubs[v]]]))
        return every[every != v]


class HubCounts:
    """How often every label occurs in every hub, without the one vertex that still has its own number as label.

    Labels held by several members of a hub have a column of :attr:`wide` (exact, own numbers included), the others an entry
    of :attr:`rare`, whose largest value is at most :attr:`most`. From these follow bounds of a label's number of
    neighbours, which hubs with members in common do not add up to; they mostly decide which label is the commonest.
    """

    FEW = 3

    def __init__(self, near: Neighbours, label: np.ndarray) -> None:
        self.near, self.label = near, label
        n = len(near.members)
        self.columns = max(16, min(256, (1 << 26) // max(n, 1)))
        self.wide = np.zeros((n, 0), np.int32)
        self.used = 0
        self.column: dict[int, int] = {}
        self.names = np.zeros(self.columns, np.int64)
        self.rare: list[dict[int, int]] = [{} for _ in range(n)]
        self.most = [0] * n

    def move(self, v: int, old: int, new: int) -> None:
        """``v`` has given up the label ``old`` for ``new``."""
        held = self.near.hubs.get(v, ())
        if not held:
            return
        if old in self.column:
            self.wide[held, self.column[old]] -= 1
        elif old != v:
            for h in held:
                self.rare[h][old] -= 1
                if not self.rare[h][old]:
                    del self.rare[h][old]
        if new in self.column:
            self.wide[held, self.column[new]] += 1
        elif new != v:
            widest = 0
            for h in held:
                n = self.rare[h][new] = self.rare[h].get(new, 0) + 1
                self.most[h] = max(self.most[h], n)
                widest = max(widest, n)
            if widest > self.FEW and self.used < self.columns:
                self._widen(new)

    def _widen(self, label: int) -> None:
        j = self.used
        if j == self.wide.shape[1]:
            more = np.zeros((len(self.rare), min(max(8, 2 * j), self.columns)), np.int32)
            more[:, :j] = self.wide
            self.wide = more
        self.wide[:, j] = [counts.pop(label, 0) for counts in self.rare]
        if self.label[label] == label:
            self.wide[self.near.hubs.get(label, []), j] += 1
        self.column[label], self.names[j] = j, label
        self.used += 1

    def settle(self) -> None:
        """Between rounds: columns without a large count become entries again, and the bounds exact."""
        top = self.wide[:, : self.used].max(axis=0, initial=0)
        keep = np.flatnonzero(top > self.FEW)
        for j in np.flatnonzero(top <= self.FEW).tolist():
            name = int(self.names[j])
            counts = self.wide[:, j].copy()
            if self.label[name] == name:
                counts[self.near.hubs.get(name, [])] -= 1
            for h in np.flatnonzero(counts).tolist():
                self.rare[h][name] = int(counts[h])
        self.wide = self.wide[:, keep].copy()
        self.names[: len(keep)] = self.names[keep]
        self.used = len(keep)
        self.column = {int(name): j for j, name in enumerate(self.names[: self.used])}
        self.most = [max(counts.values(), default=0) for counts in self.rare]

    def commonest(self, v: int, own: int) -> int:
        """The commonest label of the neighbours of ``v``, whose label is ``own``, the smallest of several; -1 if the bounds
        leave it open."""
        held = self.near.hubs[v]
        linked = _counts(self.label[self.near.linked(v)])
        rest = sum([self.most[h] for h in held]) + 1
        best, least = -1, 0
        others = []
        for label, n in linked.items():
            if label in self.column:
                continue
            inside = [self.rare[h].get(label, 0) for h in held]
            off = label == own != v
            low, high = max(n, max(inside) - off), n + sum(inside) - off * len(held) + (own != v or label != v)
            others.append((label, high))
            if low > least or low == least and label < best:
                best, least = label, low
        if self.used:
            here = self.wide[held, : self.used]
            high, low = here.sum(axis=0), here.max(axis=0)
            if own in self.column:
                high[self.column[own]] -= len(held)
                low[self.column[own]] -= 1
            for label, n in linked.items():
                if label in self.column:
                    j = self.column[label]
                    high[j] += n
                    low[j] = max(low[j], n)
            top = int(low.max())
            if top >= least:
                label = int(self.names[: self.used][low == top].min())
                if top > least or best < 0 or label < best:
                    best, least = label, top
            near_by = np.flatnonzero(high >= least)
            others += zip(self.names[near_by].tolist(), high[near_by].tolist(), strict=True)
        if rest >= least or any(n > least or n == least and label < best for label, n in others if label != best):
            return -1
        return best


def _counts(labels: np.ndarray) -> dict[int, int]:
    if len(labels) > 64:
        kinds, times = np.unique(labels, return_counts=True)
        return dict(zip(kinds.tolist(), times.tolist(), strict=True))
    out: dict[int, int] = {}
    for label in labels.tolist():
        out[label] = out.get(label, 0) + 1
    return out


def settle_labels(near: Neighbours, n: int, rounds: int = 40) -> np.ndarray:
    """Labels of vertices ``0 .. n - 1`` after at most ``rounds`` visits of all in order, where a visited vertex takes
    the commonest label of its neighbours, the smallest of several.

    Vertices without a neighbour that has changed since their last visit are passed over: a vertex that changes marks
    those it is linked with, and its hubs take the time of the change. Neighbours by hubs are gathered only where the
    counts of the hubs leave the label open.
    """
    label = np.arange(n)
    counts = HubCounts(near, label)
    marked, seen, changed = np.ones(n, bool), {}, [0] * len(near.members)
    hubs, bounds, targets, mark, now = near.hubs, memoryview(near.bounds), memoryview(near.targets), memoryview(marked), memoryview(label)
    time = 0
    for _ in range(rounds):
        before = time
        for v in range(n):
            held = hubs.get(v)
            if not mark[v] and not (held and any(changed[h] > seen[v] for h in held)):
                continue
            mark[v] = False
            own, lo, hi = now[v], bounds[v], bounds[v + 1]
            if held:
                seen[v] = time
                best = counts.commonest(v, own)
                if best < 0:
                    around = near.of(v)
                    if not len(around):
                        continue
                    kinds, times = np.unique(label[around], return_counts=True)
                    best = int(kinds[np.argmax(times)])
            elif hi - lo == 1:
                best = now[targets[lo]]
            elif hi > lo:
                best = min((-k, x) for x, k in _counts(label[near.targets[lo:hi]]).items())[1]
            else:
                continue
            if best != own:
                now[v] = best
                time += 1
                marked[near.targets[lo:hi]] = True
                if held:
                    counts.move(v, own, best)
                    for h in held:
                        changed[h] = time
        if time == before:
            break
        counts.settle()
    return label


def strong_components(adjacency: dict) -> list[set]:
    """Sets of vertices that reach each other: finishing order of the graph, then reachability in the
    reversed graph."""
    seen, finished = set(), []
    for root in sorted(adjacency):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(adjacency[root]))]
        while stack:
            here, rest = stack[-1]
            step = next((u for u in rest if u not in seen), None)
            if step is None:
                finished.append(here)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(adjacency.get(step, ()))))
    back: dict = {}
    for v, out in adjacency.items():
        for u in out:
            back.setdefault(u, set()).add(v)
    placed: set = set()
    groups = []
    for root in reversed(finished):
        if root in placed:
            continue
        group, front = {root}, [root]
        placed.add(root)
        while front:
            for u in back.get(front.pop(), ()):
                if u not in placed:
                    placed.add(u)
                    group.add(u)
                    front.append(u)
        groups.append(group)
    return groups


def _by_component(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their component and its number of edges."""
    comp = components(pairs)
    tagged = pairs.join(comp.withColumnRenamed("id", "a"), "a")
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    return materialize(tagged.join(sizes, "component"), "components")


def articulation(pairs: DataFrame, most: int = KERNEL_EDGES) -> DataFrame:
    """``id`` of all cut vertices.

    The kernel sees every component once. Components over ``most`` edges are first reduced, by two rounds of
    spanning forests, to at most twice as many edges as vertices, which keeps all cut vertices.
    """
    tagged = _by_component(pairs)
    small = tagged.where(F.col("m") <= most)

    def kernel(table: pa.Table) -> pa.Table:
        return _strings(id=sorted(cut_vertices(_adjacency(_arcs(table)))))

    found = small.select("component", "a", "b").groupBy("component").applyInArrow(kernel, "id string")
    if tagged.where(F.col("m") > most).limit(1).count():
        big = tagged.where(F.col("m") > most).select("component", "a", "b")
        first = spanning_forest(big)
        second = spanning_forest(big.join(first, ["a", "b"], "left_anti"))
        thin = first.unionByName(second).join(big, ["a", "b"]).select("component", "a", "b")
        found = found.unionByName(thin.groupBy("component").applyInArrow(kernel, "id string"))
    return found


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """``a, b``: breadth-first forests from the smallest vertex of every component. The levels come from
    joins; every vertex keeps one edge to the level before, the one to the smallest vertex."""
    comp = components(pairs)
    arcs = both_ways(pairs)
    level = materialize(comp.select(F.col("component").alias("id")).distinct().withColumn("level", F.lit(0)), "levels")
    front = level
    tree = None
    while front.limit(1).count():
        step = front.join(arcs, front["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = materialize(step.join(level, "id", "left_anti"), "front")
        tree = fresh if tree is None else tree.unionByName(fresh)
        front = fresh.select("id")
        level = level.select("id").unionByName(front)
    return tree.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))


def _with_hubs(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``pairs`` and an edge from every witness, marked U+0001, to its propositions."""
    from proofweave.operators.matrix import witness_groups

    return pairs.unionByName(witness_groups(links).select(F.concat(F.lit("\x01"), "witness").alias("a"), F.col("prop_id").alias("b")))


def _numbered_by_size(labels: DataFrame) -> DataFrame:
    labels = materialize(labels, "labels")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    places = numbered(sizes, "place", F.desc("n"), F.asc("label"))
    return labels.join(places, "label").select("id", (F.col("place") - 1).alias("community"))


def communities(pairs: DataFrame, links: DataFrame, props: DataFrame, most: int | None = None, together: int = ONE_TASK_EDGES) -> DataFrame:
    """``id, community``: label propagation on the probative graph, in which propositions argued through the
    same witness are neighbours too; communities are numbered by size, then by label.

    The labels depend on the order in which vertices are visited, so a component goes to one task, whatever its size;
    up to ``together`` edges the whole graph does. Should ``most`` be given and a component have more edges than that,
    witness hubs included, a ``ValueError`` names the operator to use instead.
    """
    every = materialize(_with_hubs(pairs, links), "hubs")
    if most is not None and _by_component(every).where(F.col("m") > most).limit(1).count():
        raise ValueError(f"a component has more than {most} edges: use communities_synchronous")
    places = _places(both_ways(every).select(F.col("src").alias("id")))
    ends = _by_place(every.withColumn("hub", F.startswith("a", F.lit("\x01"))), places)
    if every.count() <= together:
        ends = ends.repartition(1)
    else:
        ends = materialize(ends, "ends")
        ends = ends.join(components(ends.select("a", "b")).withColumnRenamed("id", "a"), "a").repartition("component")
    settled = materialize(ends.select("a", "b", "hub").mapInArrow(_settled, "place int, label int"), "settled")
    return _numbered_by_size(places.join(settled, "place").select("id", "label"))


def _settled(batches):
    """``place, label`` of the vertices of ``a, b, hub``: components do not meet, so any number of them is one graph."""
    parts = [(b["a"].to_numpy(), b["b"].to_numpy(), b["hub"].to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not parts:
        return
    a, b, hub = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    places = np.unique(np.concatenate([a[~hub], b]))
    of = np.searchsorted(places, b[hub]).astype(np.int32)
    order = np.argsort(a[hub], kind="stable")
    hubs = np.split(of[order], np.flatnonzero(np.diff(a[hub][order])) + 1) if len(order) else []
    ends = np.stack([np.searchsorted(places, a[~hub]), np.searchsorted(places, b[~hub])], 1)
    label = places[settle_labels(Neighbours(len(places), ends, hubs), len(places))]
    for k in range(0, len(places), 1 << 20):
        yield pa.RecordBatch.from_pydict({"place": pa.array(places[k : k + (1 << 20)]), "label": pa.array(label[k : k + (1 << 20)])})


def communities_synchronous(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``id, community``: label propagation in 20 rounds, in each of which one half of the vertices moves at once and
    a witness is a vertex of its own. Everything is a join, for graphs of any size; other labels than
    :func:`communities` gives, whose visits are one by one."""
    labels = _synchronous_labels(_with_hubs(pairs, links)).where(~F.startswith("id", F.lit("\x01")))
    return _numbered_by_size(labels)


def _synchronous_labels(pairs: DataFrame, rounds: int = 20) -> DataFrame:
    arcs = materialize(both_ways(pairs), "arcs")
    state = materialize(arcs.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for i in range(rounds):
        votes = arcs.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("best"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        state = materialize(state.join(best, state["id"] == best["src"]).select("id", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label")), "labels")
    return state


def cycles(deps: DataFrame, most: int = KERNEL_EDGES) -> DataFrame:
    """``id, loop`` of propositions that, through premises, rest on themselves; ``loop`` is the smallest id of
    the loop's members.

    Vertices without premises or without dependents cannot lie on a loop and are peeled off until none is
    left; what remains goes to the kernel by weak component, and weak components over ``most`` edges are
    searched by joins, forwards and backwards.
    """
    state = materialize(deps.where("from_id <> to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct(), "deps")
    size = state.count()
    while size:
        kept = state.join(state.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(state.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
        kept = materialize(kept, "deps")
        left = kept.count()
        state, before, size = kept, size, left
        if left == before:
            break
    comp = components(state.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tagged = state.join(comp.withColumnRenamed("id", "a"), "a")
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    tagged = materialize(tagged.join(sizes, "component"), "weak")

    def kernel(table: pa.Table) -> pa.Table:
        arcs = _arcs(table)
        adjacency: dict = {v: set() for arc in arcs for v in arc}
        for a, b in arcs:
            adjacency[a].add(b)
        rows = [(v, min(g)) for g in strong_components(adjacency) if len(g) > 1 for v in g]
        return _strings(id=[v for v, _ in rows], loop=[g for _, g in rows])

    found = tagged.where(F.col("m") <= most).select("component", "a", "b").groupBy("component").applyInArrow(kernel, "id string, loop string")
    big = tagged.where(F.col("m") > most).select("a", "b")
    return found.unionByName(_loops_by_reach(big)) if big.limit(1).count() else found


def _spread(state: DataFrame, arcs: DataFrame, source: str, target: str) -> DataFrame:
    """``id, mark`` after every vertex has taken the smallest mark of those that reach it along ``arcs``."""
    while True:
        sent = arcs.join(state, arcs[source] == state["id"]).select(F.col(target).alias("id"), "mark")
        fresh = materialize(state.unionByName(sent).groupBy("id").agg(F.min("mark").alias("mark")), "marks")
        moved = fresh.join(state.withColumnRenamed("mark", "old"), "id", "left").where(F.col("old").isNull() | (F.col("old") != F.col("mark"))).limit(1).count()
        state = fresh
        if not moved:
            return state


def _loops_by_reach(arcs: DataFrame) -> DataFrame:
    """``id, loop`` by joins: every vertex takes the smallest id that reaches it; those of the same mark that reach
    this id back form its loop. Loops found are taken away and the rest is searched again."""
    out = arcs.select(F.col("a").alias("id"), F.col("a").alias("loop")).limit(0)
    while arcs.limit(1).count():
        ids = arcs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        color = _spread(ids.withColumn("mark", F.col("id")), arcs, "a", "b")
        inside = arcs.join(color.select(F.col("id").alias("a"), F.col("mark").alias("ma")), "a").join(color.select(F.col("id").alias("b"), F.col("mark").alias("mb")), "b").where("ma = mb").select("a", "b")
        back = materialize(_spread(color.where("id = mark"), materialize(inside, "inside"), "b", "a"), "loops")
        several = back.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
        out = out.unionByName(back.join(several, "mark").select("id", F.col("mark").alias("loop")))
        gone = back.select("id")
        arcs = materialize(arcs.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"), "rest")
    return out


def best_articulation(cut: DataFrame, rank: DataFrame, props: DataFrame) -> DataFrame:
    """``id``: the highest-ranked proposition that is a cut vertex, or of all if none is."""
    ranked = props.select(F.col("prop_id").alias("id")).join(rank, "id", "left").join(cut.withColumn("cut", F.lit(True)), "id", "left")
    return ranked.orderBy(F.coalesce("cut", F.lit(False)).desc(), F.coalesce("rank", F.lit(0.0)).desc(), "id").limit(1).select("id")


def cypher(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """``statement``: one statement per vertex and edge for a property-graph database."""
    lit = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6), F.lit("null"))
    kind = F.when(F.col("kind") == "proposition", "Proposition").otherwise("Evidence")
    vertex = nodes_.select(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), lit("id"), F.lit("}) SET n.label="), lit("label"), F.lit(", n.status="), lit("status"), F.lit(", n.witness="), lit("witness"), F.lit(";")).alias("statement"))
    edge = edges_.select(F.concat(F.lit("MATCH (a {id: "), lit("source"), F.lit("}), (b {id: "), lit("target"), F.lit("}) MERGE (a)-[r:"), F.col("relation"), F.lit("]->(b) SET r.confidence="), F.col("confidence").cast("string"), F.lit(";")).alias("statement"))
    return vertex.unionByName(edge)


def community_summary(groups: DataFrame, rank: DataFrame, props: DataFrame) -> DataFrame:
    """``community, size, propositions, evidence, lead, label`` of communities that hold a proposition; the lead
    is the proposition of the highest rank, ties by id."""
    texts = props.select(F.col("prop_id").alias("id"), "text", F.lit(True).alias("is_prop"))
    held = groups.join(rank, "id", "left").join(texts, "id", "left")
    top = F.min_by(F.struct("id", "text"), F.when(F.col("is_prop"), F.struct(-F.coalesce("rank", F.lit(0.0)), "id")))
    rolled = held.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_prop").alias("propositions"), top.alias("top")).where("propositions > 0")
    return rolled.select("community", "size", "propositions", (F.col("size") - F.col("propositions")).alias("evidence"), F.col("top.id").alias("lead"), X.ellipsis(F.col("top.text"), 56).alias("label"))


def priority(rank: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` vertices of the highest rank, ties by id."""
    return rank.orderBy(F.desc("rank"), "id").limit(n)
