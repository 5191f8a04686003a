"""Filling containers of fixed capacity (linear grouping scheme).

Only the histogram of item sizes, at most ``capacity`` rows, decides the plan, so the plan is made on the
driver whatever the number of items. Large sizes are put into groups of equal cardinality and rounded up to
the largest of their group; the few rounded sizes are packed by column generation over container
configurations; the actual items are then substituted, which frees the rounding loss; small items go, largest
first, into the fullest container that still takes them. All of it works on runs of equal items and equal
containers. In Spark every item is numbered within its size and takes the container of its number: a join
with the plan, without any group of unbounded size.

How good the plan is: rounding up costs at most the containers of one group, a :data:`GROUPS`-th of the large
items, over the linear relaxation of the large items, before the substitution gives most of it back; small
items waste at most :data:`LARGE` of each container while any are left.

Defined results: an item larger than the capacity is divided into full containers and a rest, and only such
an item is; an item of size 0 (null or empty text) takes no room and is put into container 0; repeated rows
are items of their own; ties are numbered by key. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofweave.session import materialize

CAPACITY = 2_048
#: Share of the capacity above which a size is large.
LARGE = 0.125
#: Groups of large sizes.
GROUPS = 64
#: Items of one size that are numbered in one shard.
SHARD_ROWS = 100_000


def solve_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the rounded sizes and how often each is used; covers the demand.

    Column generation: the linear relaxation is solved by revised simplex steps whose columns come from a
    knapsack over the capacity; the whole parts are kept and the rest is packed best-fit decreasing.
    """
    m = len(sizes)
    width, need = np.asarray(sizes), np.asarray(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(60 * m):
        inverse = np.linalg.inv(basis)
        column = _knapsack(width, inverse.sum(0), capacity)
        if inverse.sum(0) @ column <= 1 + 1e-9:
            break
        move, level = inverse @ column, inverse @ need
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    level = np.linalg.solve(basis, need)
    used: dict[bytes, int] = {}
    left = np.asarray(demand, np.int64).copy()
    for k in np.argsort(-level):
        column = np.rint(basis[:, k]).astype(np.int64)
        held = column > 0
        times = int(max(0, min(np.floor(level[k] + 1e-9), (left[held] // column[held]).min()))) if held.any() else 0
        if times:
            used[column.tobytes()] = used.get(column.tobytes(), 0) + times
            left -= times * column
    order = np.argsort(-width)
    while left.any():
        room, column = capacity, np.zeros(m, np.int64)
        for k in order:
            n = min(int(left[k]), room // int(width[k]))
            column[k], room = n, room - n * int(width[k])
        held = column > 0
        times = max(1, int((left[held] // column[held]).min()))
        used[column.tobytes()] = used.get(column.tobytes(), 0) + times
        left -= times * column
    return [(np.frombuffer(k, np.int64), n) for k, n in used.items()]


def _knapsack(width: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of the highest value that fits."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in range(len(width)):
        w, v = int(width[k]), float(value[k])
        if v <= 0:
            continue
        # Unbounded items: a row of copies of size w is a running maximum along residues of w.
        for _ in range(capacity // w):
            better = best[:-w] + v > best[w:] + 1e-12
            if not better.any():
                break
            fresh = np.where(better, best[:-w] + v, best[w:])
            pick[w:][better] = k
            best[w:] = fresh
    # Follow the picks; a pick stays valid because values only grow along one item's copies.
    out, at = np.zeros(len(width)), int(np.argmax(best))
    rest = best[at]
    while at > 0 and rest > 1e-9:
        k = int(pick[at])
        if k < 0:
            at -= 1
            continue
        out[k] += 1
        at -= int(width[k])
        rest -= float(value[k])
    return out


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int]]:
    """``(size, first, last, container)``: the items number ``first`` to ``last - 1`` of a size lie in the
    containers ``container, container + 1, ...``, one in each."""
    sizes = sorted((s for s, n in histogram.items() if n and s > 0), reverse=True)
    if any(s > capacity for s in sizes):
        raise ValueError("an item is larger than the capacity")
    plan: list[tuple[int, int, int, int]] = []
    used = {s: 0 for s in sizes}
    rooms: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []
    opened = 0

    def leave(room: int, start: int, count: int) -> None:
        if count:
            if room not in rooms:
                rooms[room] = []
                insort(keys, room)
            rooms[room].append((start, count))

    big = [s for s in sizes if s > large * capacity]
    if big:
        total = sum(histogram[s] for s in big)
        quota = -(-total // groups)
        runs: list[list[list[int]]] = [[]]
        room = quota
        for s in big:
            n = histogram[s]
            while n:
                if not room:
                    runs.append([])
                    room = quota
                k = min(n, room)
                runs[-1].append([s, k])
                n, room = n - k, room - k
        rounded = [r[0][0] for r in runs]
        merged: dict[int, list[list[int]]] = {}
        for top, r in zip(rounded, runs, strict=True):
            merged.setdefault(top, []).extend(r)
        tops = sorted(merged, reverse=True)
        configurations = solve_configurations(tops, [sum(k for _, k in merged[t]) for t in tops], capacity)
        queue = {t: [list(x) for x in merged[t]] for t in tops}
        for column, times in configurations:
            # Runs of containers with equal contents: (offset, count, room), cut at every change of size.
            cells = [(0, times, capacity)]
            for t, copies in zip(tops, column, strict=True):
                for _ in range(int(copies)):
                    cells = _fill_slot(queue[t], cells, opened, used, plan)
            for offset, count, space in cells:
                leave(space, opened + offset, count)
            opened += times
    for s in (s for s in sizes if s <= large * capacity):
        n = histogram[s]
        while n:
            at = bisect_left(keys, s)
            if at == len(keys):
                fresh = -(-n // (capacity // s))
                leave(capacity, opened, fresh)
                opened += fresh
                continue
            space = keys[at]
            start, count = rooms[space].pop()
            if not rooms[space]:
                del rooms[space]
                keys.pop(at)
            k = min(n, count)
            plan.append((s, used[s], used[s] + k, start))
            used[s] += k
            n -= k
            leave(space - s, start, k)
            leave(space, start + k, count - k)
    return plan


def _fill_slot(queue: list[list[int]], cells: list[tuple[int, int, int]], base: int, used: dict[int, int], plan: list) -> list[tuple[int, int, int]]:
    """Put the next items of a group into one slot of every container of ``cells``."""
    out = []
    for offset, count, space in cells:
        while count:
            while queue and not queue[0][1]:
                queue.pop(0)
            if not queue:
                out.append((offset, count, space))
                break
            s, n = queue[0]
            k = min(n, count)
            plan.append((s, used[s], used[s] + k, base + offset))
            used[s] += k
            queue[0][1] -= k
            out.append((offset, k, space - s))
            offset, count = offset + k, count - k
    return out


def pieces(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``key, part_no, start_token, n_tokens``: items, those over the capacity divided."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    parts = sizes.select(key, n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("part_no"))
    start = F.col("part_no") * capacity
    return parts.select(key, "part_no", start.alias("start_token"), F.least(F.col("__n") - start, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``key, part_no, start_token, n_tokens, container_id`` for items ``key, size``."""
    items = materialize(pieces(sizes, key, size, capacity), "items")
    # Number the items of every size: within a shard by a window, across shards by the shards' counts. A size has
    # as many shards as its exact count asks for.
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    spark = sizes.sparkSession
    width = spark.createDataFrame([(s, -(-n // shard_rows)) for s, n in sorted(histogram.items())] or [(0, 1)], "n_tokens int, shards int")
    items = items.join(F.broadcast(width), "n_tokens").withColumn("shard", F.pmod(F.xxhash64(key, "part_no"), F.col("shards")).cast("int")).drop("shards")
    first: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}
    for r in sorted(items.groupBy("n_tokens", "shard").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per shard_rows items
        first.append((r["n_tokens"], r["shard"], seen.get(r["n_tokens"], 0)))
        seen[r["n_tokens"]] = seen.get(r["n_tokens"], 0) + r["n"]
    before = spark.createDataFrame(first or [(0, 0, 0)], "n_tokens int, shard int, before long")
    plan = spark.createDataFrame(make_plan(histogram, capacity) or [(0, 0, 0, 0)], "size int, lo long, hi long, container long")
    within = Window.partitionBy("n_tokens", "shard").orderBy(key, "part_no")
    numbered = items.withColumn("rn", F.row_number().over(within)).join(F.broadcast(before), ["n_tokens", "shard"]).withColumn("number", F.col("before") + F.col("rn") - 1)
    hit = (F.col("n_tokens") == F.col("size")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))
    placed = numbered.where("n_tokens > 0").join(F.broadcast(plan), hit)
    out = placed.select(key, "part_no", "start_token", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("container") + F.col("number") - F.col("lo")).alias("container_id"))
    empty = items.where("n_tokens = 0").select(key, "part_no", "start_token", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("container_id"))
    return out.unionByName(empty)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``containers, tokens, least, fullest``: containers used, tokens held, the least number of containers
    that could hold them, and the tokens of the fullest container."""
    per = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest")).select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), "fullest")
