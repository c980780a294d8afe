"""Problem 6: a sample that meets target proportions.

Method: a min-cost flow on the cross-classified counts of the cells (source, action). Arcs carry what a cell has, its floor, its
target and the margins of its source and action; slack arcs take what can't be met, so the shortfalls are read from them. The
integer quotas that the flow gives are drawn at random.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class MinCostFlow:
    """Cheapest paths one after the other, with potentials, for graphs as small as a table of cells. An arc has steps (room,
    cost) of rising cost, so that its cost is convex in its flow; costs aren't negative."""

    def __init__(self, nodes: int):
        self.out: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]  # (arc, 1 forth or -1 back)
        self.ends: list[tuple[int, int]] = []
        self.upto: list[list[int]] = []
        self.cost: list[list[int]] = []
        self.flow: list[int] = []

    def arc(self, a: int, b: int, *steps: tuple[int, int]) -> int:
        steps = tuple(s for s in steps if s[0] > 0)
        self.out[a].append((len(self.ends), 1))
        self.out[b].append((len(self.ends), -1))
        self.ends.append((a, b))
        self.upto.append([0, *accumulate(s[0] for s in steps)])
        self.cost.append([s[1] for s in steps])
        self.flow.append(0)
        return len(self.ends) - 1

    def _next(self, arc: int, way: int) -> tuple[int, int]:
        """(room, cost a unit) of an arc's present step."""
        upto, f = self.upto[arc], self.flow[arc]
        if way > 0:
            k = bisect_right(upto, f) - 1
            return (upto[k + 1] - f, self.cost[arc][k]) if k < len(upto) - 1 else (0, 0)
        k = bisect_left(upto, f) - 1
        return (f - upto[k], -self.cost[arc][k]) if f else (0, 0)

    def solve(self, s: int, t: int, amount: int) -> int:
        """Sends up to ``amount`` from s to t as cheaply as possible and returns how much went."""
        pot, sent = [0] * len(self.out), 0
        while sent < amount:
            dist: list[float] = [math.inf] * len(self.out)
            via: list[tuple[int, int]] = [(-1, 0)] * len(self.out)
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for arc, way in self.out[u]:
                    room, cost = self._next(arc, way)
                    v = self.ends[arc][way > 0]
                    if room and (x := d + cost + pot[u] - pot[v]) < dist[v]:
                        dist[v], via[v] = x, (arc, way)
                        heapq.heappush(heap, (x, v))
            if dist[t] == math.inf:
                break
            pot = [p + (d if d < math.inf else 0) for p, d in zip(pot, dist)]
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.ends[via[v][0]][via[v][1] < 0]
            push = min(amount - sent, *(self._next(*hop)[0] for hop in path))
            for arc, way in path:
                self.flow[arc] += way * push
            sent += push
        return sent


@dataclass(frozen=True)
class Quota:
    """What a cell gives, and why it gives no more: what it hasn't got of its floor and target, what had to make room."""

    quota: int
    unavailable: int
    displaced: int
    floor_shortfall: int


#: Steps in which a deviation of the size of a cell's target grows dearer; deviations are shared among cells to one step.
STEPS = 64
#: What going beyond the margin of a source, and of an action, costs in such steps.
OTHER_SOURCE, OTHER_ACTION = 24, 12


def _rising(room: int, unit: int, base: int) -> list[tuple[int, int]]:
    """Steps of a deviation of at most ``room``: dearer with each STEPS-th of ``unit``."""
    unit = max(unit, 1)
    width = -(-unit // STEPS)
    whole = min(room // width, 4 * STEPS)
    price = lambda k: base + k * width * STEPS // unit
    return [*((width, price(k)) for k in range(whole)), (room - whole * width, price(whole))]


def quotas(cells: list[tuple[str, str, float, int]], have: dict[tuple[str, str], int], n: int) -> list[Quota]:
    """The quota of each cell (source, action, share, floor) of a sample of ``n``, and its shortfalls.

    A cell needs its floor, and its target share * n rounded up. All needs are sent through the network. A unit that the cell
    hasn't got takes the slack arc ``unavailable``. A unit that it has takes a place of the sample or, where there are too few,
    leaves by the cheapest arc: the fraction by which a target was rounded up (so the fractions that stay are the largest),
    then targets, then floors, each dearer the more of it goes, so that what is missing is shared. Places that stay free for
    lack of records are filled beyond the needs, through the margins of source and action: cheaper where the source or the
    action lacks records, and again shared among cells.
    """
    exact = [c[2] * n for c in cells]
    need = [max(c[3], math.ceil(x), 0) for c, x in zip(cells, exact)]
    has = [have.get((c[0], c[1]), 0) for c in cells]
    sources, actions = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    k = len(cells)
    start, end, room, extra = range(4)
    cell, own = (lambda i: 4 + i), (lambda i: 4 + k + i)
    src, act = (lambda s: 4 + 2 * k + sources.index(s)), (lambda a: 4 + 2 * k + len(sources) + actions.index(a))
    lacks = [max(0, w - h) for w, h in zip(need, has)]
    free = max(0, n - sum(map(min, need, has)))
    g = MinCostFlow(4 + 2 * k + len(sources) + len(actions))
    unavailable, placed, beyond, target_out, floor_out = [], [], [], [], []
    for i, (source, action, _, floor) in enumerate(cells):
        g.arc(start, cell(i), (need[i], 0))
        g.arc(cell(i), own(i), (has[i], 0))
        unavailable.append(g.arc(cell(i), end, (need[i], 10**12)))
        placed.append(g.arc(own(i), room, (has[i], 0)))
        whole = max(floor, math.floor(exact[i]))
        g.arc(own(i), end, (min(need[i], has[i]) - whole, 1 + int(1000 * (exact[i] - math.floor(exact[i])))))
        target_out.append(g.arc(own(i), end, *_rising(min(whole, has[i]) - min(floor, has[i]), whole, 10**6)))
        floor_out.append(g.arc(own(i), end, *_rising(min(floor, has[i]), floor, 10**9)))
        beyond.append(g.arc(src(source), act(action), *_rising(has[i] - min(need[i], has[i]), need[i], 1)))
    for x in sources:
        g.arc(extra, src(x), (sum(m for m, c in zip(lacks, cells) if c[0] == x), 0), (free, OTHER_SOURCE))
    for x in actions:
        g.arc(act(x), room, (sum(m for m, c in zip(lacks, cells) if c[1] == x), 0), (free, OTHER_ACTION))
    g.arc(start, extra, (free, 0))
    g.arc(extra, end, (free, 10**12))
    g.arc(room, end, (max(n, 0), 0))
    g.solve(start, end, sum(need) + free)
    out = []
    for i, c in enumerate(cells):
        q = g.flow[placed[i]] + g.flow[beyond[i]]
        out.append(Quota(q, g.flow[unavailable[i]], g.flow[target_out[i]] + g.flow[floor_out[i]], max(0, c[3] - q)))
    return out


def _plan(records: DataFrame, targets: DataFrame) -> list[tuple]:
    """Rows of ``mixture_plan``; what is collected are the targets, one count for each of their cells, and one for the rest."""
    cells = sorted({(r.source, r.action, float(r.target_share), int(r.min_rows or 0)) for r in targets.collect() if r.source and r.action and r.target_share is not None})
    pairs = targets.select("source", "action", F.lit(True).alias("listed")).distinct()
    counts = records.filter(F.col("id").isNotNull()).groupBy("source", "action").count().join(F.broadcast(pairs), ["source", "action"], "left")
    own = lambda c: F.when(F.col("listed"), F.col(c)).alias(c)
    rows = counts.groupBy(own("source"), own("action")).agg(F.sum("count").alias("n")).collect()
    have, n = {(r.source, r.action): r.n for r in rows}, sum(r.n for r in rows) // 2
    return [
        (s, a, share, floor, share * n, have.get((s, a), 0), q.quota, q.unavailable, q.displaced, q.floor_shortfall, q.unavailable == 0)
        for (s, a, share, floor), q in zip(cells, quotas(cells, have, n))
    ]


_SCHEMA = (
    "source string, action string, target_share double, min_rows int, target double, available bigint, quota bigint, unavailable bigint, displaced bigint, floor_shortfall bigint, met boolean"
)


def mixture_plan(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per cell of ``targets`` (source, action, target_share, min_rows) for a sample of half of ``records``
    (id, source, action), one row per id, rounded down.

    ``unavailable`` is what the cell lacks of the greater of min_rows and target_share times the sample, by the flow's slack
    arc; a cell is met if that is nothing. ``displaced`` is what it has but had to give up because all floors and targets
    together exceed the sample, ``floor_shortfall`` what its quota lacks of min_rows. Records with a null or unlisted source or
    action count in the sample's size but in no cell. No targets give no rows.
    """
    return records.sparkSession.createDataFrame(_plan(records, targets), _SCHEMA)


def draw_mixture(records: DataFrame, targets: DataFrame, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """(id, source, action): each cell's quota, drawn without replacement as the records with the smallest hashes.

    The hash buckets that a quota fills are taken whole; only the one bucket per cell in which it ends is sorted, so no task
    sorts a cell, whatever its share of the rows.
    """
    plan = mixture_plan(records, targets).select("source", "action", "quota")
    h = F.xxhash64(F.lit(seed), F.col("id"))
    rows = records.select("id", "source", "action").filter(F.col("id").isNotNull()).join(F.broadcast(plan), ["source", "action"]).withColumns({"h": h, "b": F.pmod(h, F.lit(buckets))})
    sizes = rows.groupBy("source", "action", "quota", "b").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("source", "action").orderBy("b"))
    left = sizes.withColumn("rest", F.col("quota") - up_to + F.col("n")).filter("rest > 0").select("source", "action", "b", "n", "rest")
    taken = rows.join(F.broadcast(left), ["source", "action", "b"])
    ends = taken.filter("rest < n").withColumn("r", F.row_number().over(Window.partitionBy("source", "action", "b").orderBy("h", "id"))).filter("r <= rest")
    return taken.filter("rest >= n").select("id", "source", "action").unionByName(ends.select("id", "source", "action"))
