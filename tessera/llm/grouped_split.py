"""Problem 2: splits that keep tied records together.

Method: random-mate contraction. Records and what ties them form a graph. In each round every vertex throws a coin; a tail
joins its smallest neighbour that shows heads, edges are renamed and deduplicated, until none is left. The chosen parents
form a forest of low depth, which pointer doubling unwinds into labels. Components are then dealt to the splits by
cumulative weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, cut_counted, drop, lookup


def origin_key(c: str = "id") -> Column:
    """Leading letters in lower case and first number without leading zeros; null if an id lacks either."""
    letters = F.lower(F.regexp_extract(c, r"^(\p{L}+)", 1))
    digits = F.regexp_extract(c, r"([0-9]+)", 1)
    return F.when((letters != "") & (digits != ""), F.concat_ws("\u0001", letters, F.regexp_replace(digits, r"^0+(?=[0-9])", "")))


#: Rounds that one hash of a vertex gives coins for.
_COINS = 60


def _heads(end: str) -> Column:
    return F.col(f"{end}.coins").bitwiseAND(F.lit(1)) == 1


def _tidy(edges: DataFrame) -> DataFrame:
    """Without loops and repetitions, the smaller end first."""
    swap = F.col("a.v") > F.col("b.v")
    return edges.filter("a.v <> b.v").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")).distinct()


def _toss(edges: DataFrame, seed: int) -> DataFrame:
    return edges.select(*(F.struct(F.col(f"{e}.v").alias("v"), F.xxhash64(F.lit(seed), f"{e}.v").alias("coins")).alias(e) for e in ("a", "b")))


def _next_coins(edges: DataFrame) -> DataFrame:
    return edges.select(*(F.struct(F.col(f"{e}.v").alias("v"), F.shiftrightunsigned(f"{e}.coins", 1).alias("coins")).alias(e) for e in ("a", "b")))


def _rename(edges: DataFrame, end: str, mates: DataFrame, hot_rows: int, rows: int) -> DataFrame:
    """Tails at ``end`` give way to their mates; vertices that show heads stay and so needn't be looked up."""
    other = "b" if end == "a" else "a"
    tails = edges.filter(~_heads(end)).select(F.col(f"{end}.v").alias("v"), end, other)
    found = lookup(tails, "v", mates, hot_rows, rows).select(F.coalesce("p", end).alias(end), other)
    return edges.filter(_heads(end)).select(end, other).unionByName(found)


def mate(a: np.ndarray, b: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The root of each of ``n`` vertices by random-mate contraction of the edges (a, b), in memory."""
    up, rng = np.arange(n), np.random.default_rng(seed)
    while len(a):
        heads = rng.random(n) < 0.5
        x, y = np.concatenate((a, b)), np.concatenate((b, a))
        joins = ~heads[x] & heads[y]
        p = np.full(n, n)
        np.minimum.at(p, x[joins], y[joins])
        tails = np.flatnonzero(p < n)
        up[tails] = p[tails]
        a, b = up[a], up[b]
        a, b = np.divmod(np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b]), n)
    while (up[up] != up).any():
        up = up[up]
    return up


def _finish(edges: DataFrame, seed: int) -> DataFrame:
    """(v, p) of the last, few edges, contracted by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=object), *batches])
        names, at = np.unique(np.concatenate((some["a"].to_numpy(object), some["b"].to_numpy(object))), return_inverse=True)
        if len(names):
            root = mate(*np.split(at, 2), len(names), seed)
            moved = root != np.arange(len(names))
            yield pd.DataFrame({"v": names[moved], "p": names[root[moved]]})

    return edges.select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).coalesce(1).mapInPandas(run, "v string, p string")


def contract(edges: DataFrame, seed: int = 42, hot_rows: int = 200_000, most_rounds: int = 300, few: int = 20_000) -> DataFrame:
    """(v, root): the component of every vertex that isn't the root of its own, for edges (a STRING, b STRING).

    Loops, repeated edges and nulls are allowed and carry no meaning; no edges give no rows. A round halves the expected
    number of edges between lone pairs and removes at least a quarter of the vertices that have edges, so rounds grow with
    the logarithm of the input. Each round is stored in the shared checkpoint folder, and the one before is deleted. Vertices
    with a great many edges are renamed by broadcast (see ``lookup``); minima are combined before the shuffle. The coins are
    bits of a vertex's hash, shifted on each round, so that all rounds run the same compiled plan. The last ``few`` edges
    are contracted in the same way by one task, which saves the rounds that would move next to nothing.
    """
    left, rows = cut_counted(_tidy(_toss(edges.select(F.struct(F.col("a").alias("v")).alias("a"), F.struct(F.col("b").alias("v")).alias("b")), seed)))
    parents, stored, turn = [], [], 0
    while rows > few:
        turn += 1
        if turn > most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mates = cut(both.filter(~_heads("a") & _heads("b")).groupBy(F.col("a.v").alias("v")).agg(F.min("b").alias("p")))
        renamed = _rename(_rename(left, "a", mates, hot_rows, rows), "b", mates, hot_rows, rows)
        last, (left, rows) = left, cut_counted(_tidy(_next_coins(renamed) if turn % _COINS else _toss(renamed, seed + turn)))
        drop(last)
        stored.append(mates)
        parents.append(mates.select("v", F.col("p.v").alias("p")))
    parents.append(_finish(left, seed))
    forest, rows = cut_counted(reduce(DataFrame.unionByName, parents))
    drop(left, *stored)
    while True:
        step = cut(lookup(forest, "p", forest.select(F.col("v").alias("p"), F.col("p").alias("_up")), hot_rows, rows).select("v", F.coalesce("_up", "p").alias("p"), F.col("_up").isNotNull().alias("moved")))
        drop(forest)
        if step.filter("moved").isEmpty():
            return step.select("v", F.col("p").alias("root"))
        forest = step


def tied_groups(records: DataFrame, ties: list[str], seed: int = 42, hot_rows: int = 200_000, few: int = 20_000) -> DataFrame:
    """(id, group_id, n) for distinct non-null ids: records with the same non-null value in any column of ``ties`` are tied,
    ties carry over, group_id is the smallest id of the group and n its number of ids. A record without ties is alone.

    ``records`` has one row per id, repeated rows count once; other columns are ignored.
    """
    tagged = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{ties.index(c)}:"), F.col(c)))
    rows = cut(
        records.filter(F.col("id").isNotNull()).select(
            "id", F.filter(F.array(*(tagged(c) for c in ties)), lambda t: t.isNotNull()).alias("t")
        ).distinct().select("id", F.coalesce(F.get("t", F.lit(0)), F.concat(F.lit("i:"), "id")).alias("v"), "t")
    )
    edges = rows.select(F.col("v").alias("a"), F.explode("t").alias("b"))
    named = lookup(rows.select("id", "v"), "v", contract(edges, seed, hot_rows, few=few), hot_rows)
    placed = cut(named.select("id", F.coalesce("root", "v").alias("root")))
    groups = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n"))
    return lookup(placed, "root", groups, hot_rows).select("id", "group_id", "n")


def deal(groups: DataFrame, shares: dict[str, float], seed: int = 42, buckets: int = 1024) -> DataFrame:
    """(group_id, n, split) for groups (group_id, n): splits by cumulative weight in the order of a hash.

    A group goes where its weight begins, so a split misses its share by less than one group. Groups heavier than the
    smallest share come first and so fall to the first split named. Sums run within hash buckets, of which only the
    totals meet in one task; there is one more bucket for every 100,000 groups beyond ``buckets`` times that.
    """
    total = groups.agg(F.sum("n").alias("_all"), F.greatest(F.lit(buckets), F.floor(F.count("*") / 100_000)).alias("_n"))
    low = min(shares.values())
    h = F.xxhash64(F.lit(seed), F.col("group_id"))
    g = groups.crossJoin(F.broadcast(total)).withColumns({"_h": h, "_b": F.when(F.col("n") > low * F.col("_all"), -1).otherwise(F.pmod(h, F.col("_n")))})
    sums = g.groupBy("_b").agg(F.sum("n").alias("_s"))
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_base"))
    within = Window.partitionBy("_b").orderBy("_h", "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (F.col("_base") + F.sum("n").over(within) - F.col("n")) / F.col("_all")
    split, edge = None, 0.0
    for name, share in list(shares.items())[:-1]:
        edge += share
        split = F.when(at < edge, name) if split is None else split.when(at < edge, name)
    last = list(shares)[-1]
    return g.join(F.broadcast(before), "_b").select("group_id", "n", (split.otherwise(last) if split is not None else F.lit(last)).alias("split"))
