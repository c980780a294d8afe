"""Seeded samples and splits. "Random" order is the order of md5(seed|key), the same on every cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut, numbered_rows


def shuffle_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def stratified(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows a stratum; the limit is applied in each task before the shuffle."""
    order = Window.partitionBy(*strata).orderBy(shuffle_key(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def equal_shares(df: DataFrame, stratum: str, key: str, total: int, strata: int, seed: int = 42) -> DataFrame:
    """``total`` rows, first an equal share of each stratum, then others until full; all rows if there are fewer."""
    h = shuffle_key(F.col(key), seed)
    ranked = df.withColumns({"_h": h, "_r": F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))})
    return ranked.withColumn("_p", (F.col("_r") > total // strata).cast("int")).orderBy("_p", "_h", key).limit(total).drop("_h", "_r", "_p")


def hash_split(key: Column, cuts: tuple[tuple[str, int], ...] = (("train", 70), ("validation", 85), ("test", 100)), seed: int = 42) -> Column:
    """The split of a group's key: a bucket of 100 from its hash against cumulative cuts. No shuffle, never a leak."""
    bucket = F.pmod(F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    out = None
    for name, upto in cuts[:-1]:
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out.otherwise(cuts[-1][0])


def group_key(group: Column, own: Column) -> Column:
    """What is split together: the group, for a row without one the row itself."""
    return F.coalesce(F.concat(F.lit("g:"), group.cast("string")), F.concat(F.lit("s:"), own.cast("string")))


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits): groups that lie in more than one split."""
    g = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("splits"))
    return g.filter("splits > 1")


def rollup(df: DataFrame, group: str, turn: Column, action: str, *first: str) -> DataFrame:
    """(group, dominant, n, *first): groups with their most frequent action, of ties the one that comes first by turn."""
    c = df.filter(F.col(group).isNotNull()).groupBy(group, action).agg(F.count("*").alias("k"), F.min(turn).alias("t"), *(F.min(x).alias(x) for x in first))
    best = F.min(F.struct((-F.col("k")).alias("k"), F.col("t").alias("t"), F.col(action).alias("a")))
    return c.groupBy(group).agg(best.alias("b"), F.sum("k").alias("n"), *(F.min(x).alias(x) for x in first)).select(group, F.col("b.a").alias("dominant"), "n", *first)


def greedy_groups(groups: DataFrame, group: str, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """(group, dominant, n) of the groups taken: per dominant action, in shuffled order, each group that still fits the
    action's target. Skipping what overflows is no prefix sum, so it is a fold over the sizes of one action's groups.

    Groups too large for the target are dropped before, and of each size only as many as could fit together are kept
    (target // size of them, in order): others can't be taken. So a fold sees at most target * (1 + ln target) groups, a
    bound that doesn't grow with the data.
    """
    want = F.lit(None).cast("bigint")
    for a, t in targets.items():
        want = F.when(F.col("dominant") == a, F.lit(t)).otherwise(want)
    h = shuffle_key(F.col(group), seed)
    g = groups.withColumn("_t", want).filter(F.col("_t").isNotNull() & (F.col("n") <= F.col("_t"))).withColumn("_h", h)
    g = g.withColumn("_r", F.row_number().over(Window.partitionBy("dominant", "n").orderBy("_h", group))).filter(F.col("_r") <= F.floor(F.col("_t") / F.col("n")))
    lists = g.groupBy("dominant", "_t").agg(F.array_sort(F.collect_list(F.struct("_h", group, "n"))).alias("l"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast(f"array<{dict(groups.dtypes)[group]}>").alias("got"))
    fits = lambda acc, x: acc["sum"] + x["n"] <= F.col("_t")
    step = lambda acc, x: F.struct(
        F.when(fits(acc, x), acc["sum"] + x["n"]).otherwise(acc["sum"]).cast("bigint").alias("sum"), F.when(fits(acc, x), F.array_append(acc["got"], x[group])).otherwise(acc["got"]).alias("got")
    )
    taken = lists.select("dominant", F.explode(F.aggregate("l", start, step)["got"]).alias(group))
    return taken.join(groups.select(group, "n"), group).select(group, "dominant", "n")


def subsample(df: DataFrame, group: str, own: str, turn: Column, action: str, total: int, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """Rows of whole groups taken by ``greedy_groups``, filled up per action with rows that have no group."""
    rows = cut(df)
    targets = {a: int(total * r) for a, r in ratios.items()}
    taken = cut(greedy_groups(rollup(rows, group, turn, action), group, targets, seed))
    have = {r.dominant: r.n for r in taken.groupBy("dominant").agg(F.sum("n").alias("n")).collect()}
    rest = F.lit(0)
    for a, t in targets.items():
        rest = F.when(F.col(action) == a, F.lit(t - have.get(a, 0))).otherwise(rest)
    single = rows.filter(F.col(group).isNull()).withColumn("_r", F.row_number().over(Window.partitionBy(action).orderBy(shuffle_key(F.col(own), seed), own)))
    return rows.join(taken.select(group), group, "left_semi").unionByName(single.filter(F.col("_r") <= rest).drop("_r"))


def whole_prefix(groups: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """Groups (with n) in ``order`` until the first that would exceed ``limit`` rows. Sums run within ranges of the order, of
    which only the totals meet in one task."""
    ranked = cut(groups.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = ranked.groupBy("_p").agg(F.sum("n").alias("_s"))
    before = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.join(F.broadcast(before), "_p").withColumn("total", F.col("_before") + F.sum("n").over(within)).filter(F.col("total") <= limit).drop("_p", "_before")


def batches(df: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Rows with batch_no, ``size`` rows each in ``order``; ranks run within ranges of the order plus what lies before."""
    return numbered_rows(df, order, "_i").withColumn("batch_no", F.floor(F.col("_i") / size).cast("bigint")).drop("_i")


@dataclass(frozen=True)
class Trim:
    """What a trimmed corpus takes: so many single rows of some sources, so many rows of one source whose dialogues fill up what its
    single rows leave, and dialogues of one source up to a cap, as far as the actions' budgets last."""

    singles: dict[str, int]
    mixed: tuple[str, int]
    filler: tuple[str, int]
    budgets: dict[str, int]


def budgeted_trim(rows: DataFrame, t: Trim, turn: str = "turn_id", seed: int = 42) -> DataFrame:
    """(id, part) of the rows taken from ``rows`` (id, source, action, dialogue_id, multi_turn, turn), dialogues always whole.

    In shuffled order: rows without dialogue up to their source's number; the mixed source's rows, then its dialogues until its
    number is reached; at last the filler's dialogues, passing over those whose dominant action has no budget left, until its cap
    or all budgets are used up. Every row taken lowers its action's budget.

    The last step depends on every choice before it, so it is a fold. Of each dominant action only the first dialogues, as many as
    its budget, can be taken, as each lowers it by one at least; so the fold sees no more than the budgets together.
    """
    h = shuffle_key(F.col("id"), seed)
    data = cut(rows.select("id", "source", "action", "dialogue_id", turn, (F.coalesce("multi_turn", F.lit(False)) & F.col("dialogue_id").isNotNull()).alias("_m")))
    single, multi = data.filter("NOT _m"), data.filter("_m")
    quota = F.lit(0)
    for name, n in {**t.singles, t.mixed[0]: t.mixed[1]}.items():
        quota = F.when(F.col("source") == name, n).otherwise(quota)
    first = single.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(h, "id"))).filter(F.col("_r") <= quota)
    first = cut(first.select("id", "source", "action", F.lit("single").alias("part")))

    sizes = multi.groupBy("dialogue_id").agg(F.min("source").alias("source"), F.count("*").alias("n"), *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in t.budgets))
    dominant = rollup(multi, "dialogue_id", F.coalesce(F.col(turn), F.lit(0)), "action").select("dialogue_id", "dominant")
    d = cut(sizes.join(dominant, "dialogue_id").withColumn("_h", shuffle_key(F.col("dialogue_id"), seed)))
    rest = t.mixed[1] - first.filter(F.col("source") == t.mixed[0]).count()
    near = d.filter(F.col("source") == t.mixed[0]).orderBy("_h", "dialogue_id").limit(max(rest, 0))  # each has a row at least
    so_far = F.sum("n").over(Window.orderBy("_h", "dialogue_id")) - F.col("n")
    second = cut(near.withColumn("_before", so_far).filter(F.col("_before") < rest).select("dialogue_id"))
    second = cut(multi.join(second, "dialogue_id", "left_semi").select("id", "source", "action", F.lit("mixed").alias("part")))

    used = {r.action: r.n for r in first.unionByName(second).filter(F.col("action").isin(*t.budgets)).groupBy("action").agg(F.count("*").alias("n")).collect()}
    left = {a: max(0, b - used.get(a, 0)) for a, b in t.budgets.items()}
    most = F.lit(0)
    for a, b in left.items():
        most = F.when(F.col("dominant") == a, b).otherwise(most)
    pool = d.filter(F.col("source") == t.filler[0]).withColumn("_r", F.row_number().over(Window.partitionBy("dominant").orderBy("_h", "dialogue_id"))).filter(F.col("_r") <= most)
    entry = F.struct("_h", "dialogue_id", "dominant", "n", *(F.col(f"n_{a}") for a in left))
    state = F.struct(F.lit(0).cast("bigint").alias("added"), *(F.lit(b).cast("bigint").alias(f"b_{a}") for a, b in left.items()), F.array().cast("array<string>").alias("got"))

    def step(s: Column, x: Column) -> Column:
        own, total = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for a in left:
            own, total = F.when(x["dominant"] == a, s[f"b_{a}"]).otherwise(own), total + s[f"b_{a}"]
        take = (own > 0) & (total > 0) & (s["added"] < t.filler[1])
        return F.struct(
            F.when(take, s["added"] + x["n"]).otherwise(s["added"]).alias("added"),
            *(F.when(take, F.greatest(F.lit(0).cast("bigint"), s[f"b_{a}"] - x[f"n_{a}"])).otherwise(s[f"b_{a}"]).alias(f"b_{a}") for a in left),
            F.when(take, F.array_append(s["got"], x["dialogue_id"])).otherwise(s["got"]).alias("got"),
        )

    took = pool.agg(F.array_sort(F.collect_list(entry)).alias("l")).select(F.explode(F.aggregate("l", state, step)["got"]).alias("dialogue_id"))
    third = multi.join(took, "dialogue_id", "left_semi").select("id", F.lit("filler").alias("part"))
    return first.select("id", "part").unionByName(second.select("id", "part")).unionByName(third)
