"""Profiles: shares, crosstabs, summaries, histograms, extremes. All are aggregates that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(df: DataFrame, *keys: str, digits: int = 2) -> DataFrame:
    """(*keys, n, pct): counts and percentages of the total. The window runs over the groups, not the rows."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), digits))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts by ``row`` with a column for each of ``values``, zero-filled. The values are given, so no pass looks for them."""
    return df.groupBy(row).agg(*(F.count_if(F.col(col) == v).alias(str(v)) for v in values))


def crosstab_pct(df: DataFrame, row: str, col: str, values: list[str], digits: int = 2) -> DataFrame:
    """As ``crosstab``, in percent of the row's sum; 0 for an empty row."""
    t, total = crosstab(df, row, col, values), sum((F.col(str(v)) for v in values), F.lit(0))
    return t.select(row, *(F.when(total > 0, F.round(100.0 * F.col(str(v)) / total, digits)).otherwise(0.0).alias(str(v)) for v in values))


def summary(df: DataFrame, value: Column | str, *keys: str, digits: int = 4) -> DataFrame:
    """(*keys, n, mean, std, min, p25, p50, p75, max), exact, with linear interpolation; std of a sample."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    r = lambda c, n: F.round(c, digits).alias(n)
    aggs = [F.count(v).alias("n"), r(F.avg(v), "mean"), r(F.stddev_samp(v), "std"), F.min(v).alias("min"), r(F.percentile(v, 0.25), "p25"), r(F.percentile(v, 0.5), "p50"), r(F.percentile(v, 0.75), "p75"), F.max(v).alias("max")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(lo, hi, n): right-closed bins between ``edges``; values outside and the lowest edge itself fall into none. Empty bins
    have a row."""
    spark = df.sparkSession
    bins = spark.createDataFrame(list(zip(edges[:-1], edges[1:])), "lo double, hi double")
    at = F.lit(None).cast("double")
    for lo, hi in zip(edges[:-1], edges[1:]):
        at = F.when((value > lo) & (value <= hi), F.lit(float(lo))).otherwise(at)
    counts = df.groupBy(at.alias("lo")).agg(F.count("*").alias("n")).filter(F.col("lo").isNotNull())
    return F.broadcast(bins).join(counts, "lo", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def extreme(df: DataFrame, keys: list[str], value: Column, tie: Column, cols: list[str], largest: bool = True) -> DataFrame:
    """The row with the greatest (least) value per key, of ties the one with the least ``tie``; combined before the shuffle."""
    order = F.struct((-value if largest else value).alias("v"), tie.alias("t"))
    g = df.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.struct(*cols).alias("r"))).alias("m"))
    return g.select(*keys, "m.r.*")


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, n): the most frequent non-null value per key, of ties the least."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias(value))).alias("b")).select(*keys, f"b.{value}", (-F.col("b.m")).alias("n"))


def top_elements(df: DataFrame, array: Column, k: int, name: str = "item") -> DataFrame:
    """The ``k`` most frequent elements, of ties the least first."""
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """One row: number of groups, least, mean, median and greatest size."""
    s = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("groups"), F.min("n").alias("min_n"), F.round(F.avg("n"), 4).alias("mean_n"), F.percentile("n", 0.5).alias("median_n"), F.max("n").alias("max_n"))


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """(size, groups): how many groups have each size."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that match every given value; a list means any of its values, None asks nothing."""
    for c, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df
