"""Similarity of short strings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Sequence matcher's ratio; 0 for nulls."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, u, v).ratio() if u and v else 0.0 for u, v in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def similar_hubs(degrees: DataFrame, top: int = 100, least: float = 0.82) -> DataFrame:
    """(a, b, ratio) of similar names among the ``top`` nodes of highest degree: a report on a list of fixed length, whose
    pairs are at most top * (top - 1) / 2. Pairs whose lengths rule the ratio out don't reach Python."""
    hubs = F.broadcast(degrees.orderBy(F.desc("degree"), "node").limit(top).select("node"))
    la, lb = F.char_length("a"), F.char_length("b")
    pairs = hubs.select(F.col("node").alias("a")).join(hubs.select(F.col("node").alias("b")), F.col("a") < F.col("b")).filter(2.0 * F.least(la, lb) / (la + lb) >= least)
    return pairs.withColumn("ratio", F.round(ratio(F.col("a"), F.col("b")), 4)).filter(F.col("ratio") >= least)
