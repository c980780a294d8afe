"""Metrics of predicted actions and of texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import lower_words
from ..functions.text import strip

ACTIONS = ("ANSWER", "ASK", "ABSTAIN")


def confusion(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """(gt, pred, n) of all nine cells, zero-filled; other labels are left out."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in ACTIONS for b in ACTIONS], "gt string, pred string")
    counts = df.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return F.broadcast(cells).join(counts, ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def class_report(df: DataFrame, gt: str = "gt", pred: str = "pred", digits: int = 4) -> DataFrame:
    """(label, precision, recall, f1, support) of the three actions; 0 where a denominator is 0. One pass, three rows."""
    one = df.agg(*(f(a).alias(f"{a}_{k}") for a in ACTIONS for k, f in (
        ("tp", lambda a: F.count_if((F.col(gt) == a) & (F.col(pred) == a))), ("p", lambda a: F.count_if(F.col(pred) == a)), ("n", lambda a: F.count_if(F.col(gt) == a)))))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("label"), *(F.col(f"{a}_{k}").alias(k) for k in ("tp", "p", "n"))) for a in ACTIONS))))
    precision, recall = _safe(F.col("tp"), F.col("p")), _safe(F.col("tp"), F.col("n"))
    f1 = _safe(2 * precision * recall, precision + recall)
    return rows.select("label", F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"), F.round(f1, digits).alias("f1"), F.col("n").alias("support"))


def overall(df: DataFrame, gt: str = "gt", pred: str = "pred", confidence: str | None = None, digits: int = 4) -> DataFrame:
    """One row: n, accuracy, over- and under-answering, unknown predictions, selective accuracy and coverage, macro and
    weighted F1 over the three actions (an unknown prediction only lowers recall), and the gap in confidence between right
    and wrong."""
    g, p = F.col(gt), F.col(pred)
    ok = F.coalesce(g == p, F.lit(False))
    r = lambda c: F.round(c, digits)
    rate = lambda c: r(F.avg(F.coalesce(c, F.lit(False)).cast("double")))
    f1 = {a: _safe(2.0 * F.count_if((g == a) & (p == a)), F.count_if(g == a) + F.count_if(p == a)) for a in ACTIONS}
    support = {a: F.count_if(g == a) for a in ACTIONS}
    total = reduce(lambda x, y: x + y, support.values())
    out = [
        F.count("*").alias("n"), rate(ok).alias("accuracy"), rate((p == "ANSWER") & (g != "ANSWER")).alias("over_answer"), rate((p == "ABSTAIN") & (g == "ANSWER")).alias("under_answer"),
        F.count_if(~F.coalesce(p.isin(*ACTIONS), F.lit(False))).alias("unknown_preds"), r(_safe(F.count_if(ok & (p == "ANSWER")), F.count_if(p == "ANSWER"))).alias("selective_accuracy"),
        rate(p == "ANSWER").alias("coverage"), r(reduce(lambda x, y: x + y, f1.values()) / 3).alias("macro_f1"),
        r(_safe(reduce(lambda x, y: x + y, (f1[a] * support[a] for a in ACTIONS)), total)).alias("weighted_f1"),
    ]
    if confidence:
        out.append(r(F.coalesce(F.avg(F.when(ok, F.col(confidence))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~ok, F.col(confidence))), F.lit(0.0))).alias("confidence_gap"))
    return df.agg(*out)


def accuracy_by(df: DataFrame, *keys: str, gt: str = "gt", pred: str = "pred", digits: int = 4) -> DataFrame:
    ok = F.coalesce(F.col(gt) == F.col(pred), F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), digits).alias("accuracy"))


def exact_match(a: Column, b: Column) -> Column:
    return (F.lower(strip(F.coalesce(a, F.lit("")))) == F.lower(strip(F.coalesce(b, F.lit(""))))).cast("int")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of words; 0 if either is empty or none is shared."""
    x, y = F.array_distinct(lower_words(a)), F.array_distinct(lower_words(b))
    n = F.size(F.array_intersect(x, y))
    return F.when(n > 0, 2.0 * n / (F.size(x) + F.size(y))).otherwise(0.0)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, row by row with numpy."""
    if not a or not b:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(b))}
    y, row = np.array([codes[w] for w in b]), np.zeros(len(b) + 1, np.int64)
    for w in a:
        if (k := codes.get(w)) is not None:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == k)))
    return int(row[-1])


def rouge_l(a: Column, b: Column) -> Column:
    """F of the longest common subsequence of lower-case words, without stemming; 0 for empty texts."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y):
            p, q = (u or "").lower().split(), (v or "").lower().split()
            out.append(2.0 * lcs(p, q) / (len(p) + len(q)) if p and q else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")(a, b)


def question_rate(df: DataFrame, action: str, response: str, digits: int = 4) -> DataFrame:
    """One row: of ASK responses, the share that ends in a question mark."""
    ask = F.col(action) == "ASK"
    ends = F.coalesce(strip(response).endswith("?"), F.lit(False))
    return df.agg(F.count_if(ask).alias("asks"), F.round(_safe(F.count_if(ask & ends), F.count_if(ask)), digits).alias("question_rate"))


def compare(systems: dict[str, DataFrame], baseline: str, metrics: list[str]) -> DataFrame:
    """(metric, one column a system, delta_<system> against the baseline) from one-row metric tables."""
    pairs = lambda: F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("system"), pairs()) for n, df in systems.items()])
    wide = rows.groupBy("metric").pivot("system", list(systems)).agg(F.first("value"))
    return wide.select("metric", *systems, *(F.round(F.col(n) - F.col(baseline), 4).alias(f"delta_{n}") for n in systems if n != baseline))
