"""State and history of dialogues, over strictly earlier turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

_NONE = "array<string>"


def turn_no(c: str = "turn_id") -> Column:
    """The turn number; a missing one counts as 0, so that such turns never precede one another."""
    return F.coalesce(F.col(c), F.lit(0))


def _earlier(dialogue: str, turn: str) -> Window:
    # RANGE, not ROWS: turns with the same number don't see each other
    return Window.partitionBy(dialogue).orderBy(turn_no(turn)).rangeBetween(Window.unboundedPreceding, -1)


def multi_turn_rows(df: DataFrame, flag: str = "multi_turn", dialogue: str = "dialogue_id") -> tuple[DataFrame, DataFrame]:
    """(rows of dialogues, single rows): a row is of a dialogue if it is flagged and has a dialogue id."""
    is_multi = F.coalesce(F.col(flag), F.lit(False)) & F.col(dialogue).isNotNull()
    return df.filter(is_multi), df.filter(~is_multi)


def _clean(a: Column) -> Column:
    return F.filter(F.coalesce(a, F.array().cast(_NONE)), lambda v: v.isNotNull() & (v != ""))


def running_state(df: DataFrame, dialogue: str = "dialogue_id", turn: str = "turn_id", known: str = "known", missing: str = "missing", action: str = "action") -> DataFrame:
    """``df`` with cum_known, cum_resolved and still_missing, each sorted and distinct, of strictly earlier turns.

    A question resolves its first missing value, which is then known. Each value is reduced to the turn it first occurs in, by
    dialogue and value, before a dialogue's turns meet; so what is gathered is what the result holds, however often values are
    repeated. Rows without a dialogue have no earlier turns.
    """
    none = F.array().cast(_NONE)
    first = F.when((F.col(action) == "ASK") & (F.size(F.coalesce(missing, none)) > 0), F.array(F.get(missing, F.lit(0)))).otherwise(none)
    kinds = {"k": F.concat(_clean(F.col(known)), first), "r": first, "m": _clean(F.col(missing))}
    marked = lambda kind, a: F.transform(a, lambda v: F.struct(F.lit(kind).alias("_kind"), v.alias("_v")))
    said = F.concat(*(marked(kind, a) for kind, a in kinds.items()))
    there = df.filter(F.col(dialogue).isNotNull())
    begun = there.select(dialogue, turn_no(turn).alias("_t"), F.inline(said)).groupBy(dialogue, "_kind", "_v").agg(F.min("_t").alias("_t"))
    new = begun.groupBy(dialogue, "_t").agg(*(F.collect_list(F.when(F.col("_kind") == k, F.col("_v"))).alias(f"_{k}") for k in kinds))
    turns = there.select(dialogue, turn_no(turn).alias("_t")).distinct().join(new, [dialogue, "_t"], "left")
    w = Window.partitionBy(dialogue).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    earlier = turns.select(dialogue, "_t", *(F.array_sort(F.flatten(F.collect_list(f"_{k}").over(w))).alias(f"_{k}") for k in kinds))
    out = df.withColumn("_t", turn_no(turn)).join(earlier, [dialogue, "_t"], "left")
    known_, resolved, gaps_ = (F.coalesce(f"_{k}", none) for k in kinds)
    return out.select(*df.columns, known_.alias("cum_known"), resolved.alias("cum_resolved"), F.array_except(gaps_, resolved).alias("still_missing"))


def history(df: DataFrame, dialogue: str = "dialogue_id", turn: str = "turn_id", query: str = "query", response: str = "response", action: str = "action", missing: str = "missing",
            dummies: tuple[str, ...] = (), cap: int = 120, last: int | None = None) -> DataFrame:
    """``df`` with history: ARRAY<STRUCT<turn_id, query, action, response, resolved>> of strictly earlier turns in order.

    A dummy response is replaced by what its action meant; responses are cut to ``cap`` characters; ``last`` keeps the last
    so many entries. Turns with the same number are ordered by query.
    """
    gap = F.when((F.col(action) == "ASK") & (F.size(F.coalesce(missing, F.array().cast(_NONE))) > 0), F.get(missing, F.lit(0)))
    dummy = strip(response).isin(*dummies) if dummies else F.lit(False)
    said = F.when(dummy & gap.isNotNull(), F.concat(F.lit("[asked for: "), gap, F.lit("]"))).when(dummy & (F.col(action) == "ABSTAIN"), "[could not answer]").otherwise(F.col(response))
    entry = F.struct(turn_no(turn).alias("turn_id"), F.col(query).alias("query"), F.col(action).alias("action"), F.substring(said, 1, cap).alias("response"), gap.alias("resolved"))
    h = F.array_sort(F.collect_list(entry).over(_earlier(dialogue, turn)))
    if last:
        h = F.slice(h, F.greatest(F.size(h) - last + 1, F.lit(1)), last)
    return df.withColumn("history", h)


def history_text(h: Column, query_cap: int = 80) -> Column:
    line = lambda e: F.concat(F.lit("Turn "), e["turn_id"].cast("string"), F.lit(" | "), e["action"], F.lit(" | Q: "), F.substring(e["query"], 1, query_cap), F.lit(" | A: "), F.coalesce(e["response"], F.lit("")))
    return F.array_join(F.transform(h, line), "\n")


def turn_cap(n: Column, steps: tuple[tuple[int, int], ...] = ((15, 10), (30, 15), (50, 25)), keep_all: int = 7, beyond: int = 35) -> Column:
    """How many first turns of a dialogue of ``n`` turns are kept."""
    out = F.when(n <= keep_all, n)
    for upto, cap in steps:
        out = out.when(n <= upto, cap)
    return out.otherwise(beyond)


def capped(df: DataFrame, dialogue: str = "dialogue_id", turn: str = "turn_id", tie: str = "id", cap=turn_cap) -> DataFrame:
    """The first turns of each dialogue, up to its cap."""
    w = Window.partitionBy(dialogue)
    ranked = df.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(turn_no(turn), tie))})
    return ranked.filter(F.col("_r") <= cap(F.col("_n"))).drop("_n", "_r")


def gaps(df: DataFrame, dialogue: str = "dialogue_id", turn: str = "turn_id") -> DataFrame:
    """(dialogue, turns, broken): whether two consecutive turn numbers differ by more than 1.

    Without a window: numbers that occur are counted distinct, and a dialogue has a gap if they are fewer than its span.
    """
    g = df.filter(F.col(dialogue).isNotNull()).groupBy(dialogue, turn_no(turn).alias("_t")).agg(F.count("*").alias("_n"))
    return g.groupBy(dialogue).agg(F.sum("_n").alias("turns"), (F.max("_t") - F.min("_t") + 1 > F.count("*")).alias("broken"))
