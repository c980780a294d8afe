"""Problem 5: conversations from message rows.

Method: the rows are an event log. Creates, edits, retries and deletes of a turn are folded by version into the turn that
counts; surviving turns are ordered and each conversation is validated as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..runtime import cut, lookup


def fold_events(events: DataFrame, id_col: str, version_col: str, op: Column | None = None, **cols: Column) -> DataFrame:
    """One row (id, *cols) per event id: what its latest version says.

    ``op`` names the kind of an event; an id whose latest event is "delete" has no row. Every other kind sets the turn.
    Null versions are the earliest; of events with the same version the one with the greatest content counts, whatever
    the order of rows. Events without an id are no events.
    """
    kind = F.lower(F.coalesce(op, F.lit("create"))) if op is not None else F.lit("create")
    r = F.struct(F.col(version_col).alias("_v"), (kind == "delete").alias("_gone"), *(c.alias(n) for n, c in cols.items()))
    last = events.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), r.alias("_r")).groupBy("id").agg(F.max("_r").alias("_r"))
    return last.filter(~F.col("_r._gone")).select("id", *(F.col(f"_r.{n}").alias(n) for n in cols))


def whole_conversations(turns: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """(dialogue_key, turn_pos INT, id, query, response) of all turns of every conversation that holds.

    ``turns``: one row per id with dialogue_key, turn_id, query, response. A conversation holds if each of its turns has a
    turn_id and a query and a response that aren't blank, and if the turn_ids run from 0 or 1 without gap or repetition.
    Turns without a dialogue key belong to none. The verdict needs no sort and no list of a conversation's turns: with no
    number twice, the turns are gap-free if their count is last - first + 1, and then turn_pos is turn_id - first + 1.
    """
    rows = cut(
        turns.filter(F.col("dialogue_key").isNotNull()).select(
            "dialogue_key", "id", "turn_id", F.when(~is_blank("query"), F.col("query")).alias("query"), F.when(~is_blank("response"), F.col("response")).alias("response")
        )
    )
    bad = F.col("turn_id").isNull() | F.col("query").isNull() | F.col("response").isNull()
    by_turn = rows.groupBy("dialogue_key", "turn_id").agg(F.count("*").alias("n"), F.max(bad).alias("bad"))
    verdict = by_turn.groupBy("dialogue_key").agg(
        F.max("bad").alias("bad"), F.max("n").alias("most"), F.count("*").alias("n"), F.min("turn_id").alias("first"), F.max("turn_id").alias("last")
    )
    holds = verdict.filter(~F.col("bad") & (F.col("most") == 1) & F.col("first").isin(0, 1) & (F.col("last") - F.col("first") + 1 == F.col("n")))
    return (
        lookup(rows, "dialogue_key", holds.select("dialogue_key", "first"), hot_rows)
        .filter(F.col("first").isNotNull())
        .select("dialogue_key", (F.col("turn_id") - F.col("first") + 1).cast("int").alias("turn_pos"), "id", "query", "response")
    )


def messages(turns: DataFrame) -> DataFrame:
    """(dialogue_key, message_pos INT, role, content): two messages a turn, the user's and then the assistant's.

    Conversations stay rows, so that one of any length is never gathered in a task; message_pos orders them.
    """
    said = F.array(
        F.struct((2 * F.col("turn_pos") - 1).alias("message_pos"), F.lit("user").alias("role"), F.col("query").alias("content")),
        F.struct((2 * F.col("turn_pos")).alias("message_pos"), F.lit("assistant").alias("role"), F.col("response").alias("content")),
    )
    return turns.select("dialogue_key", F.inline(said))
