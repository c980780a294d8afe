"""A registry of queries, each beside its SQL, and the views that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import widened

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; without SQL the driver only counts its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables whose rows are texts, so that work on a row outweighs moving it.
TEXTS = ("documents", "unified_samples", "kb", "ft_samples", "raw_records", "eval_items")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widened(df) if name in TEXTS else df


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of each id, flat: id, query, response, action, source, the parts of state and metadata, and docs."""
    m, s = (lambda c: F.col(f"metadata.{c}")), (lambda c: F.col(f"state.{c}"))
    cols = {
        "query": F.col("query"), "response": F.col("response"), "action": X.action_label("action"), "source": X.key("metadata.source"), "dialogue_id": m("dialogue_id"), "turn_id": m("turn_id"),
        "multi_turn": m("multi_turn"), "reasoning": m("requires_reasoning"), "difficulty": s("difficulty"), "failure_mode": s("failure_mode"), "completeness": s("completeness"),
        "known": s("known_variables"), "missing": s("missing_variables"), "docs": F.transform("context.documents", lambda d: d["text"]), "split": X.split_label("split"),
    }
    r = F.struct(F.col("ingested_at").alias("_v"), *(c.alias(n) for n, c in cols.items()))
    g = table(spark, sf_dir, "unified_samples").filter(F.col("id").isNotNull()).select("id", r.alias("r")).groupBy("id").agg(F.max("r").alias("r"))
    return g.select("id", *(F.col(f"r.{n}").alias(n) for n in cols))


# ---------------------------------------------------------------- the same views in SQL

S_WS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def s_words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{S_WS}+'), lambda w: w <> '')"


def s_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{S_WS}+|{S_WS}+$', '', 'g')"


def s_key(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def s_split(c: str) -> str:
    s = f"lower({s_strip(c)})"
    return f"CASE WHEN {s} IN ('train','training') THEN 'train' WHEN {s} IN ('val','valid','validation','dev') THEN 'validation' WHEN {s} = 'test' THEN 'test' END"


def s_action(c: str) -> str:
    s = f"upper({s_strip(c)})"
    return f"CASE WHEN {s} IN ('ANSWER','ASK','ABSTAIN') THEN {s} END"


def s_vectors(name: str, rows: str) -> str:
    """CTEs of the offline embedder's unit vectors ``name`` (k, b, x), one row per text and bucket, of ``rows`` (k, t)."""
    return f"""{name}_n AS (SELECT k, ('0x' || substr(md5(w), 1, 6))::BIGINT % 384 AS b, count(*)::DOUBLE AS c FROM (SELECT k, unnest({s_words("lower(t)")}) AS w FROM ({rows})) GROUP BY ALL),
{name} AS (SELECT k, b, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS x FROM {name}_n)"""


#: A sentence list: stripped, non-blank.
def s_sentences(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[^.!?]+[.!?]*'), lambda s: {s_strip('s')}), lambda s: s <> '')"


S_SAMPLES = f"""s AS (
  SELECT id, query, response, {s_action("action")} AS action, {s_key("metadata.source")} AS source, metadata.dialogue_id AS dialogue_id, metadata.turn_id AS turn_id,
    metadata.multi_turn AS multi_turn, metadata.requires_reasoning AS reasoning, state.difficulty AS difficulty, state.failure_mode AS failure_mode, state.completeness AS completeness,
    state.known_variables AS known, state.missing_variables AS missing, list_transform(context.documents, lambda d: d.text) AS docs, {s_split("split")} AS split
  FROM unified_samples WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"""

#: Context text: trimmed non-blank document texts joined by a blank.
S_CTX = f"array_to_string(list_filter(list_transform(docs, lambda t: {s_strip('coalesce(t, chr(32))')}), lambda t: t <> ''), ' ')"
