"""Evidence, ambiguity and conflict of a query's hits, and the rules that choose ANSWER, ASK or ABSTAIN."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import action_line, key_line, lower_words
from ..functions.text import strip, ws_words

# The word lists and weights of the signals.
STOP_WORDS = ("is", "the", "a", "an", "of", "in", "and", "or", "to", "it", "that", "this", "for", "on", "at")
PRONOUNS = ("it", "its", "they", "their", "this", "that", "these", "those", "he", "she", "him", "her")
VAGUE = ("something", "anything", "everything", "some", "any", "many", "various", "certain", "related")
STARTERS = ("can", "does", "is", "are", "what", "who", "when", "where", "why", "how")
COMPARATIVE = ("better", "worse", "difference", "compare", "vs", "versus", "between")
SIGNAL_WEIGHTS = (1.0, 0.8, 0.6, 0.4, 0.7)


@dataclass(frozen=True)
class Thresholds:
    confidence: float = 0.35
    coverage: float = 0.30
    ambiguity: float = 0.45
    conflict: float = 0.70


def unit(x: Column) -> Column:
    """A score as it is inside [0, 1], its logistic value outside."""
    return F.when((x > 1) | (x < 0), 1 / (1 + F.exp(-x))).otherwise(x)


def evidence(query: Column, scores: Column, texts: Column) -> Column:
    """STRUCT of confidence (best), mean, gap between the first two, coverage and number of hits, for arrays in rank order.

    Coverage is the share of the query's distinct content words that occur anywhere in the texts; with no content word it is
    the confidence. No hits: all 0.
    """
    s = F.transform(scores, unit)
    words = F.array_except(F.array_distinct(lower_words(query)), F.array(*map(F.lit, STOP_WORDS)))
    body = F.lower(F.array_join(texts, " "))
    n, some = F.size(scores), F.size(scores) > 0
    hit = F.size(F.filter(words, lambda w: F.contains(body, w)))
    best = F.array_max(s)
    out = {
        "confidence": F.round(best, 4),
        "coverage": F.round(F.when(F.size(words) == 0, best).otherwise(hit / F.size(words)), 4),
        "gap": F.round(F.when(n > 1, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).otherwise(best), 4),
        "mean": F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n, 4),
    }
    return F.struct(*(F.when(some, c).otherwise(0.0).alias(k) for k, c in out.items()), F.when(some, n).otherwise(0).alias("n"))


def ambiguity(query: Column) -> Column:
    """Mean of five signals: at most four words, a pronoun, a vague word, no capitalised word but question starters, a
    comparison of fewer than two names."""
    raw, low = ws_words(query), lower_words(query)
    has = lambda names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    upper = lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}"))
    named = F.exists(raw, lambda w: (F.char_length(w) > 2) & ~F.lower(w).isin(*STARTERS) & upper(w))
    signals = [F.size(low) <= 4, has(PRONOUNS), has(VAGUE), ~named, has(COMPARATIVE) & (F.size(F.filter(raw, upper)) < 2)]
    total = F.lit(0.0)
    for s, w in zip(signals, SIGNAL_WEIGHTS):
        total = total + F.when(s, F.lit(w)).otherwise(0.0)
    return F.round(total / len(SIGNAL_WEIGHTS), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def conflict(hits: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, conflict) for hits (query_id, rank, vec): 1 - the mean similarity of all pairs of the first ``most``, at
    least 0; 0 for fewer than two. The pairs are made inside a row of at most ``most`` vectors."""
    top = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["rank"] > a["rank"]), lambda b: dot(a["vec"], b["vec"]))))
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)
    return top.select("query_id", F.when(F.size("v") < 2, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - mean), 4)).alias("conflict"))


def text_conflict(rows: DataFrame, key: str, texts: str, embed, most: int = 4) -> DataFrame:
    """``rows`` with con, the conflict of the first ``most`` of ``texts``, arrays in rank order. ``rows`` are read twice."""
    h = rows.select(F.col(key).alias("query_id"), F.posexplode(F.slice(texts, 1, most)).alias("p", "t")).select("query_id", (F.col("p") + 1).alias("rank"), embed(F.col("t")).alias("vec"))
    c = conflict(h, most).select(F.col("query_id").alias(key), F.col("conflict").alias("con"))
    return rows.join(c, key, "left").withColumn("con", F.coalesce("con", F.lit(0.0)))


# The actions' reasons and the thresholds above are fixed values.


def _ladder(*rules: tuple[Column, str, str]) -> Column:
    out = None
    for when, action, reason in rules:
        s = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        out = F.when(when, s) if out is None else out.when(when, s)
    return out.otherwise(F.struct(F.lit("ANSWER").alias("action"), F.lit("sufficient_evidence").alias("reason")))


def gate(ev: Column, amb: Column, con: Column, label: Column, t: Thresholds = Thresholds()) -> Column:
    """STRUCT<action, reason>: the first rule that holds decides; a query that none stops is answered."""
    return _ladder(
        (ev["n"] == 0, "ABSTAIN", "no_context_retrieved"),
        ((label == "NOT_ANSWERABLE") & (ev["confidence"] < t.confidence), "ABSTAIN", "low_confidence_not_answerable"),
        ((con >= t.conflict) & (amb >= t.ambiguity), "ASK", "high_conflict_and_ambiguity"),
        (ev["coverage"] < t.coverage, "ABSTAIN", "low_coverage"),
        (amb >= t.ambiguity, "ASK", "ambiguous_query"),
        (label == "NEEDS_CLARIFICATION", "ASK", "llm_needs_clarification"),
        (ev["confidence"] < t.confidence, "ABSTAIN", "low_confidence"),
    )


def gate_strict(ev: Column, amb: Column, con: Column, label: Column, t: Thresholds = Thresholds()) -> Column:
    """The variant in which conflict alone makes ASK and the label alone makes ABSTAIN; thresholds must be exceeded."""
    return _ladder(
        (con > t.conflict, "ASK", "context_conflict"),
        ((ev["confidence"] < t.confidence) & (ev["coverage"] < t.coverage), "ABSTAIN", "insufficient_evidence"),
        (amb > t.ambiguity, "ASK", "query_ambiguous"),
        (label == "NOT_ANSWERABLE", "ABSTAIN", "not_answerable"),
        (label == "NEEDS_CLARIFICATION", "ASK", "needs_clarification"),
    )


def rule_label(ev: Column, amb: Column, t: Thresholds = Thresholds()) -> Column:
    """The answerability label where no model gives one: by confidence, coverage and ambiguity."""
    return (
        F.when((ev["confidence"] >= t.confidence) & (ev["coverage"] >= 0.5), "ANSWERABLE").when(amb >= t.ambiguity, "NEEDS_CLARIFICATION").otherwise("NOT_ANSWERABLE")
    )


def as_question(text: Column, fallback: str = "Could you say more about this?") -> Column:
    """The first line of a reply, made to end with a question mark; ``fallback`` for a blank one."""
    line = strip(F.get(F.split(F.coalesce(strip(text), F.lit("")), "\n"), F.lit(0)))
    return F.when(line == "", fallback).when(line.endswith("?"), line).otherwise(F.concat(F.regexp_replace(line, r"[.!\s]+$", ""), F.lit("?")))


def abstain_reason(query: Column, triples: Column, known: Column, missing: Column) -> Column:
    """Why nothing can be said: a vague query of which nothing is known, a graph without known values, named gaps, or else a
    subject that isn't covered."""
    empty = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) == 0
    return (
        F.when((F.size(ws_words(query)) < 5) & empty(known), "too_vague")
        .when(~empty(triples) & empty(known), "graph_not_connected")
        .when(~empty(missing), "missing_information")
        .otherwise("not_covered")
    )


def anchor(triples: Column, known: Column) -> Column:
    """What a question back is about: the first graph subject that is no placeholder, else the first known value."""
    subjects = F.filter(F.transform(triples, lambda t: F.get(F.split(t, r" \| "), F.lit(0))), lambda s: ~s.startswith("?"))
    return F.coalesce(F.get(subjects, F.lit(0)), F.get(known, F.lit(0)))


def incompleteness(known: Column, missing: Column) -> Column:
    """|missing| / (|known| + |missing|); 0 where both are empty."""
    n = F.greatest(F.size(known), F.lit(0)) + F.greatest(F.size(missing), F.lit(0))
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.size(missing), F.lit(0)) / n)


def reflected(action: Column, response: Column, reply: Column) -> Column:
    """STRUCT<action, response, changed> after a second look, whose ``reply`` has lines VERIFIED_ACTION and VERIFIED_RESPONSE: another
    action counts, with its response; the same one changes nothing. A reply without an action says ABSTAIN."""
    other = action_line(reply, "VERIFIED_ACTION")
    changed = other != action
    return F.struct(F.when(changed, other).otherwise(action).alias("action"), F.when(changed, F.coalesce(key_line(reply, "VERIFIED_RESPONSE"), reply)).otherwise(response).alias("response"), changed.alias("changed"))


def prompt(query: Column, texts: Column, history: Column | None = None, cap: int = 800) -> Column:
    """The text a generator is asked: the conversation so far (ARRAY<STRUCT<query, action, response>>) where there is one, the
    query, and each hit's first ``cap`` characters under its number."""
    parts = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(F.coalesce(t, F.lit("")), 1, cap)))
    ask = F.concat(F.lit("Query: "), F.coalesce(query, F.lit("")), F.lit("\nContext:\n"), F.array_join(parts, "\n"))
    if history is None:
        return ask
    said = F.transform(history, lambda h: F.concat(F.lit("User: "), F.coalesce(h["query"], F.lit("")), F.lit("\nReply ("), F.coalesce(h["action"], F.lit("")), F.lit("): "), F.coalesce(h["response"], F.lit(""))))
    return F.when(F.size(history) > 0, F.concat(F.lit("So far:\n"), F.array_join(said, "\n"), F.lit("\n\n"), ask)).otherwise(ask)
