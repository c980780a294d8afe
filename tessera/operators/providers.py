"""Where models plug in. Each provider is a function of columns; the defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.parse import lower_words
from ..functions.text import split_words
from . import gate, graph, retrieve

DIM = 384


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:6], 16) % DIM


def hashed_vectors(texts: pd.Series) -> pd.Series:
    """Unit vectors of hashed word counts (a word's bucket is given by the first six digits of its MD5); zeros for texts without
    words."""
    out = []
    for t in texts:
        v = np.zeros(DIM)
        for w in split_words((t or "").lower()):
            v[_bucket(w)] += 1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).astype(np.float32))
    return pd.Series(out)


def embed(text: Column) -> Column:
    return F.pandas_udf(hashed_vectors, "array<float>")(text)


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's words that a text has."""
    q = F.array_distinct(lower_words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, lower_words(text))) / F.size(q)).otherwise(0.0)


def longest_words(text: Column, k: int = 3) -> Column:
    """The ``k`` longest distinct words, as stand-ins for extracted variables."""
    w = F.array_distinct(lower_words(text))
    return F.transform(F.slice(F.array_sort(F.transform(w, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), 1, k), lambda s: s["x"])


VERB_PATTERN = r"([A-Z][a-z]{2,}) ([a-z]+(?:s|ed)) (?:(in|on|at|of|to|from|by|with|for) )?(?:[a-z]+ ){0,4}([A-Z][a-z]{2,})"


def rule_type(name: Column) -> Column:
    """An entity's type by the ending of its name; a stand-in for a recogniser."""
    n, out = F.lower(name), F.lit("PERSON")
    for ends, kind in ENDINGS:
        out = F.when(F.regexp_like(n, F.lit(f"({ends})$")), kind).otherwise(out)
    return out


#: Endings of names and the types they stand for, the last that fits counts.
ENDINGS = (("ung|heit|keit|tion|ment|ity", "CARDINAL"), ("land|stadt|burg|ville|ton|feld", "GPE"), ("corp|holdings|gmbh|bank|werke|company", "ORG"), ("ish|isch|ais", "LANGUAGE"))


def verb_triples(text: Column) -> Column:
    """ARRAY<STRUCT<s, r, o, conf>>: a capitalised word, a lower-case word ending like a verb, and up to four words on the next
    capitalised word; a stand-in for a parser. A preposition after the verb becomes part of the relation, which then counts less."""
    hits = F.regexp_extract_all(text, F.lit(VERB_PATTERN), 0)
    part = lambda h, i: F.regexp_extract(h, VERB_PATTERN, i)

    def triple(h: Column) -> Column:
        prep = part(h, 3)
        return F.struct(
            F.lower(part(h, 1)).alias("s"), F.when(prep == "", part(h, 2)).otherwise(F.concat(part(h, 2), F.lit("_"), prep)).alias("r"), F.lower(part(h, 4)).alias("o"),
            F.when(prep == "", 0.8).otherwise(0.7).alias("conf"),
        )

    return F.transform(hits, triple)


def rule_planner(triples: Column, missing: Column) -> Column:
    """ABSTAIN without a graph, ASK where it holds a placeholder, ABSTAIN with other gaps, else ANSWER; as a tagged reply."""
    t, m = F.coalesce(triples, F.array().cast("array<string>")), F.coalesce(missing, F.array().cast("array<string>"))
    d = F.when(F.size(t) == 0, "ABSTAIN").when(F.exists(t, lambda x: F.contains(x, F.lit("?"))), "ASK").when(F.size(m) > 0, "ABSTAIN").otherwise("ANSWER")
    return F.concat(F.lit("<decision>\n"), d, F.lit("\n</decision>"))


def _no_model(*_: Column) -> Column:
    raise RuntimeError("no planner model is set")


@dataclass(frozen=True)
class Providers:
    """The model boundary of the pipelines; replace any member by a pandas UDF or column function of the same shape."""

    embed: Callable[[Column], Column] = embed
    rerank: Callable[[Column, Column], Column] = overlap_score
    entities: Callable[[Column], Column] = graph.capitalised
    triples: Callable[[Column], Column] = verb_triples
    variables: Callable[[Column], Column] = longest_words
    rewrite: Callable[[Column], Column] = lambda q: q
    decompose: Callable[[Column], Column] = retrieve.decompose
    is_multihop: Callable[[Column], Column] = retrieve.is_multihop
    answerability: Callable[[Column, Column], Column] = gate.rule_label
    #: (triples, missing) -> tagged reply
    plan: Callable[[Column, Column], Column] = rule_planner
    #: prompt -> text; None gives the agents' templates
    generate: Callable[[Column], Column] | None = None

    def without_planner(self) -> Providers:
        return replace(self, plan=_no_model)
