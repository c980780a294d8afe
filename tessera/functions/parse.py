"""Fingerprints, names, sentences and the parsers of model replies, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, squash, strip, ws_words

#: A sentence: what ends with a run of . ! ? or with the text. Fixed value.
SENTENCE = r"[^.!?]+[.!?]*"


def fingerprint(c: Column | str) -> Column:
    """MD5 of the UTF-8 text in hex."""
    return F.md5(_c(c))


def numbered_id(prefix: Column | str, n: Column, width: int = 6) -> Column:
    """``prefix_000123``; longer numbers aren't cut."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string(f"%s_%0{width}d", p, n)


def plain_name(c: Column | str) -> Column:
    """A name in lower case, white space collapsed."""
    return F.lower(squash(c))


def bare_name(c: Column | str) -> Column:
    """As ``plain_name``, and without anything but a-z, digits, blanks and hyphens."""
    return squash(F.regexp_replace(plain_name(c), r"[^a-z0-9 \-]", ""))


def is_numeric(c: Column | str) -> Column:
    return F.regexp_like(_c(c), F.lit(r"^[\d\s,.\-/]+$"))


def sentences(c: Column | str) -> Column:
    """Stripped, non-blank sentences in order; empty for null."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(SENTENCE), 0), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def lower_words(c: Column | str) -> Column:
    """White-space words in lower case, punctuation kept."""
    return ws_words(F.lower(_c(c)))


def tag(c: Column | str, name: str, default: str | None = None) -> Column:
    """What the first ``<name>`` holds up to its first ``</name>``, stripped; ``default`` if there is none."""
    got = strip(F.regexp_extract(_c(c), rf"(?s)<{name}>(.*?)</{name}>", 1))
    there = F.regexp_like(F.coalesce(_c(c), F.lit("")), F.lit(rf"(?s)<{name}>.*?</{name}>"))
    return F.when(there, got).otherwise(F.lit(default))


def decision(c: Column | str, default: str = "UNKNOWN") -> Column:
    """The action inside decision tags; ``default`` for anything else."""
    d = F.upper(tag(c, "decision", ""))
    return F.when(d.isin("ANSWER", "ASK", "ABSTAIN"), d).otherwise(default)


def key_line(c: Column | str, name: str, default: str | None = None) -> Column:
    """The text after ``NAME:`` on the last line that begins so."""
    lines = F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\n"), lambda s: strip(s))
    hits = F.filter(lines, lambda s: s.startswith(f"{name}:"))
    return F.when(F.size(hits) > 0, strip(F.substring(F.element_at(hits, -1), len(name) + 2, 1_000_000_000))).otherwise(F.lit(default))


def reply_action(c: Column | str) -> Column:
    """The action of an ``ACTION:`` line; ABSTAIN if none of the three is named there."""
    a = F.upper(key_line(c, "ACTION", ""))
    out = F.lit("ABSTAIN")
    for known in ("ABSTAIN", "ASK", "ANSWER"):
        out = F.when(a.contains(known), known).otherwise(out)
    return out


def action_line(c: Column | str, name: str) -> Column:
    """The last of the three actions that stands alone after ``NAME:``; ABSTAIN if none does."""
    lines = F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\n"), lambda s: strip(s))
    said = F.transform(F.filter(lines, lambda s: s.startswith(f"{name}:")), lambda s: strip(F.substring(s, len(name) + 2, 1_000_000_000)))
    return F.coalesce(F.try_element_at(F.filter(said, lambda s: s.isin("ANSWER", "ASK", "ABSTAIN")), F.lit(-1)), F.lit("ABSTAIN"))


def answerability(c: Column | str) -> Column:
    """ANSWERABLE, NEEDS_CLARIFICATION or NOT_ANSWERABLE: the last line that names a label counts; the last is the default."""
    lines = F.split(F.coalesce(_c(c), F.lit("")), "\n")
    label = lambda s: (
        F.when(s.contains("ANSWERABLE") & ~s.contains("NOT") & ~s.contains("NEEDS"), "ANSWERABLE")
        .when(s.contains("NEEDS_CLARIFICATION"), "NEEDS_CLARIFICATION")
        .when(s.contains("NOT_ANSWERABLE"), "NOT_ANSWERABLE")
    )
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines, label), lambda s: s.isNotNull()), F.lit(-1)), F.lit("NOT_ANSWERABLE"))


def numbered_list(c: Column | str) -> Column:
    """The items of a numbered list, without numbers."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), "\n"), lambda s: strip(s)), lambda s: F.regexp_like(s, F.lit(r"^\d[^.]*\.")))
    return F.filter(F.transform(lines, lambda s: strip(F.regexp_replace(s, r"^\d[^.]*\.", ""))), lambda s: s != "")


def fenced_json(c: Column | str, schema: str) -> Column:
    """JSON out of a reply that may stand in a code fence; null if it doesn't parse."""
    return F.from_json(strip(F.regexp_replace(_c(c), r"(?m)^\s*```[a-zA-Z]*\s*$", "")), schema, {"mode": "PERMISSIVE"})


def variables_reply(c: Column | str, action: Column, known_cap: int = 5, missing_cap: int = 8) -> Column:
    """struct(known, missing) of an extraction reply: non-blank strings, capped; an ANSWER misses nothing."""
    j = fenced_json(c, "struct<known_variables:array<string>,missing_variables:array<string>>")
    clean = lambda a, n: F.slice(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: strip(s)), lambda s: s != ""), 1, n)
    return F.struct(
        clean(j["known_variables"], known_cap).alias("known"),
        F.when(action == "ANSWER", F.array().cast("array<string>")).otherwise(clean(j["missing_variables"], missing_cap)).alias("missing"),
    )


def triple_text(s: Column, r: Column, o: Column) -> Column:
    return F.concat_ws(" | ", s, F.replace(r, F.lit("_"), F.lit(" ")), o)


def triple_parts(t: Column) -> Column:
    """struct(s, r, o) of ``s | r | o``; null if it hasn't three parts."""
    p = F.split(t, r" \| ")
    return F.when(F.size(p) == 3, F.struct(F.get(p, F.lit(0)).alias("s"), F.get(p, F.lit(1)).alias("r"), F.get(p, F.lit(2)).alias("o")))
