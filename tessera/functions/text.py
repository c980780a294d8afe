"""Column expressions on text, which run inside the JVM, and the same notion of words for code that runs in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as the body of a character class, for Java and Python patterns alike.
WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of what is neither a letter nor a digit; nothing is given back, which is faster and makes no difference.
NOT_ALNUM = r"[^\p{L}\p{N}]++"


_WS_WORD = re.compile(rf"[^{WS}]+")


def split_words(t: str) -> list[str]:
    """White-space words of a string. Python's own split is much faster, but takes four control characters for white space too."""
    return _WS_WORD.findall(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split()


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once. An expression that a lambda mentions is otherwise computed anew for each
    element, and the optimizer inlines columns into lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key(c: Column | str) -> Column:
    """Lower case, letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(_c(c)), NOT_ALNUM, "")


def is_blank(c: Column | str) -> Column:
    """True if the text is null or has neither letter nor digit."""
    return ~F.coalesce(F.regexp_like(_c(c), F.lit(r"[\p{L}\p{N}]")), F.lit(False))


def alnum_words(c: Column | str) -> Column:
    """Maximal runs of letters and digits, lower-cased, in order; empty for null."""
    spaced = F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), NOT_ALNUM, " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def strip(c: Column | str) -> Column:
    """Without white space at both ends. The end is looked for from the first blank of a run only, so long runs cost no more."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|(?<!\s)\s+$", "")


def ws_words(c: Column | str) -> Column:
    """What remains between runs of Unicode white space; empty for null."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), rf"[{WS}]+"), lambda w: w != "")


def ws_count(c: Column | str) -> Column:
    """Number of white-space words; 0 for null. Java's own class is the same white space, and much faster than a negated list."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(r"(?U)\S+")), F.lit(0))


def squash(c: Column | str) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), rf"[{WS}]+", " "))


def split_label(c: Column | str) -> Column:
    """train, validation or test from any usual spelling; null otherwise."""
    s = F.lower(strip(c))
    return (
        F.when(s.isin("train", "training"), "train")
        .when(s.isin("val", "valid", "validation", "dev"), "validation")
        .when(s == "test", "test")
    )


def action_label(c: Column | str) -> Column:
    """ANSWER, ASK or ABSTAIN in upper case; null otherwise."""
    s = F.upper(strip(c))
    return F.when(s.isin("ANSWER", "ASK", "ABSTAIN"), s)


def lang_label(c: Column | str) -> Column:
    """The primary subtag of a language tag in lower case; "unknown" for null, "und" and anything that is no tag."""
    s = F.regexp_extract(F.lower(strip(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(s.isNull() | s.isin("", "und"), "unknown").otherwise(s)
