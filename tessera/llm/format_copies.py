"""Problem 4: records that differ only in form.

Method: byte-identical raw records are collapsed first, with their counts; only the distinct survivors are brought into
canonical form; then records are grouped again on the full canonical text, summing the counts.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, key, let
from ..runtime import cut, lookup


def _key(s: str) -> str:
    return "".join(c for c in s.lower() if c.isalnum())


def _canonical(x: object) -> object:
    """JSON values with strings as keys, objects without an order of fields, and equal numbers alike."""
    if isinstance(x, str):
        return "s" + _key(x)
    if isinstance(x, dict):
        return {"f" + k: _canonical(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_canonical(v) for v in x]
    if isinstance(x, float) and x == x and abs(x) != float("inf") and x == int(x):
        return int(x)
    return x


def canonical_payload(payload: str | None) -> str | None:
    """The canonical form of a JSON object; null for anything else: null, blank, broken, or JSON that is no object.

    Of a field given twice the last counts. true isn't 1, 1.0 is 1.
    """
    try:
        x = json.loads(payload) if payload else None
        return json.dumps(_canonical(x), sort_keys=True, separators=(",", ":")) if isinstance(x, dict) else None
    except (ValueError, RecursionError):
        return None


def _forms(payloads: pd.Series) -> pd.Series:
    return payloads.map(canonical_payload)


def text_form(raw: Column) -> Column:
    """Keys of raw[0] and, in any order, of the rest; null where the key of raw[0] is empty. Null counts as empty."""
    put = lambda keys: F.concat_ws("\u0001", F.concat(F.get(keys, F.lit(0)), F.lit("\u0002")), F.array_sort(F.slice(keys, 2, 2_000_000_000)))
    return F.when(~is_blank(F.get(raw, F.lit(0))), let(F.transform(raw, lambda t: F.coalesce(key(t), F.lit(""))), put))


def _collapsed(tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Members (tbl, id, rd), stored, and distinct raw records (tbl, rd, rep, n, form), stored; rd is the SHA-256 of the raw record.

    Which delivery of an id counts is decided by digests, and copies are counted by them; a raw text crosses the network
    once, when equal ones are collapsed, and reaches canonical form only if a member has it.
    """
    rows = reduce(DataFrame.unionByName, (t if "v" in t.columns else t.withColumn("v", F.lit(None).cast("timestamp")) for t in tables))
    rows = rows.filter(F.col("id").isNotNull())
    #: Lengths before the strings: two arrays can't be written alike. A null string has length -1.
    written = F.concat_ws("\u0001", F.transform("raw", lambda t: F.concat(F.coalesce(F.octet_length(t), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(t, F.lit("")))))
    rows = rows.select("tbl", "id", "v", "raw", F.unhex(F.sha2(written, 256)).alias("rd"))
    members = cut(rows.groupBy("tbl", "id").agg(F.max(F.struct("v", "rd")).alias("r")).select("tbl", "id", F.col("r.rd").alias("rd")))
    counts = members.groupBy("tbl", "rd").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    survivors = rows.groupBy("tbl", "rd").agg(F.first("raw").alias("raw")).join(counts, ["tbl", "rd"])
    texts = survivors.filter((F.col("tbl") != "raw_records") & ~is_blank(F.get("raw", F.lit(0)))).withColumn("form", text_form(F.col("raw")))
    payloads = survivors.filter("tbl = 'raw_records'").withColumn("form", F.pandas_udf(_forms, "string")(F.get("raw", F.lit(0))))
    formed = cut(texts.unionByName(payloads).select("tbl", "rd", "rep", "n", "form"))
    return members, formed.filter(F.col("form").isNotNull())


def _digest(form: str = "form") -> Column:
    return F.sha2(form, 256)


def _classes(formed: DataFrame) -> DataFrame:
    """Grouped on the full canonical text."""
    return formed.groupBy("tbl", "form").agg(F.min("rep").alias("first_id"), F.sum("n").alias("copies"), F.count("*").alias("variants"))


def class_counts(tables: list[DataFrame]) -> DataFrame:
    """(tbl, first_id, copies BIGINT, variants BIGINT) of every distinct record in ``tables`` (tbl, id, raw ARRAY<STRING> and
    perhaps v TIMESTAMP).

    Rows of one id in a table are deliveries of one record; the one with the greatest v counts, of equals the one with the
    greatest digest. Records of tbl ``raw_records`` are JSON payloads, all others texts (see ``text_form``). Records without
    canonical form (blank, broken, null) are no class; rows without id are left out. All groupings combine before they
    shuffle, so a record that makes up a third of all rows costs a row per task.
    """
    return _classes(_collapsed(tables)[1]).drop("form")


def class_members(tables: list[DataFrame], hot_rows: int = 200_000) -> DataFrame:
    """(tbl, first_id, other_id): each record that isn't the first of its class, beside the first.

    Classes are made as in ``class_counts``. Members then find their class by digests, of their raw record and of its form, in
    joins of narrow rows; a digest with a great many members is looked up by broadcast.
    """
    members, formed = _collapsed(tables)
    classes = _classes(formed).filter("copies > 1").select(F.concat("tbl", _digest()).alias("_f"), "first_id")
    forms = formed.select(F.concat("tbl", _digest()).alias("_f"), F.concat("tbl", F.hex("rd")).alias("_k"))
    firsts = lookup(forms, "_f", classes, hot_rows).filter(F.col("first_id").isNotNull()).select("_k", "first_id")
    named = lookup(members.select("tbl", "id", F.concat("tbl", F.hex("rd")).alias("_k")), "_k", firsts, hot_rows)
    return named.filter(F.col("first_id").isNotNull() & (F.col("first_id") != F.col("id"))).select("tbl", "first_id", F.col("id").alias("other_id"))
