"""Readings of the test tables that several problems share: the delivery that counts, canonical labels, source names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, id_col: str, version_col: str, **cols: Column) -> DataFrame:
    """One row per non-null id with ``cols`` of its latest delivery.

    A null version counts as the earliest; deliveries of the same version are ordered by ``cols`` themselves, so that the
    result doesn't depend on the order of rows. The maximum is combined before the shuffle, so an id that holds a third of
    all rows costs one row per task.
    """
    picked = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.struct(F.col(version_col).alias("_v"), *(c.alias(n) for n, c in cols.items())).alias("_r")
    )
    return picked.groupBy("id").agg(F.max("_r").alias("_r")).select("id", *(F.col(f"_r.{n}").alias(n) for n in cols))


def samples(spark: SparkSession, sf_dir: str, **cols: Column) -> DataFrame:
    """One row per id of unified_samples."""
    return latest(table(spark, sf_dir, "unified_samples"), "id", "ingested_at", **cols)


def context_texts() -> Column:
    """The context document texts, in order; an empty array where there are none."""
    docs = F.col("context.documents")
    return F.when(docs.isNull(), F.array().cast("array<string>")).otherwise(F.transform(docs, lambda d: d["text"]))


def dialogue_key(c: str = "metadata.dialogue_id") -> Column:
    """The key of the dialogue id; null where it is null or empty."""
    k = X.key(c)
    return F.when(k != "", k)


def source_names(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, str]]:
    """key -> (source, domain) of source_catalog, a fixed table of four rows."""
    rows = table(spark, sf_dir, "source_catalog").select("source", "domain").limit(1000).collect()
    return {"".join(ch for ch in r.source.lower() if ch.isalnum()): (r.source, r.domain) for r in rows if r.source}


def source_label(c: Column | str, names: dict[str, tuple[str, str]], part: int = 0) -> Column:
    """The catalog's source (part 0) or domain (part 1) whose source has the same key; null otherwise."""
    k, out = X.key(c), F.lit(None).cast("string")
    for name, entry in sorted(names.items()):
        out = F.when(k == name, entry[part]).otherwise(out)
    return out
