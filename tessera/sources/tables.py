"""Readers and writers: JSON documents, JSON lines, Parquet stages; resumable appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import merge


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON object or array."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One JSON object a line; a tolerant scan skips lines that don't parse, the other fails on them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_lines(df: DataFrame, path: str, columns: list[str] | None = None, without: tuple[str, ...] = ()) -> None:
    (df.select(*columns) if columns else df.drop(*without)).write.mode("overwrite").json(path)


def write_by(df: DataFrame, path: str, column: str, fmt: str = "parquet") -> None:
    """A folder per value of ``column``; a task writes each of its values to one file."""
    df.write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def write_array(df: DataFrame, path: str) -> None:
    """One JSON array per file, for exports: a line an entry, with a comma before all but the part's first, so that a part is never
    held in memory."""

    def run(batches):
        import pandas as pd

        first = True
        for pdf in batches:
            if len(pdf):
                lines = "," + pdf["j"]
                if first:
                    lines.iloc[0] = "[" + pdf["j"].iloc[0]
                yield pd.DataFrame({"value": lines})
                first = False
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    df.select(F.to_json(F.struct("*")).alias("j")).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table, built and stored first if it isn't there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def vectors(spark: SparkSession, texts: DataFrame, key: str, text: str, embed, path: str) -> DataFrame:
    """(key, embedding) of ``texts``, from ``path``; made and stored there first if it isn't there."""
    return read_or_build(spark, path, lambda: texts.select(key, embed(F.col(text)).alias("embedding")))


def compact(spark: SparkSession, path: str, into: str, files: int = 8) -> DataFrame:
    """What a stream or a resumed fill has appended to ``path``, as one table of few files."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


def first_of(spark: SparkSession, *paths: str) -> DataFrame:
    """The first stored table that is there."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def save_graph(tables: dict[str, DataFrame], path: str, phase: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{phase}/{name}")


def load_graph(spark: SparkSession, path: str, *phases: str) -> dict[str, DataFrame]:
    """The tables (nodes, edges, bridges) of the first phase that was saved."""
    for phase in phases:
        if exists(spark, f"{path}/{phase}/edges"):
            return {n: spark.read.parquet(f"{path}/{phase}/{n}") for n in ("nodes", "edges", "bridges") if exists(spark, f"{path}/{phase}/{n}")}
    raise FileNotFoundError(f"none of {phases} in {path}")


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't done yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def append_new(spark: SparkSession, work: DataFrame, key: str, path: str, fill: Callable[[DataFrame], DataFrame]) -> None:
    """Fills what isn't in ``path`` yet and appends it; a second run after a failure does only the rest."""
    todo = resume(work, spark.read.parquet(path), key) if exists(spark, path) else work
    fill(todo).write.mode("append").parquet(path)


def merged(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` from ``patch`` (one row a key) where it has the key and isn't null."""
    p = patch.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns))
    return base.join(p, key, "left").select(*(F.coalesce(f"_p_{c}", c).alias(c) if c in columns else c for c in base.columns))


def save_samples(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """All sources, merged, as JSON lines in a folder per source; returns the counts by action."""
    both = merge(*parts.values())
    write_by(both.withColumn("source", F.col("metadata.source")), path, "source", "json")
    return both.groupBy("action").count()
