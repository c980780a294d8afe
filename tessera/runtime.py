"""Lineage cuts that survive the loss of executors, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one; any other
    master raises, because a folder of one machine can't be read by the others."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def _scratch(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if root not in _KEPT:
        _KEPT.add(root)
        atexit.register(_remove, spark, root)
    return root


_KEPT: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; what is left lies in the folder for temporary files
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored as a table in the shared folder; later reads need neither its lineage nor its
    executors. A stored table, unlike a checkpointed plan, also doesn't carry along the constraints the optimizer derived,
    which grow with each round of a loop. The tables go when the application ends, or by ``drop``."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows, counted while they are written; counted afterwards where the optimizer finds a part of
    the plan empty and drops the counter with it."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get.get("rows")
    return out, out.count() if rows is None else rows


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_tessera_path", None):
            _remove(t.sparkSession, path)


def spread(hot: Column | str, *cols: Column | str, into: int = 64) -> Column:
    """A salt in [0, into) for rows of a hot key, taken from other columns, so that it is the same on a recomputed task."""
    return F.pmod(F.xxhash64(hot, *cols), F.lit(into)).cast("int")


def broadcast_if_small(df: DataFrame, limit_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit_rows`` rows (counted, at most one row more is read per
    partition); otherwise ``df`` as it is, which Catalyst then joins by shuffle."""
    return F.broadcast(df) if df.limit(limit_rows + 1).count() <= limit_rows else df


def lookup(left: DataFrame, key: str, right: DataFrame, hot_rows: int = 200_000, rows: int | None = None) -> DataFrame:
    """Left join on ``key``, of which ``right`` has at most one row per value, without gathering a hot key in one task.

    The keys of more than ``hot_rows`` rows of ``left``, and of more than a 4,096th of all rows, take their row of ``right`` by
    broadcast; there are fewer than 4,096 of them, found by a count that is combined before its shuffle. Only the others are
    shuffled, of which none fills more than that share of a task's work. Null keys match nothing. ``left`` should be cheap to read again. ``rows`` is a known bound of its rows;
    without it they are counted first, as no key of a small table can be hot.
    """
    rows = left.count() if rows is None else rows
    hot_rows = max(hot_rows, rows // 4096)
    if rows <= hot_rows:
        return left.join(right, key, "left")
    hot = left.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > hot_rows).select(key)
    values = [r[0] for r in hot.collect()]
    if not values:
        return left.join(right, key, "left")
    few = F.broadcast(left.sparkSession.createDataFrame([(v,) for v in values], hot.schema))
    known = F.broadcast(few.join(right, key, "left"))
    return left.join(known, key).unionByName(left.join(few, key, "left_anti").join(right, key, "left"))


def widened(df: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """A scanned table of at most ``most_bytes`` over as many partitions as there are cores, as a file of one row group is one
    task, however many cores wait. Larger tables stay as they were read, whatever the size of the cluster."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > most_bytes:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def numbered_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, stored, with ``name``, each row's place in ``order`` from 0 without gaps. Ranges of the order are ranked apart, and
    only their sizes meet in one task. ``df`` is stored first unless it is a stored table, as ranges are found by reading it."""
    df = df if hasattr(df, "_tessera_path") else cut(df)
    ranked = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before") - 1
    return ranked.join(F.broadcast(before), "_p").withColumn(name, place).drop("_p", "_before")
