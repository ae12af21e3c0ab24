"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of all rows counts as hot. At most 1 / HOT_SHARE keys can, which bounds what is broadcast.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where a local session names none (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="loamline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: later passes don't compute it again, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    own = _own.get()
    if own is not None:
        own.append(table)
    return table


_own: ContextVar[list[DataFrame] | None] = ContextVar("tables", default=None)


@contextmanager
def tables_written() -> Iterator[list[DataFrame]]:
    """Collects the tables that are materialized inside (by this thread), to discard them when nothing needs them any more."""
    own: list[DataFrame] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that one window sees at most in a running sum.
FAN = 1024


def running(df: DataFrame, key: str, at: str, value: str, top: int) -> DataFrame:
    """df (key, at, value; each at from 0 to top - 1 at most once a key; keys aren't null) with ``before``, the sum of the
    key's values at lower places, and ``whole``, the sum of all.

    Places are summed in blocks of FAN, the blocks' sums in blocks of FAN, and so on, so no task sees more than FAN rows
    of a key at once, however many places there are.
    """
    lower = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if top <= FAN:
        return df.select("*", F.coalesce(F.sum(value).over(lower), F.lit(0)).alias("before"), F.sum(value).over(Window.partitionBy(key)).alias("whole"))
    up = f"{at}_block"
    rows = df.withColumn(up, F.floor(F.col(at) / FAN).cast("int"))
    above = running(rows.groupBy(key, up).agg(F.sum(value).alias(value)), key, up, value, -(-top // FAN))
    lower = Window.partitionBy(key, up).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", F.coalesce(F.sum(value).over(lower), F.lit(0)).alias("own"))
    return own.join(above.select(key, up, F.col("before").alias("ahead"), "whole"), [key, up]).select(*df.columns, (F.col("ahead") + F.col("own")).alias("before"), "whole")


def fresh(df: DataFrame, n: int = 1) -> list[str]:
    """Names that no column of df has, in any case."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"_{k}" not in taken:
            out.append(f"_{k}")
        k += 1
    return out


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_uneven(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with facts (one row a key), where a few keys may hold most rows.

    facts has the number of rows of each key in ``size``. Keys above HOT_SHARE of all rows are fewer than 1 / HOT_SHARE,
    so their facts can be broadcast; the other keys are joined by a shuffle, in which none of them stands out.
    Rows without a key (null) or without facts keep nulls.
    """
    least = max(1, int(total * HOT_SHARE))
    hot = facts.filter(F.col(size) > least)
    cold = facts.filter(F.col(size) <= least)
    hot_keys = F.broadcast(hot.select(key))
    few = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(hot_keys, key, "left_anti").join(cold, key, "left")
    return few.unionByName(rest.select(few.columns))
