"""Months that arrive over time.

Ranks need the whole pool, so a stream can't be scored by itself: each batch of new months is merged into the stored
series, and only the cells it touches are scored again. The series are stored in buckets of cells, and a batch reads and
writes only the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import CELL, Params
from ..plans.attribution import metrics

KEYS = (*CELL, "climate", "soc", "t")
SCHEMA = "model string, lat_idx int, lon_idx int, climate string, soc string, t int, sm double"


def merge_months(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored series with new values; of a month that comes twice the later batch's value counts."""
    both = stored.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("_age", F.col("sm").asc_nulls_last()))
    return both.withColumn("_nth", nth).filter("_nth = 1").drop("_age", "_nth")


class SeriesStore:
    """Series in a shared folder, as batch=<number>/bucket=<number>: a bucket's newest finished version counts.

    A batch that is delivered again is merged with what was there before it and overwrites its own version, so it gives the
    same result; a version that wasn't finished is never read. One stream (one checkpoint) feeds a store.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*CELL), F.lit(self.buckets)).cast("int")

    def _names(self, path: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The newest batch of each bucket (of those before a number)."""
        out: dict[int, int] = {}
        for number in sorted(int(n.partition("=")[2]) for n in self._names(self.path) if n.startswith("batch=")):
            own = self._names(f"{self.path}/batch={number}")
            if "_SUCCESS" in own and (before is None or number < before):
                out.update({int(n.partition("=")[2]): number for n in own if n.startswith("bucket=")})
        return out

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        found = [f"{self.path}/batch={n}/bucket={k}" for k, n in sorted(self.versions(before).items()) if buckets is None or k in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)

    def merge(self, new: DataFrame, number: int) -> list[int]:
        """Merge a batch; returns the buckets it touched."""
        touched = [r[0] for r in new.select(self.bucket()).distinct().collect()]  # as many as there are buckets
        merged = merge_months(self.read(touched, number), new.select(*KEYS, "sm")).withColumn("bucket", self.bucket())
        merged.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        return touched


def rescore(store: SeriesStore, out: Callable[[DataFrame], None], p: Params) -> Callable[[DataFrame, int], None]:
    """A function for writeStream.foreachBatch. out takes the new metrics of touched cells."""

    def batch(new: DataFrame, number: int) -> None:
        if new.isEmpty():
            return
        buckets = store.merge(new, number)
        touched = new.select(*CELL).distinct()
        out(metrics(store.read(buckets).join(touched, list(CELL), "left_semi"), p))

    return batch
