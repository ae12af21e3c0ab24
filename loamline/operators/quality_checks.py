"""Area-weighted means and seasonal cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latitude_weights(df: DataFrame) -> DataFrame:
    """lat and w: cosines over the sum of the cosines of all latitudes, whatever is missing in the data."""
    lats = df.select("lat").distinct()
    total = lats.agg(F.sum(F.cos(F.radians("lat"))).alias("_total")).withColumn("_one", F.lit(1))
    return lats.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("lat", (F.cos(F.radians("lat")) / F.col("_total")).alias("w"))


def global_mean(df: DataFrame, lons: int, keys: tuple[str, ...] = ("model",), value: str = "sm") -> DataFrame:
    """keys, month, gm: weighted sum over latitudes, mean over longitudes. Missing cells count as 0 and keep their weight."""
    weighted = df.join(F.broadcast(latitude_weights(df)), "lat")
    return weighted.groupBy(*keys, "month").agg((F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col("w")) / lons).alias("gm"))


def climatology(series: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean of each calendar month."""
    return series.groupBy(*keys, F.month("month").alias("month")).agg(F.avg("gm").alias("clim"))


def climatology_table(series: DataFrame, models: list[str]) -> DataFrame:
    """A row a calendar month, a column a model."""
    return climatology(series).groupBy("month").pivot("model", models).agg(F.first("clim"))


def whole_mean(series: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    return series.groupBy(*keys).agg(F.avg("gm").alias("mean"))


def report(series: DataFrame) -> DataFrame:
    """Lines of the console report."""
    return whole_mean(series).select(F.format_string("  %-16s: %8.3f", F.col("model"), F.col("mean")).alias("line"))
