"""Drought events by run theory: gaps pooled, minor events removed, five numbers for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import CELL, METRICS, Params

SERIES = (*CELL, "slice")


def run_number(df: DataFrame, mask: Column, keys: tuple[str, ...], out: str, order: str = "t") -> DataFrame:
    """Number of the run of equal mask values that a row is in; a missing mask counts as false."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn(f"_{out}", F.coalesce(mask, F.lit(False)))
    changed = F.when(F.col(f"_{out}").eqNullSafe(F.lag(f"_{out}").over(w)), 0).otherwise(1)
    return df.withColumn(f"{out}_change", changed).withColumn(out, F.sum(f"{out}_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(f"{out}_change")


def gated(df: DataFrame, p: Params, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Series whose minimum is below the severity."""
    return df.withColumn("_least", F.min("z").over(Window.partitionBy(*keys))).filter(F.col("_least") < p.severity).drop("_least")


def pooled_gaps(df: DataFrame, p: Params, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """z1: short runs between the gap bounds become slightly negative, which joins their neighbours."""
    rows = run_number(df, F.col("z").between(p.gap_low, p.gap_high), keys, "gap")
    long = F.count(F.lit(1)).over(Window.partitionBy(*keys, "gap"))
    return rows.withColumn("z1", F.when(F.col("_gap") & (long < p.gap_months), F.lit(p.joined_value)).otherwise(F.col("z"))).drop("gap", "_gap")


def runs(df: DataFrame, p: Params, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Rows of dry runs that count as events: keys, t, z1, run."""
    rows = run_number(pooled_gaps(df, p, keys), F.col("z1") < 0, keys, "run").filter("_run").drop("_run")
    return rows.withColumn("_low", F.min("z1").over(Window.partitionBy(*keys, "run"))).filter(F.col("_low") <= p.severity).drop("_low").select(*keys, "t", "z1", "run")


def events(df: DataFrame, p: Params, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Per event: d (months), m (sum of |z|), pi (m / d), ddd (months to the first minimum), drd (months after it)."""
    found = runs(df, p, keys).groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("d"), F.sum(F.abs("z1")).alias("m"), F.min("t").alias("t0"), F.min(F.struct("z1", "t")).alias("_low"))
    return found.select(*keys, "run", "t0", "d", "m", (F.col("m") / F.col("d")).alias("pi"), (F.col("_low.t") - F.col("t0") + 1).cast("bigint").alias("ddd"), (F.col("d") - (F.col("_low.t") - F.col("t0") + 1)).cast("bigint").alias("drd"))


def cell_metrics(df: DataFrame, p: Params, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Means over the events of each series that passes the gate."""
    return events(gated(df, p, keys), p, keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in METRICS])


def name_slices(df: DataFrame, p: Params) -> DataFrame:
    """climate, soc and period of each slice number."""
    table = p.slices()

    def pick(field: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(s, field)) for s in table]), F.col("slice")).alias(field)

    rest = [c for c in df.columns if c not in (*CELL, "slice")]
    return df.select("model", pick("climate"), pick("soc"), pick("period"), "lat_idx", "lon_idx", *rest)
