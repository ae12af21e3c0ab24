"""The whole analysis: harmonised series to metrics, masks, differences and medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble, events, ssi
from ..params import CELL, Params


def pooled(soil: DataFrame, p: Params) -> DataFrame:
    """keys, scn, t, g, x of the harmonised table, dealt by cell once; all later steps keep that partitioning."""
    rows = ssi.with_scenario_number(soil, p).select(*CELL, "scn", "t", F.col("sm").alias("x"))
    return ssi.pool_position(rows, p).select(*CELL, "scn", "t", "g", "x").repartition(*CELL)


def metrics(soil: DataFrame, p: Params) -> DataFrame:
    """Means of the event numbers of every model, cell and slice that passes the gate."""
    return events.name_slices(events.cell_metrics(ssi.score(pooled(soil, p), p), p), p)


def maps(found: DataFrame, classes: DataFrame, p: Params, mask_all: bool = False) -> dict[str, DataFrame]:
    """masked metrics, differences by model, median differences, medians."""
    masked = ensemble.apply_masks(found, classes, p, mask_all)
    return {"metrics": masked, "differences": ensemble.differences(masked), "median_differences": ensemble.median_differences(masked), "medians": ensemble.ensemble_medians(masked)}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Keep every table of an analysis under path."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
