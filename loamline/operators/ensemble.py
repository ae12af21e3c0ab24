"""Agreement masks, differences between scenarios, and medians over models.

metrics: model, climate, soc, period, lat_idx, lon_idx, d, m, pi, ddd, drd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import METRICS, Params

GRID = ("lat_idx", "lon_idx")
#: name, minuend and subtrahend as (climate, soc, period)
DIFFERENCES = (
    ("factual_RP_histsoc-counterfact_RP_histsoc", ("obsclim", "histsoc", "RP"), ("counterclim", "histsoc", "RP")),
    ("counterfact_RP_histsoc-counterfact_EI_1901soc", ("counterclim", "histsoc", "RP"), ("counterclim", "1901soc", "EI")),
    ("factual_RP_histsoc-counterfact_EI_1901soc", ("obsclim", "histsoc", "RP"), ("counterclim", "1901soc", "EI")),
)


def class_mask(classes: DataFrame, p: Params) -> DataFrame:
    """1, or null where the climate class is the masked one; a missing class counts as not masked."""
    return classes.select(*GRID, F.when(F.col("class").eqNullSafe(F.lit(p.masked_class)), F.lit(None)).otherwise(F.lit(1.0)).cast("double").alias("open"))


def quorum(metrics: DataFrame, p: Params) -> DataFrame:
    """1 where, in any of a soc's four cubes, more models than the quorum have values, else 0. A cell's five metrics are
    there or missing together, so there is one mask."""
    counted = metrics.groupBy("soc", "climate", "period", *GRID).agg(F.count("d").alias("models"))
    return counted.groupBy("soc", *GRID).agg((F.max("models") > p.quorum).cast("double").alias("agreed"))


def masks(metrics: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """soc, cell, mask: 0, 1 or null."""
    joined = quorum(metrics, p).join(class_mask(classes, p), list(GRID), "left").withColumn("known", F.lit(True))
    seen = classes.select(*GRID).distinct().withColumn("_seen", F.lit(True))  # grows with the grid: no hint
    joined = joined.join(seen, list(GRID), "left")
    return joined.select("soc", *GRID, F.when(F.col("_seen"), F.col("agreed") * F.col("open")).otherwise(F.col("agreed")).alias("mask"))


def apply_masks(metrics: DataFrame, classes: DataFrame, p: Params, mask_all: bool = False) -> DataFrame:
    """metrics times mask: cells below the quorum become 0, masked classes null.

    As in the original, counterfactual cubes of 1901soc aren't masked; mask_all masks them too.
    """
    joined = metrics.join(masks(metrics, classes, p), ["soc", *GRID], "left")
    bare = F.lit(False) if mask_all else (F.col("climate") == "counterclim") & (F.col("soc") == "1901soc")
    return joined.select("model", "climate", "soc", "period", *GRID, *[F.when(bare, F.col(c)).otherwise(F.col(c) * F.col("mask")).alias(c) for c in METRICS])


def _of(cube: tuple[str, str, str]) -> Column:
    climate, soc, period = cube
    return (F.col("climate") == climate) & (F.col("soc") == soc) & (F.col("period") == period)


def differences(masked: DataFrame) -> DataFrame:
    """name, model, cell and the five differences; one aggregation serves all names."""
    wanted = {cube for _, a, b in DIFFERENCES for cube in (a, b)}
    made = {cube: i for i, cube in enumerate(sorted(wanted))}
    sides = [F.max(F.when(_of(cube), F.col(c))).alias(f"{c}_{i}") for cube, i in made.items() for c in METRICS]
    wide = masked.groupBy("model", *GRID).agg(*sides)
    rows = F.array(*[F.struct(F.lit(name).alias("name"), *[(F.col(f"{c}_{made[a]}") - F.col(f"{c}_{made[b]}")).alias(c) for c in METRICS]) for name, a, b in DIFFERENCES])
    return wide.select("model", *GRID, F.explode(rows).alias("_r")).select("_r.name", "model", *GRID, *[f"_r.{c}" for c in METRICS])


def median_differences(masked: DataFrame) -> DataFrame:
    """Medians over models of the differences (not differences of medians)."""
    return differences(masked).groupBy("name", *GRID).agg(*[F.median(c).alias(c) for c in METRICS])


def ensemble_medians(masked: DataFrame) -> DataFrame:
    """Medians over models of each cube."""
    return masked.groupBy("climate", "soc", "period", *GRID).agg(*[F.median(c).alias(c) for c in METRICS])


def map_name(climate: str, soc: str, period: str, metric: str) -> str:
    """Regular names of maps."""
    long = {"d": "Duration", "m": "Magnitude", "pi": "Intensity", "ddd": "DDD", "drd": "DRD"}[metric]
    return f"{ {'obsclim': 'factual', 'counterclim': 'counterfact'}[climate]}_{long}_{period}_{soc}".replace(" ", "")
