"""From raw files to harmonised series, as files at the registered places and as one table; and the command for it."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.months import month_of
from ..operators.recipes import NOTES, recipe_for, tag
from ..sources import netcdf
from ..sources.catalog import Registry, Settings
from ..sources.grids import write_soil

MODELS = tuple(NOTES)
#: Name of the variable in harmonised files.
HARMONISED = "soilmoist_1m"


def harmonized(spark: SparkSession, model: str, scenario: str, registry: Registry, depth: float = 1.0, bounds: DataFrame | None = None, land: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Model and scenario as rows of cell, month and sm; lazily. Paths are looked up before the recipe.

    bounds: of the layers; by default those that the file itself tells. land: cover and soil, for the model that needs them.
    """
    path, variable = registry.raw(model, scenario), registry.variable(model)
    if bounds is None and model == "lpjml5-7-10-fire":
        told = netcdf.layer_bounds(path)
        bounds = None if told is None else spark.createDataFrame(told, "layer int, top_m double, bot_m double")
    cover, soil = land or (None, None)
    recipe = recipe_for(model, bounds=bounds, cover=cover, soil=soil, depth=depth)
    netcdf.register(spark)
    raw = spark.read.format("netcdf").option("variable", variable).load(path)
    raw = raw.withColumn("month", month_of(F.col("year"), F.col("month"))).withColumn(variable, F.get("layers", F.lit(0)))
    return tag(raw.transform(recipe), model, scenario, NOTES.get(model), depth).select("model", "climate", "soc", "lat_idx", "lon_idx", "lat", "lon", "month", "t", "sm")


def harmonize_one(spark: SparkSession, model: str, scenario: str, registry: Registry, settings: Settings | None = None, land: tuple[DataFrame, DataFrame] | None = None) -> str:
    """Write the harmonised file of a model and scenario at its registered place; returns the place."""
    raw, out = registry.raw(model, scenario), registry.processed(model, scenario)
    rows = harmonized(spark, model, scenario, registry, (settings or Settings()).depth_target_m, land=land)
    file = netcdf.open_file(raw)
    lats, lons = (file.read(n).tolist() for n in ("lat", "lon"))
    months = netcdf.months_of(file, "time")
    file.close()
    return netcdf.write_series(rows, out, lats, lons, months, HARMONISED, rows.schema["sm"].metadata)


def harmonize_all(spark: SparkSession, models: list[str], registry: Registry, settings: Settings | None = None, table: str | None = None) -> list[str]:
    """The files of all scenarios of the models. table: a folder for all of them as one table beside."""
    written = [harmonize_one(spark, m, s, registry, settings) for m in models for s in registry.scenarios()]
    if table:
        write_soil(read_harmonized(spark, models, registry), table)
    return written


def read_harmonized(spark: SparkSession, models: list[str], registry: Registry) -> DataFrame:
    """The harmonised files of the models as one table."""
    netcdf.register(spark)
    whole = None
    for m in models:
        for s in registry.scenarios():
            climate, soc = s.split("_")
            rows = spark.read.format("netcdf").option("variable", HARMONISED).load(registry.processed(m, s, make_parent=False))
            rows = rows.select(F.lit(m).alias("model"), F.lit(climate).alias("climate"), F.lit(soc).alias("soc"), "lat_idx", "lon_idx", "lat", "lon", month_of(F.col("year"), F.col("month")).alias("month"), "t", F.get("layers", F.lit(0)).alias("sm"))
            whole = rows if whole is None else whole.unionByName(rows)
    return whole


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = argparse.ArgumentParser(description="Build the harmonised 0-1 m series.")
    args.add_argument("--registry", default="configs/data_registry.yml")
    args.add_argument("--settings", default="configs/settings.yml", help="used if there is such a file")
    args.add_argument("--models", nargs="+", default=list(MODELS))
    args.add_argument("--table", help="folder for all series as one Parquet table")
    given = args.parse_args(argv)
    if spark is None:
        from ..session import build_session

        spark = build_session()
    settings = Settings.load(given.settings) if os.path.exists(given.settings) else Settings()
    for path in harmonize_all(spark, given.models, Registry.load(given.registry), settings, given.table):
        print(f"wrote {path}")


if __name__ == "__main__":
    main()
