"""Land cover and soil geometry from their files, as the tables that the land-cover recipe takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import netcdf

# Names of variables in the files.
FRACTIONS = {"f_forest": "fracforest", "f_grass": "fracgrassland", "f_paddy": "fracirrPaddy", "f_nonpaddy": "fracirrNonPaddy"}
ROOT_DEPTH, STORE_DEPTHS = "maxRootDepth", ("firstStorDepth", "secondStorDepth")


def _grid(spark: SparkSession, path: str, variable: str, column: str, *keys: str) -> DataFrame:
    rows = spark.read.format("netcdf").option("variable", variable).load(path)
    return rows.select("lat_idx", "lon_idx", *[F.col("t").alias(k) for k in keys], F.get("layers", F.lit(0)).alias(column))


def read_land(spark: SparkSession, fractions: str, roots: dict[str, str], stores: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(cover, soil): cover has lat_idx, lon_idx, year_idx (the place in the file's time) and four fractions, soil has lat_idx,
    lon_idx, four root depths and two storage depths.

    fractions: the file with the four fractions. roots: files of root depths, by forest, grass, paddy and nonpaddy.
    stores: files of the two storage depths.
    """
    netcdf.register(spark)
    cover = None
    for column, variable in FRACTIONS.items():
        one = _grid(spark, fractions, variable, column, "year_idx")
        cover = one if cover is None else cover.join(one, ["lat_idx", "lon_idx", "year_idx"])
    soil = None
    parts = [(roots[k], ROOT_DEPTH, f"root_{k}") for k in ("forest", "grass", "paddy", "nonpaddy")] + [(p, v, f"store{i + 1}") for i, (p, v) in enumerate(zip(stores, STORE_DEPTHS, strict=True))]
    for path, variable, column in parts:
        one = _grid(spark, path, variable, column)
        soil = one if soil is None else soil.join(one, ["lat_idx", "lon_idx"])
    return cover, soil
