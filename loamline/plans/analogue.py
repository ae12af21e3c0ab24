"""Tables of a retail schema read as soil-moisture series, to run every operator on data at hand.

A model is an order priority, a cell one of ten groups of suppliers, a month's value the sum of quantities shipped in
it; climate is the line status, soc the parity of the order's key. Six years stand for the whole series, two for a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.months import month_number, month_start
from ..operators.ssi import with_scenario_number
from ..params import Params
from ..session import with_package

PARAMS = Params(months=72, slice_months=24)
FIRST_YEAR = 1995
#: top and bottom of seven layers; the fifth has no thickness
BOUNDS = ((0, 0.0, 0.1), (1, 0.1, 0.35), (2, 0.35, 0.8), (3, 0.8, 1.5), (4, 1.5, 1.5), (5, 1.5, 2.0), (6, 2.0, 3.0))
LATS, LONS = 2, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, cell, climate, soc, layer, t, quantity of every line of the six years."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus", "l_shipdate")
    lines = month_number(month_start(lines, "l_shipdate"), FIRST_YEAR).filter(F.col("t").between(0, PARAMS.months - 1))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model"))
    return lines.join(orders, "l_orderkey").select(
        "model",
        (F.col("l_suppkey") % 10).cast("int").alias("cell"),
        F.when(F.col("l_linestatus") == "F", "obsclim").otherwise("counterclim").alias("climate"),
        F.when(F.col("l_orderkey") % 2 == 0, "histsoc").otherwise("1901soc").alias("soc"),
        (F.col("l_linenumber") - 1).alias("layer"),
        "t",
        F.col("l_quantity").alias("quantity"),
    )


def place(df: DataFrame) -> DataFrame:
    """lat_idx, lon_idx, lat, lon instead of cell."""
    lat, lon = F.floor(F.col("cell") / LONS).cast("int"), (F.col("cell") % LONS).cast("int")
    return df.withColumns({"lat_idx": lat, "lon_idx": lon, "lat": -30.0 + 75.0 * lat, "lon": 36.0 * lon}).drop("cell")


def soil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense cube: model, climate, soc, cell, t, month, sm; 0 where nothing was shipped."""
    sums = shipped(spark, sf_dir).groupBy("model", "cell", "climate", "soc", "t").agg(F.sum("quantity").alias("sm"))
    scenarios = F.array(*[F.struct(F.lit(c).alias("climate"), F.lit(s).alias("soc")) for c, s in PARAMS.pool])
    grid = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model")).distinct()
    grid = grid.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("_s", F.explode(scenarios)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(PARAMS.months - 1))))
    grid = grid.select("model", "cell", "_s.climate", "_s.soc", "t")
    out = grid.join(sums, ["model", "cell", "climate", "soc", "t"], "left").withColumn("sm", F.coalesce("sm", F.lit(0.0)))
    return place(out).withColumn("month", F.make_date(F.lit(FIRST_YEAR) + F.floor(F.col("t") / 12).cast("int"), F.col("t") % 12 + 1, F.lit(1)))


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, cell, climate, soc, t, layers: seven layers of every scenario, null where nothing was shipped."""
    each = [F.sum(F.when(F.col("layer") == k, F.col("quantity"))).alias(f"l{k}") for k, _, _ in BOUNDS]
    keys = ("model", "cell", "climate", "soc", "t")
    return place(shipped(spark, sf_dir).groupBy(*keys).agg(*each).select(*keys, F.array(*[f"l{k}" for k, _, _ in BOUNDS]).alias("layers")))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_scenario_number(soil(spark, sf_dir), PARAMS)
    return rows.select("model", "lat_idx", "lon_idx", "scn", "t", (F.col("scn") * PARAMS.months + F.col("t")).alias("g"), F.col("sm").alias("x")).repartition("model", "lat_idx", "lon_idx")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate classes of nine of the ten cells: one masked, one missing."""
    rows = table(spark, sf_dir, "nation").filter("n_nationkey < 10 AND n_nationkey <> 6").select(F.col("n_nationkey").alias("cell"), F.when(F.col("n_nationkey") == 3, 30).when(F.col("n_nationkey") == 5, None).otherwise(F.col("n_nationkey")).cast("int").alias("class"))
    return place(rows).select("lat_idx", "lon_idx", "class")


def bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, a, b in BOUNDS], "layer int, top_m double, bot_m double")


def land(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Land cover of each cell and year, and soil geometry of each cell."""
    cell = spark.range(10).select(F.col("id").cast("int").alias("cell"))
    cover = cell.withColumn("year_idx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    shares = {"f_forest": 0, "f_grass": 1, "f_paddy": 2, "f_nonpaddy": 3}
    cover = place(cover.withColumns({c: ((F.col("cell") + F.col("year_idx") + k) % 4) / 8.0 for c, k in shares.items()})).drop("lat", "lon")
    roots = {"root_forest": 1.0, "root_grass": 0.5, "root_paddy": 0.25, "root_nonpaddy": 0.75}
    ground = cell.withColumns({c: v + F.col("cell") % 3 / 4.0 for c, v in roots.items()} | {"store1": 0.25 + F.col("cell") % 2 / 2.0, "store2": 1.0 + F.col("cell") % 4 / 4.0})
    return cover, place(ground).drop("lat", "lon")
