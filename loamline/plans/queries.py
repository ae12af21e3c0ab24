"""A registered query for each operator, over the tables that analogue.py reads as soil-moisture series."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_inv
from ..operators import ensemble, events, months, quality_checks, recipes, ssi
from ..params import CELL, METRICS
from ..sources.catalog import Registry
from ..sources.grids import ascii_rows, map_lines
from . import analogue as A
from .attribution import metrics

P = A.PARAMS
SERIES = (*CELL, "climate", "soc")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _dated(df: DataFrame) -> DataFrame:
    """Months as text, which every engine writes the same way."""
    return df.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(A.soil(spark, sf_dir), P)


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.apply_masks(_metrics(spark, sf_dir), A.classes(spark, sf_dir), P)


def _one_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.soil(spark, sf_dir).filter("climate = 'obsclim' AND soc = 'histsoc'")
    return rows.withColumn("sm", F.nullif(F.col("sm"), F.lit(0.0)))


@query
def month_start(spark, sf_dir):
    return _dated(months.month_start(A.table(spark, sf_dir, "lineitem"), "l_shipdate").select("l_orderkey", "l_linenumber", "month"))


@query
def period_slice(spark, sf_dir):
    rows = months.between_months(A.soil(spark, sf_dir), "1996-01-01", "1997-12-01")
    return _dated(rows.select("model", "climate", "soc", "lat_idx", "lon_idx", "month", "sm"))


@query
def first_and_last_months(spark, sf_dir):
    rows = A.soil(spark, sf_dir).select("model", "climate", "soc", "lat_idx", "lon_idx", "t", "sm")
    first = months.first_months(rows, P.slice_months).withColumn("period", F.lit("EI"))
    return first.unionByName(months.last_months(rows, P.slice_months, P.months).withColumn("period", F.lit("RP")))


@query
def single_layer(spark, sf_dir):
    raw = A.soil(spark, sf_dir).withColumnRenamed("sm", "rootmoist")
    parts = [recipes.tag(raw.filter((F.col("climate") == c) & (F.col("soc") == s)).transform(recipes.recipe_for("hydropy")), "hydropy", f"{c}_{s}") for c, s in P.pool]
    return _dated(reduce(DataFrame.unionByName, parts).select("model", "climate", "soc", "lat_idx", "lon_idx", "month", "rootmoist", "sm"))


@query
def first_layers(spark, sf_dir):
    raw = A.layered(spark, sf_dir)
    rows = raw.transform(recipes.recipe_for("jules-w2")).withColumnRenamed("sm", "skipped")
    return rows.transform(recipes.recipe_for("miroc-integ-land", skip_missing=False)).select(*SERIES, "t", "skipped", F.col("sm").alias("strict"))


@query
def depth_overlap(spark, sf_dir):
    return A.layered(spark, sf_dir).transform(recipes.overlap(A.bounds(spark))).select(*SERIES, "t", F.round("sm", 9).alias("sm"))


@query
def model_recipes(spark, sf_dir):
    """Every recipe by the name of its model."""
    raw = A.layered(spark, sf_dir).withColumns({"soilmoist": F.get("layers", F.lit(0)), "rootmoist": F.get("layers", F.lit(1))})
    names = [*recipes.NOTES, "classic", "ssib4-triffid-fire"]
    parts = [raw.transform(recipes.recipe_for(n, bounds=A.bounds(spark))).select(F.col("model").alias("series"), F.lit(n).alias("recipe"), "lat_idx", "lon_idx", "climate", "soc", "t", F.round("sm", 9).alias("sm")) for n in names]
    return reduce(DataFrame.unionByName, parts)


@query
def layer_shares(spark, sf_dir):
    return recipes.layer_shares(A.bounds(A.with_package(spark))).select("layer", F.round("share", 9).alias("share"))


@query
def thinned_third_layer(spark, sf_dir):
    return A.layered(spark, sf_dir).transform(recipes.thinned_third()).select(*SERIES, "t", F.round("sm", 9).alias("sm"))


@query
def land_cover_column(spark, sf_dir):
    cover, ground = A.land(A.with_package(spark))
    raw = A.layered(spark, sf_dir)
    rows = raw.transform(recipes.land_cover_column(cover, ground)).withColumnRenamed("sm", "january")
    rows = rows.transform(recipes.land_cover_column(cover, ground, january_second_layer=False))
    return _rounded(rows.select(*SERIES, "t", "january", F.col("sm").alias("monthly")), "january", "monthly")


@query
def last_month_repair(spark, sf_dir):
    last = F.col("t") == P.months - 1
    raw = A.layered(spark, sf_dir).withColumn("layers", F.when(last, F.transform("layers", lambda x: F.lit(None).cast("double"))).otherwise(F.col("layers")))
    rows = raw.transform(recipes.first_layers())
    auto = months.repair_last_month(rows, P.months, SERIES, raw="layers").withColumnRenamed("sm", "auto")
    always = months.repair_last_month(auto.withColumn("sm", F.col("auto")), P.months, SERIES, mode="always")
    return always.select(*SERIES, "t", "auto", F.col("sm").alias("always"))


@query
def validity(spark, sf_dir):
    holes = A.pool(spark, sf_dir).withColumn("x", F.when((F.col("lon_idx") == 1) & (F.col("g") == 0), None).when((F.col("lon_idx") == 2) & (F.col("g") == 7), -1.0).when(F.col("lon_idx") == 3, 0.0).otherwise(F.col("x")))
    return ssi.validity(holes)


@query
def pool_union(spark, sf_dir):
    return A.pool(spark, sf_dir).groupBy(*CELL, "scn").agg(F.count(F.lit(1)).alias("n"), F.min("g").cast("int").alias("first_g"), F.max("g").cast("int").alias("last_g"), F.sum("x").alias("total"))


@query
def rolling_sum(spark, sf_dir):
    rows = A.pool(spark, sf_dir).withColumn("y", ssi.rolling_sum("x", "g", CELL, P.scale))
    return rows.select(*CELL, F.col("g").cast("int").alias("g"), "y")


@query
def weak_rank(spark, sf_dir):
    return ssi.ranks(ssi.valid_rows(A.pool(spark, sf_dir)), P).select(*CELL, "slice", "t", "k", "y", F.col("bp").cast("bigint").alias("bp"), F.col("n").cast("bigint").alias("n"))


@query
def plotting_position(spark, sf_dir):
    return _rounded(ssi.score(A.pool(spark, sf_dir), P).select(*CELL, "slice", "t", "p"), "p")


@query
def standardized_index(spark, sf_dir):
    return _rounded(ssi.score(A.pool(spark, sf_dir), P, check=True).select(*CELL, "slice", "t", "z"), "z")


@query
def reference_index(spark, sf_dir):
    return _rounded(ssi.score_reference(A.pool(spark, sf_dir), P).select(*CELL, F.col("g").cast("int").alias("g"), "p", "z"), "p", "z")


@query
def inverse_normal(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") + 0.5) / 100001.0).alias("p"))
    return rows.select("event_id", F.round(norm_inv(F.col("p")), 9).alias("z"))


@query
def drought_runs(spark, sf_dir):
    rows = events.runs(ssi.score(A.pool(spark, sf_dir), P), P)
    first = F.min("t").over(Window.partitionBy(*events.SERIES, "run"))
    return _rounded(rows.select(*events.SERIES, "t", first.alias("t0"), "z1"), "z1")


@query
def drought_events(spark, sf_dir):
    rows = events.events(ssi.score(A.pool(spark, sf_dir), P), P)
    return _rounded(rows.select(*events.SERIES, "t0", "d", "m", "pi", "ddd", "drd"), "m", "pi")


@query
def cell_metrics(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), *METRICS)


@query
def class_mask(spark, sf_dir):
    return ensemble.class_mask(A.classes(spark, sf_dir), P)


@query
def quorum_mask(spark, sf_dir):
    return ensemble.masks(_metrics(spark, sf_dir), A.classes(spark, sf_dir), P)


@query
def masked_metrics(spark, sf_dir):
    return _rounded(_masked(spark, sf_dir), *METRICS)


@query
def scenario_differences(spark, sf_dir):
    return _rounded(ensemble.differences(_masked(spark, sf_dir)), *METRICS)


@query
def median_differences(spark, sf_dir):
    return _rounded(ensemble.median_differences(_masked(spark, sf_dir)), *METRICS)


@query
def ensemble_medians(spark, sf_dir):
    return _rounded(ensemble.ensemble_medians(_masked(spark, sf_dir)), *METRICS)


@query
def ascii_grid(spark, sf_dir):
    medians = ensemble.ensemble_medians(_masked(spark, sf_dir))
    return ascii_rows(medians.select("climate", "soc", "period", "lat_idx", "lon_idx", "d"), "d", A.LATS, A.LONS, ("climate", "soc", "period"), decimals=4)


@query
def model_maps(spark, sf_dir):
    return map_lines(_masked(spark, sf_dir), ("d", "pi"), A.LATS, A.LONS, ("model", "climate", "soc", "period"), decimals=4)


@query
def latitude_weights(spark, sf_dir):
    return _rounded(quality_checks.latitude_weights(_one_scenario(spark, sf_dir)), "w")


@query
def global_mean_series(spark, sf_dir):
    return _dated(_rounded(quality_checks.global_mean(_one_scenario(spark, sf_dir), A.LONS), "gm"))


@query
def climatology(spark, sf_dir):
    return _rounded(quality_checks.climatology(quality_checks.global_mean(_one_scenario(spark, sf_dir), A.LONS)), "clim")


@query
def climatology_table(spark, sf_dir):
    series = quality_checks.global_mean(_one_scenario(spark, sf_dir), A.LONS).withColumn("model", F.substring("model", 1, 1))
    names = ["1", "2", "3", "4", "5"]
    wide = quality_checks.climatology_table(series, names)
    return _rounded(wide.select("month", *[F.col(n).alias(f"model_{n}") for n in names]), *[f"model_{n}" for n in names])


@query
def global_mean(spark, sf_dir):
    return _rounded(quality_checks.whole_mean(quality_checks.global_mean(_one_scenario(spark, sf_dir), A.LONS)), "mean")


@query
def mean_report(spark, sf_dir):
    return quality_checks.report(quality_checks.global_mean(_one_scenario(spark, sf_dir), A.LONS))


@query
def catalog(spark, sf_dir):
    models = {"h08": {"variable": "soilmoist"}, "hydropy": {"variable": "rootmoist"}}
    for m, own in models.items():
        own.update({s: f"raw/{m}_{s}.nc" for s in Registry.scenarios()})
    done = {m: {s: f"done/{m}_{s}" for s in Registry.scenarios()} for m in models}
    return Registry({"root": "."}, models, done).table(A.with_package(spark))


@query
def registry_paths(spark, sf_dir):
    """Paths that a registry read from YAML gives; the raw files must be there, folders for results are made."""
    with tempfile.TemporaryDirectory() as folder:  # the driver's alone: registries are never read by executors
        root, lines, done = Path(folder), [f"paths: {{root: {folder}}}", "models:"], ["processed:", "  models_1m:"]
        (root / "raw").mkdir()
        for m, v in (("h08", "soilmoist"), ("hydropy", "rootmoist")):
            lines += [f"  {m}:", f"    variable: {v}"] + [f"    {s}: {folder}/raw/{m}_{s}.nc" for s in Registry.scenarios()]
            done += [f"    {m}:"] + [f"      {s}: {folder}/out/{m}/{s}_1m.nc" for s in Registry.scenarios()]
            for s in Registry.scenarios():
                (root / "raw" / f"{m}_{s}.nc").touch()
        (root / "registry.yml").write_text("\n".join(lines + done) + "\n")
        known = Registry.load(str(root / "registry.yml"))
        place = lambda p: str(Path(p).relative_to(root))
        rows = [(m, s, place(known.raw(m, s)), place(known.processed(m, s)), known.variable(m)) for m in known.list_models() for s in known.scenarios()]
        if not all((root / r[3]).parent.is_dir() for r in rows):
            raise FileNotFoundError("folders for results weren't made")
    return A.with_package(spark).createDataFrame(rows, "model string, scenario string, raw string, processed string, variable string")


@query
def map_names(spark, sf_dir):
    rows = [(s.climate, s.soc, s.period, m, ensemble.map_name(s.climate, s.soc, s.period, m)) for s in P.slices() for m in METRICS]
    return A.with_package(spark).createDataFrame(rows, "climate string, soc string, period string, metric string, name string")
