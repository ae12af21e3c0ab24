"""Standardised soil-moisture index against a pooled, seasonally stratified reference.

All scenarios of a cell run one after another in one series (position g). Rolling sums cross the seams between them. A
scored slice is appended to the pool once more, so it counts twice in its reference, and two (scale - 1) more windows lie
over the seam between pool and slice. Instead of ranking each slice against its own copy of the pool, all windows of a
cell and season are sorted once, and a running count for the pool and one for each slice's extra windows give every rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_inv
from ..params import CELL, Params, Slice


def pool_position(df: DataFrame, p: Params) -> DataFrame:
    """Place of each month in the pooled series, by scenario (column scn) and month t."""
    return df.withColumn("g", F.col("scn") * p.months + F.col("t"))


def with_scenario_number(df: DataFrame, p: Params) -> DataFrame:
    """Column scn from climate and soc, in pool order; other scenarios are dropped."""
    number = F.coalesce(*[F.when((F.col("climate") == c) & (F.col("soc") == s), F.lit(i)) for i, (c, s) in enumerate(p.pool)])
    return df.withColumn("scn", number).filter(F.col("scn").isNotNull())


def validity(df: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """A row a cell: n, begins (first pooled value there and the sum not 0), complete (every value there and at least 0)."""
    x = F.col("x")
    begins = F.min_by(x, "g").isNotNull() & (~F.sum(x).eqNullSafe(F.lit(0.0)) | (F.count(x) < F.count(F.lit(1))))
    first = F.min_by(F.coalesce(x.isNotNull(), F.lit(False)), "g")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (begins & first).alias("begins"), F.bool_and(x.isNotNull() & (x >= 0)).alias("complete"))


def valid_rows(df: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    """Rows of cells that can be scored: nothing missing, nothing negative, not all 0."""
    whole = Window.partitionBy(*keys)
    ok = F.bool_and(F.col("x").isNotNull() & (F.coalesce(F.col("x"), F.lit(-1.0)) >= 0)).over(whole) & (F.sum("x").over(whole) != 0)
    return df.withColumn("_ok", F.coalesce(ok, F.lit(False))).filter("_ok").drop("_ok")


def rolling_sum(x: str, order: str, keys: tuple[str, ...], scale: int) -> Column:
    """Sum of the last ``scale`` values, added oldest first (the order matters for ties); null until there are so many."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = F.lag(x, scale - 1).over(w) if scale > 1 else F.col(x)
    for k in range(scale - 2, -1, -1):
        out = out + (F.lag(x, k).over(w) if k else F.col(x))
    return out


def windows(df: DataFrame, p: Params, slices: list[Slice], keys: tuple[str, ...] = CELL) -> DataFrame:
    """All rolling windows of a cell: y, season k, the months t and slices they are scored in, and whether in the pool.

    At the last pooled month the windows over the seams are added, for each slice scale - 1 of them.
    """
    whole, extra = Window.partitionBy(*keys), p.scale - 1
    total = p.months * len(p.pool)
    df = df.withColumn("y", rolling_sum("x", "g", keys, p.scale))

    def at(g: int) -> Column:
        return F.max(F.when(F.col("g") == g, F.col("x"))).over(whole)

    edge = {f"_e{i}": at(total - extra + i) for i in range(extra)}
    heads = {f"_h{s.number}_{i}": at(s.scenario * p.months + s.t0 + i) for s in slices for i in range(extra)}
    df = df.withColumns(edge | heads)
    kind = "struct<y:double,k:int,slice:int,t:int,pool:int>"
    seams = []
    for s in slices:
        series = [F.col(f"_e{i}") for i in range(extra)] + [F.col(f"_h{s.number}_{i}") for i in range(extra)]
        for i in range(extra):
            y = series[i]
            for v in series[i + 1 : i + p.scale]:
                y = y + v
            seams.append(F.struct(y.alias("y"), F.lit((i - extra) % p.seasons).alias("k"), F.lit(s.number).alias("slice"), F.lit(None).cast("int").alias("t"), F.lit(0).alias("pool")).cast(kind))
    own = F.struct(F.col("y").alias("y"), F.pmod(F.col("g") - extra, F.lit(p.seasons)).cast("int").alias("k"), F.lit(None).cast("int").alias("slice"), F.lit(None).cast("int").alias("t"), F.lit(1).alias("pool")).cast(kind)
    rows = F.when(F.col("g") == total - 1, F.array(own, *seams)).otherwise(F.array(own)) if seams else F.array(own)
    out = df.select(*keys, "g", F.explode(rows).alias("_w"))
    return out.select(*keys, "g", F.col("_w.y").alias("y"), F.col("_w.k").alias("k"), F.col("_w.slice").alias("seam_of"), F.col("_w.pool").alias("pool")).filter(F.col("y").isNotNull())


def ranks(df: DataFrame, p: Params, slices: list[Slice] | None = None, keys: tuple[str, ...] = CELL) -> DataFrame:
    """keys, slice, t, y, bp (reference windows of the season not above y) and n of every scored window.

    df: keys, scn, t, g, x of valid cells.
    """
    slices = p.slices() if slices is None else slices
    rows = windows(df, p, slices, keys)
    inside = {}
    for s in slices:
        first = s.scenario * p.months + s.t0
        scored = F.col("g").between(first + p.scale - 1, first + p.slice_months - 1) & (F.col("pool") == 1)
        inside[s.number] = scored
        rows = rows.withColumn(f"_s{s.number}", F.when(scored | (F.col("seam_of") == s.number), 1).otherwise(0))
    stratum = Window.partitionBy(*keys, "k")
    upto = stratum.orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counts = {"_c": F.sum("pool").over(upto), "_n": F.sum("pool").over(stratum)}
    for s in slices:
        counts[f"_c{s.number}"] = F.sum(f"_s{s.number}").over(upto)
        counts[f"_n{s.number}"] = F.sum(f"_s{s.number}").over(stratum)
    rows = rows.withColumns(counts)
    made = [F.when(inside[s.number], F.struct(F.lit(s.number).alias("slice"), (F.col("g") - (s.scenario * p.months + s.t0)).cast("int").alias("t"), (F.col("_c") + F.col(f"_c{s.number}")).alias("bp"), (F.col("_n") + F.col(f"_n{s.number}")).alias("n"))) for s in slices]
    out = rows.select(*keys, "k", "y", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("_r"))
    return out.select(*keys, "_r.slice", "_r.t", "k", "y", "_r.bp", "_r.n")


def plotting_position(p: Params) -> Column:
    return (F.col("bp") - F.lit(p.plot_a)) / (F.col("n") + F.lit(p.plot_b))


def score(df: DataFrame, p: Params, slices: list[Slice] | None = None, keys: tuple[str, ...] = CELL, check: bool = False) -> DataFrame:
    """keys, slice, t, y, p, z. check: fail on a missing z instead of passing it on."""
    out = ranks(valid_rows(df, keys), p, slices, keys).withColumn("p", plotting_position(p)).withColumn("z", norm_inv(F.col("p")))
    if check:
        out = out.withColumn("z", F.when(F.col("z").isNull(), F.raise_error(F.lit("index is missing"))).otherwise(F.col("z")))
    return out.select(*keys, "slice", "t", "y", "p", "z")


def score_reference(df: DataFrame, p: Params, keys: tuple[str, ...] = CELL) -> DataFrame:
    """The index of the pool itself, each window ranked in the pool without any slice appended."""
    rows = valid_rows(df, keys).withColumn("y", rolling_sum("x", "g", keys, p.scale)).filter(F.col("y").isNotNull())
    rows = rows.withColumn("k", F.pmod(F.col("g") - (p.scale - 1), F.lit(p.seasons)).cast("int"))
    stratum = Window.partitionBy(*keys, "k")
    rows = rows.withColumn("bp", F.count(F.lit(1)).over(stratum.orderBy("y").rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.count(F.lit(1)).over(stratum))
    return rows.withColumn("p", plotting_position(p)).withColumn("z", norm_inv(F.col("p"))).select(*keys, "g", "y", "p", "z")
