"""SQL for the registered queries, written from the definitions: every slice is ranked against its own copy of the pool."""

from __future__ import annotations

from ..operators.ensemble import DIFFERENCES
from ..params import METRICS
from . import analogue as A

P = A.PARAMS
CELL = "model, lat_idx, lon_idx"


def quantile(p: str) -> str:
    """The normal quantile by Newton's method on the chance above z, which shares nothing with the rational approximation
    of the engine: 1/2 - density(z) * sum of z^(2k+1) / (2k+1)!! near the middle, density(z) over the continued fraction
    z + 1/(z + 2/(z + 3/(...))) in the tail, where the first would lose digits."""
    m = f"least({p}, 1e0 - {p})"
    density = "(exp(-z * z / 2) / sqrt(2 * pi()))"
    series = "list_sum(list_transform(range(60), lambda k: exp((2 * k + 1) * ln(greatest(z, 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    fraction = "list_reduce(list_transform(range(100, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda t, k: z + k / t, z)"
    above = f"CASE WHEN z > 2 THEN {density} / {fraction} ELSE 0.5e0 - {density} * {series} END"
    start = f"4.91e0 * ((1e0 - {m}) ** 0.14e0 - {m} ** 0.14e0)"
    return f"(CASE WHEN {p} < 0.5e0 THEN -1 ELSE 1 END) * list_reduce([{start}{', 0e0' * 12}], lambda z, i: z + ({above} - {m}) / {density})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


SHIPPED = """shipped AS (
    SELECT o_orderpriority AS model, CAST(l_suppkey % 10 AS INTEGER) AS cell,
           CASE WHEN l_linestatus = 'F' THEN 'obsclim' ELSE 'counterclim' END AS climate,
           CASE WHEN l_orderkey % 2 = 0 THEN 'histsoc' ELSE '1901soc' END AS soc,
           l_linenumber - 1 AS layer, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, l_quantity AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) BETWEEN 1995 AND 2000)"""
SCENARIOS = f"scenarios(scn, climate, soc) AS (VALUES {_values([(i, c, s) for i, (c, s) in enumerate(P.pool)])})"
SOIL = f"""{SHIPPED}, {SCENARIOS}, sums AS (SELECT model, cell, climate, soc, t, sum(quantity) AS x FROM shipped GROUP BY ALL),
soil AS (
    SELECT g.model, CAST(g.cell // 5 AS INTEGER) AS lat_idx, CAST(g.cell % 5 AS INTEGER) AS lon_idx, -30e0 + 75e0 * (g.cell // 5) AS lat,
           g.scn, g.climate, g.soc, g.t, make_date(CAST(1995 + g.t // 12 AS BIGINT), CAST(g.t % 12 + 1 AS BIGINT), 1) AS month, coalesce(s.x, 0e0) AS sm
    FROM (SELECT model, CAST(cell AS INTEGER) AS cell, scn, climate, soc, CAST(t AS INTEGER) AS t
          FROM (SELECT DISTINCT o_orderpriority AS model FROM orders), range(10) c(cell), scenarios, range({P.months}) m(t)) g
    LEFT JOIN sums s ON s.model = g.model AND s.cell = g.cell AND s.climate = g.climate AND s.soc = g.soc AND s.t = g.t)"""
LAYERED = f"""{SHIPPED}, layered AS (
    SELECT model, CAST(cell // 5 AS INTEGER) AS lat_idx, CAST(cell % 5 AS INTEGER) AS lon_idx, cell, climate, soc, t,
           {", ".join(f"sum(quantity) FILTER (layer = {k}) AS l{k}" for k, _, _ in A.BOUNDS)}
    FROM shipped GROUP BY model, cell, climate, soc, t)"""
POOL = f"{SOIL}, pool AS (SELECT {CELL}, scn, t, scn * {P.months} + t AS g, sm AS x FROM soil)"
SLICES = f"slices(slice, scn0, t0, climate, soc, period) AS (VALUES {_values([(s.number, s.scenario, s.t0, s.climate, s.soc, s.period) for s in P.slices()])})"
TOTAL = P.months * len(P.pool)
RANKS = f"""{POOL}, {SLICES},
good AS (SELECT {CELL} FROM pool GROUP BY ALL HAVING bool_and(x IS NOT NULL AND x >= 0) AND sum(x) <> 0),
series AS (
    SELECT {CELL}, slice, g, x, CAST(NULL AS INTEGER) AS t FROM pool SEMI JOIN good USING ({CELL}), slices
    UNION ALL
    SELECT {CELL}, slice, {TOTAL} + t - t0, x, CAST(t - t0 AS INTEGER) FROM pool SEMI JOIN good USING ({CELL}) JOIN slices ON scn = scn0 AND t >= t0 AND t < t0 + {P.slice_months}),
summed AS (SELECT *, lag(x, 2) OVER w + lag(x, 1) OVER w + x AS y FROM series WINDOW w AS (PARTITION BY {CELL}, slice ORDER BY g)),
seasons AS (SELECT *, CAST((g - 2) % 12 AS INTEGER) AS k FROM summed WHERE y IS NOT NULL),
counted AS (SELECT *, count(*) OVER (PARTITION BY {CELL}, slice, k ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bp,
                   count(*) OVER (PARTITION BY {CELL}, slice, k) AS n FROM seasons),
ranks AS (SELECT {CELL}, CAST(slice AS INTEGER) AS slice, t, k, y, bp, n FROM counted WHERE t >= 2)"""
SCORED = f"{RANKS}, placed AS (SELECT *, (bp - 0.44e0) / (n + 0.12e0) AS p FROM ranks), scored AS (SELECT *, {quantile('p')} AS z FROM placed)"


def _runs(source: str) -> str:
    one = f"PARTITION BY {CELL}, slice"
    return f"""a AS (SELECT *, CASE WHEN z BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS xp FROM {source}),
b AS (SELECT *, CASE WHEN xp = lag(xp) OVER ({one} ORDER BY t) THEN 0 ELSE 1 END AS chg FROM a),
c AS (SELECT *, sum(chg) OVER ({one} ORDER BY t ROWS UNBOUNDED PRECEDING) AS gap FROM b),
e AS (SELECT {CELL}, slice, t, CASE WHEN xp = 1 AND count(*) OVER ({one}, gap) < 6 THEN -1e-6 ELSE z END AS z1 FROM c),
f AS (SELECT *, CASE WHEN z1 < 0 THEN 1 ELSE 0 END AS xn FROM e),
h AS (SELECT *, CASE WHEN xn = lag(xn) OVER ({one} ORDER BY t) THEN 0 ELSE 1 END AS chg FROM f),
i AS (SELECT *, sum(chg) OVER ({one} ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM h),
dry AS (SELECT {CELL}, slice, t, z1, run, min(t) OVER ({one}, run) AS t0, row_number() OVER ({one}, run ORDER BY z1, t) AS nth, min(z1) OVER ({one}, run) AS low FROM i WHERE xn = 1),
found AS (SELECT {CELL}, slice, t0, count(*) AS d, sum(abs(z1)) AS m, max(CASE WHEN nth = 1 THEN t - t0 + 1 END) AS ddd FROM dry WHERE low <= -1 GROUP BY ALL)"""


RUNS = f"{SCORED}, {_runs('scored')}"
METRICS_SQL = f"""{SCORED}, gated AS (SELECT * FROM scored SEMI JOIN (SELECT {CELL}, slice FROM scored GROUP BY ALL HAVING min(z) < -1) USING ({CELL}, slice)), {_runs('gated')},
metrics AS (
    SELECT model, climate, soc, period, lat_idx, lon_idx, avg(d) AS d, avg(m) AS m, avg(m / d) AS pi, avg(ddd) AS ddd, avg(d - ddd) AS drd
    FROM found JOIN slices USING (slice) GROUP BY ALL)"""
CLASSES = "classes AS (SELECT CAST(n_nationkey // 5 AS INTEGER) AS lat_idx, CAST(n_nationkey % 5 AS INTEGER) AS lon_idx, CASE n_nationkey WHEN 3 THEN 30 WHEN 5 THEN NULL ELSE n_nationkey END AS class FROM nation WHERE n_nationkey < 10 AND n_nationkey <> 6)"
MASKED = f"""{METRICS_SQL}, {CLASSES},
cubes AS (SELECT soc, climate, period, lat_idx, lon_idx, count(d) AS models FROM metrics GROUP BY ALL),
masks AS (
    SELECT soc, q.lat_idx, q.lon_idx, CASE WHEN class = 30 THEN NULL ELSE agreed END AS mask
    FROM (SELECT soc, lat_idx, lon_idx, CASE WHEN max(models) > 2 THEN 1e0 ELSE 0e0 END AS agreed FROM cubes GROUP BY ALL) q
    LEFT JOIN classes USING (lat_idx, lon_idx)),
masked AS (
    SELECT model, climate, soc, period, lat_idx, lon_idx,
           {", ".join(f"CASE WHEN climate = 'counterclim' AND soc = '1901soc' THEN {c} ELSE {c} * mask END AS {c}" for c in METRICS)}
    FROM metrics LEFT JOIN masks USING (soc, lat_idx, lon_idx))"""


def _differences() -> str:
    parts = []
    for name, a, b in DIFFERENCES:
        x, y = (" AND ".join(f"{c} = '{v}'" for c, v in zip(("climate", "soc", "period"), cube, strict=True)) for cube in (a, b))
        keys = ", ".join(f"g.{c}" for c in ("model", "lat_idx", "lon_idx"))
        on_x, on_y = (" AND ".join(f"g.{c} = {s}.{c}" for c in ("model", "lat_idx", "lon_idx")) for s in "xy")
        parts.append(f"SELECT '{name}' AS name, {keys}, {', '.join(f'x.{c} - y.{c} AS {c}' for c in METRICS)} FROM (SELECT DISTINCT model, lat_idx, lon_idx FROM masked) g LEFT JOIN (SELECT * FROM masked WHERE {x}) x ON {on_x} LEFT JOIN (SELECT * FROM masked WHERE {y}) y ON {on_y}")
    return f"{MASKED}, diffs AS ({' UNION ALL '.join(parts)})"


DIFFS = _differences()
MEDIANS = f"{MASKED}, medians AS (SELECT climate, soc, period, lat_idx, lon_idx, {', '.join(f'median({c}) AS {c}' for c in METRICS)} FROM masked GROUP BY climate, soc, period, lat_idx, lon_idx)"
ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in METRICS)
ONE = f"{SOIL}, one AS (SELECT model, lat_idx, lon_idx, lat, month, nullif(sm, 0) AS sm FROM soil WHERE climate = 'obsclim' AND soc = 'histsoc')"
WEIGHTS = f"{ONE}, weights AS (SELECT lat, cos(radians(lat)) / sum(cos(radians(lat))) OVER () AS w FROM (SELECT DISTINCT lat FROM one))"
MEAN = f"{WEIGHTS}, gm AS (SELECT model, month, sum(coalesce(sm, 0e0) * w) / {A.LONS} AS gm FROM one JOIN weights USING (lat) GROUP BY ALL)"
_SHARE = {k: (max(min(b, 1.0) - max(a, 0.0), 0.0) / (b - a) if b > a else 0.0) for k, a, b in A.BOUNDS}


def _land(second: str) -> str:
    def l2(root: str) -> str:
        return f"least(d1 + d2 - 0.05e0, greatest(d1, {root} - 0.05e0))"

    def deep(root: str) -> str:
        return f"l2 * ((1 - {l2(root)} + 0.05e0) / greatest(0.05e0, d1 + d2 - {l2(root)}))"

    def woody(f: str, root: str) -> str:
        return f"CASE WHEN {l2(root)} = 0.95e0 THEN {f} * l0 + {f} * {second} ELSE {f} * (l0 + {second} + {deep(root)}) END"

    return f"f_grass * (l0 + l1) / root_grass + {woody('f_forest', 'root_forest')} + f_paddy * (l0 * 0.05e0 + l1 + {deep('root_paddy')}) + {woody('f_nonpaddy', 'root_nonpaddy')}"


LAND = f"""{LAYERED}, grown AS (
    SELECT *, ((cell + t // 12) % 4) / 8e0 AS f_forest, ((cell + t // 12 + 1) % 4) / 8e0 AS f_grass, ((cell + t // 12 + 2) % 4) / 8e0 AS f_paddy, ((cell + t // 12 + 3) % 4) / 8e0 AS f_nonpaddy,
           1e0 + (cell % 3) / 4e0 AS root_forest, 0.5e0 + (cell % 3) / 4e0 AS root_grass, 0.25e0 + (cell % 3) / 4e0 AS root_paddy, 0.75e0 + (cell % 3) / 4e0 AS root_nonpaddy,
           greatest(0.05e0, 0.25e0 + (cell % 2) / 2e0 - 0.05e0) AS d1, greatest(0.05e0, 1e0 + (cell % 4) / 4e0) AS d2,
           first_value(l1) OVER (PARTITION BY model, cell, climate, soc, t // 12 ORDER BY t) AS january FROM layered)"""

SQL: dict[str, str] = {
    "month_start": "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-01') AS month FROM lineitem",
    "period_slice": f"WITH {SOIL} SELECT model, climate, soc, lat_idx, lon_idx, strftime(month, '%Y-%m-%d') AS month, sm FROM soil WHERE soil.month BETWEEN DATE '1996-01-01' AND DATE '1997-12-01'",
    "first_and_last_months": f"WITH {SOIL} SELECT model, climate, soc, lat_idx, lon_idx, t, sm, 'EI' AS period FROM soil WHERE t < 24 UNION ALL SELECT model, climate, soc, lat_idx, lon_idx, t, sm, 'RP' FROM soil WHERE t >= 48",
    "single_layer": f"WITH {SOIL} SELECT 'hydropy' AS model, climate, soc, lat_idx, lon_idx, strftime(month, '%Y-%m-%d') AS month, sm AS rootmoist, sm FROM soil",
    "first_layers": f"WITH {LAYERED} SELECT {CELL}, climate, soc, t, coalesce(l0, 0) + coalesce(l1, 0) + coalesce(l2, 0) AS skipped, l0 + l1 + l2 AS strict FROM layered",
    "depth_overlap": f"WITH {LAYERED} SELECT {CELL}, climate, soc, t, round({' + '.join(f'coalesce(l{k} * {v!r}e0, 0)' for k, v in _SHARE.items())}, 9) AS sm FROM layered",
    "layer_shares": f"SELECT CAST(layer AS INTEGER) AS layer, round(coalesce(greatest(least(bot, 1e0) - greatest(top, 0e0), 0e0) / nullif(bot - top, 0e0), 0e0), 9) AS share FROM (VALUES {_values([(k, f'@{a}', f'@{b}') for k, a, b in A.BOUNDS])}) v(layer, top, bot)".replace("'@", "").replace("'", "").replace("0.0,", "0e0,"),
    "thinned_third_layer": f"WITH {LAYERED} SELECT {CELL}, climate, soc, t, round(l0 + l1 + l2 * ((1e0 - 0.48e0) / (2e0 - 0.48e0)), 9) AS sm FROM layered",
    "land_cover_column": f"WITH {LAND} SELECT {CELL}, climate, soc, t, round({_land('january')}, 9) AS january, round({_land('l1')}, 9) AS monthly FROM grown",
    "model_recipes": f"WITH {LAYERED}, sums AS (SELECT *, coalesce(l0, 0) + coalesce(l1, 0) + coalesce(l2, 0) AS three, l0 + l1 + l2 * ((1e0 - 0.48e0) / (2e0 - 0.48e0)) AS thinned, {' + '.join(f'coalesce(l{k} * {v!r}e0, 0)' for k, v in _SHARE.items())} AS metre FROM layered) SELECT model AS series, recipe, lat_idx, lon_idx, climate, soc, t, round(CASE recipe WHEN 'hydropy' THEN l1 WHEN 'jules-w2' THEN three WHEN 'miroc-integ-land' THEN three WHEN 'classic' THEN three WHEN 'ssib4-triffid-fire' THEN thinned WHEN 'lpjml5-7-10-fire' THEN metre ELSE l0 END, 9) AS sm FROM sums, (VALUES ('h08'), ('hydropy'), ('jules-w2'), ('miroc-integ-land'), ('watergap2-2e'), ('web-dhm-sg'), ('lpjml5-7-10-fire'), ('classic'), ('ssib4-triffid-fire')) r(recipe)",
    "last_month_repair": f"WITH {LAYERED}, s AS (SELECT {CELL}, climate, soc, t, CASE WHEN t = 71 THEN 0e0 ELSE coalesce(l0, 0) + coalesce(l1, 0) + coalesce(l2, 0) END AS sm FROM layered), r AS (SELECT {CELL}, climate, soc, t, CASE WHEN t = 71 THEN lag(sm) OVER (PARTITION BY {CELL}, climate, soc ORDER BY t) ELSE sm END AS fixed FROM s) SELECT {CELL}, climate, soc, t, fixed AS auto, CASE WHEN t = 71 THEN lag(fixed) OVER (PARTITION BY {CELL}, climate, soc ORDER BY t) ELSE fixed END AS always FROM r",
    "validity": f"WITH {POOL}, h AS (SELECT {CELL}, g, CASE WHEN lon_idx = 1 AND g = 0 THEN NULL WHEN lon_idx = 2 AND g = 7 THEN -1e0 WHEN lon_idx = 3 THEN 0e0 ELSE x END AS x FROM pool) SELECT {CELL}, count(*) AS n, max(CASE WHEN g = 0 THEN x END) IS NOT NULL AND (sum(x) <> 0 OR count(x) < count(*)) AS begins, bool_and(x IS NOT NULL AND x >= 0) AS complete FROM h GROUP BY {CELL}",
    "pool_union": f"WITH {POOL} SELECT {CELL}, CAST(scn AS INTEGER) AS scn, count(*) AS n, CAST(min(g) AS INTEGER) AS first_g, CAST(max(g) AS INTEGER) AS last_g, sum(x) AS total FROM pool GROUP BY {CELL}, scn",
    "rolling_sum": f"WITH {POOL} SELECT {CELL}, CAST(g AS INTEGER) AS g, lag(x, 2) OVER w + lag(x, 1) OVER w + x AS y FROM pool WINDOW w AS (PARTITION BY {CELL} ORDER BY g)",
    "weak_rank": f"WITH {RANKS} SELECT * FROM ranks",
    "plotting_position": f"WITH {SCORED} SELECT {CELL}, slice, t, round(p, 9) AS p FROM scored",
    "standardized_index": f"WITH {SCORED} SELECT {CELL}, slice, t, round(z, 9) AS z FROM scored",
    "reference_index": f"WITH {POOL}, good AS (SELECT {CELL} FROM pool GROUP BY ALL HAVING bool_and(x IS NOT NULL AND x >= 0) AND sum(x) <> 0), y AS (SELECT {CELL}, g, lag(x, 2) OVER w + lag(x, 1) OVER w + x AS y FROM pool SEMI JOIN good USING ({CELL}) WINDOW w AS (PARTITION BY {CELL} ORDER BY g)), r AS (SELECT *, (count(*) OVER (PARTITION BY {CELL}, (g - 2) % 12 ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.44e0) / (count(*) OVER (PARTITION BY {CELL}, (g - 2) % 12) + 0.12e0) AS p FROM y WHERE y IS NOT NULL) SELECT {CELL}, CAST(g AS INTEGER) AS g, round(p, 9) AS p, round({quantile('p')}, 9) AS z FROM r",
    "inverse_normal": f"SELECT event_id, round({quantile('p')}, 9) AS z FROM (SELECT event_id, (event_id + 0.5e0) / 100001e0 AS p FROM events)",
    "drought_runs": f"WITH {RUNS} SELECT {CELL}, slice, t, t0, round(z1, 9) AS z1 FROM dry WHERE low <= -1",
    "drought_events": f"WITH {RUNS} SELECT {CELL}, slice, t0, d, round(m, 9) AS m, round(m / d, 9) AS pi, CAST(ddd AS BIGINT) AS ddd, CAST(d - ddd AS BIGINT) AS drd FROM found",
    "cell_metrics": f"WITH {METRICS_SQL} SELECT model, climate, soc, period, lat_idx, lon_idx, {ROUNDED} FROM metrics",
    "class_mask": f"WITH {CLASSES} SELECT lat_idx, lon_idx, CASE WHEN class = 30 THEN NULL ELSE 1e0 END AS open FROM classes",
    "quorum_mask": f"WITH {MASKED} SELECT soc, lat_idx, lon_idx, mask FROM masks",
    "masked_metrics": f"WITH {MASKED} SELECT model, climate, soc, period, lat_idx, lon_idx, {ROUNDED} FROM masked",
    "scenario_differences": f"WITH {DIFFS} SELECT name, model, lat_idx, lon_idx, {ROUNDED} FROM diffs",
    "median_differences": f"WITH {DIFFS} SELECT name, lat_idx, lon_idx, {', '.join(f'round(median({c}), 9) AS {c}' for c in METRICS)} FROM diffs GROUP BY name, lat_idx, lon_idx",
    "ensemble_medians": f"WITH {MEDIANS} SELECT climate, soc, period, lat_idx, lon_idx, {ROUNDED} FROM medians",
    "ascii_grid": f"WITH {MEDIANS}, full_grid AS (SELECT climate, soc, period, CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx FROM (SELECT DISTINCT climate, soc, period FROM medians), range({A.LATS}) a(i), range({A.LONS}) b(j)) SELECT climate, soc, period, CAST({A.LATS - 1} - lat_idx AS INTEGER) AS row, string_agg(coalesce(printf('%.4f', d), '-9999'), ' ' ORDER BY lon_idx) AS line FROM full_grid LEFT JOIN medians USING (climate, soc, period, lat_idx, lon_idx) GROUP BY climate, soc, period, lat_idx",
    "model_maps": f"WITH {MASKED}, long AS (SELECT concat_ws('_', model, climate, soc, period, metric) AS map, lat_idx, lon_idx, v FROM masked UNPIVOT INCLUDE NULLS (v FOR metric IN (d, pi))), full_grid AS (SELECT map, CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx FROM (SELECT DISTINCT map FROM long), range({A.LATS}) a(i), range({A.LONS}) b(j)) SELECT map, CAST({A.LATS - 1} - lat_idx AS INTEGER) AS row, string_agg(coalesce(printf('%.4f', v), '-9999'), ' ' ORDER BY lon_idx) AS line FROM full_grid LEFT JOIN long USING (map, lat_idx, lon_idx) GROUP BY map, lat_idx UNION ALL SELECT map, CAST(n AS INTEGER), line FROM (SELECT DISTINCT map FROM long), (VALUES (-100, 'ncols {A.LONS}'), (-99, 'nrows {A.LATS}'), (-98, 'xllcorner -180'), (-97, 'yllcorner -90'), (-96, 'cellsize 0.5'), (-95, 'NODATA_value -9999')) h(n, line)",
    "registry_paths": "SELECT m AS model, s AS scenario, 'raw/' || m || '_' || s || '.nc' AS raw, 'out/' || m || '/' || s || '_1m.nc' AS processed, v AS variable FROM (VALUES ('h08', 'soilmoist'), ('hydropy', 'rootmoist')) a(m, v), (VALUES ('obsclim_histsoc'), ('counterclim_histsoc'), ('obsclim_1901soc'), ('counterclim_1901soc')) b(s)",
    "latitude_weights": f"WITH {WEIGHTS} SELECT lat, round(w, 9) AS w FROM weights",
    "global_mean_series": f"WITH {MEAN} SELECT model, strftime(month, '%Y-%m-%d') AS month, round(gm, 9) AS gm FROM gm",
    "climatology": f"WITH {MEAN} SELECT model, CAST(month(month) AS INTEGER) AS month, round(avg(gm), 9) AS clim FROM gm GROUP BY ALL",
    "climatology_table": f"WITH {MEAN} SELECT CAST(month(month) AS INTEGER) AS month, {', '.join(f'round(avg(gm) FILTER (model[1] = {n!r}), 9) AS model_{n}' for n in '12345')} FROM gm GROUP BY month(month)",
    "global_mean": f"WITH {MEAN} SELECT model, round(avg(gm), 9) AS mean FROM gm GROUP BY model",
    "mean_report": f"WITH {MEAN} SELECT printf('  %-16s: %8.3f', model, avg(gm)) AS line FROM gm GROUP BY model",
    "catalog": "SELECT m AS model, s AS scenario, split_part(s, '_', 1) AS climate, split_part(s, '_', 2) AS soc, CASE m WHEN 'h08' THEN 'soilmoist' ELSE 'rootmoist' END AS variable, 'raw/' || m || '_' || s || '.nc' AS raw_path, 'done/' || m || '_' || s AS out_path FROM (VALUES ('h08'), ('hydropy')) a(m), (VALUES ('obsclim_histsoc'), ('counterclim_histsoc'), ('obsclim_1901soc'), ('counterclim_1901soc')) b(s)",
    "map_names": f"WITH {SLICES} SELECT climate, soc, period, metric, CASE climate WHEN 'obsclim' THEN 'factual' ELSE 'counterfact' END || '_' || CASE metric WHEN 'd' THEN 'Duration' WHEN 'm' THEN 'Magnitude' WHEN 'pi' THEN 'Intensity' ELSE upper(metric) END || '_' || period || '_' || soc AS name FROM slices, (VALUES ('d'), ('m'), ('pi'), ('ddd'), ('drd')) v(metric)",
}
