import datetime
import math
import struct
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loamline.functions.normal import norm_inv
from loamline.operators import months, quality_checks, recipes
from loamline.sources import catalog, grids, netcdf


def test_inverse_normal(spark):
    values = [1e-7, 1e-3, 0.02425, 0.074, 0.075, 0.3, 0.5, 0.6, 0.925, 0.93, 0.999, 1 - 1e-7]
    got = spark.createDataFrame([(v,) for v in [*values, 0.0, 1.0, None]], "p double").select("p", norm_inv(F.col("p")).alias("z")).collect()
    for r in got:
        if r.p in (None, 0.0, 1.0):
            assert r.z is None
        else:
            assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-9)


def layered(spark, *layers):
    rows = [("m", 0, 0, t, [None if v is None else float(v) for v in x]) for t, x in enumerate(layers)]
    return spark.createDataFrame(rows, "model string, lat_idx int, lon_idx int, t int, layers array<double>")


def sm(df):
    return [r.sm for r in df.orderBy("t").collect()]


def test_first_three_layers(spark):
    assert sm(layered(spark, *[[1, 2, 3, 100]] * 3).transform(recipes.recipe_for("jules-w2"))) == [6.0] * 3
    assert sm(layered(spark, *[[1, 2, 3, 50]] * 3).withColumnRenamed("layers", "levsoi").transform(recipes.recipe_for("miroc-integ-land"))) == [6.0] * 3


def test_missing_layers(spark):
    df = layered(spark, [1, None, 3, 9], [None, None, None, 9], [1, 2])
    assert sm(df.transform(recipes.first_layers())) == [4.0, 0.0, 3.0]
    assert sm(df.transform(recipes.first_layers(skip_missing=False))) == [None, None, 3.0]
    assert sm(df.transform(recipes.thinned_third()))[:2] == [None, None]
    assert sm(layered(spark, [1, 2, 3]).transform(recipes.thinned_third())) == pytest.approx([3 + 3 * 0.52 / 1.52])


def test_layer_bounds(spark):
    bounds = spark.createDataFrame([(0, 0.0, 0.2), (1, 0.2, 0.8), (2, 0.8, 1.2), (3, 1.2, 1.2), (4, 1.2, 3.0)], "layer int, top_m double, bot_m double")
    df = layered(spark, [1, 2, 4, 8, 16], [None, 2, None, 8, 16])
    assert sm(df.transform(recipes.overlap(bounds))) == pytest.approx([5.0, 2.0])
    with pytest.raises(KeyError):
        df.transform(recipes.overlap(None))


def test_unknown_recipes_and_columns(spark):
    with pytest.raises(KeyError, match="no-model"):
        recipes.recipe_for("no-model")
    with pytest.raises(KeyError):
        spark.range(1).transform(recipes.first_layers())
    with pytest.raises(KeyError):
        spark.range(1).transform(recipes.recipe_for("hydropy"))
    tagged = recipes.tag(spark.createDataFrame([(1.0,)], "sm double"), "h08", "obsclim_1901soc", "note")
    assert tagged.schema["sm"].metadata["native_depth_note"] == "note" and tagged.first().soc == "1901soc"


def test_land_cover(spark):
    cover = spark.createDataFrame([(0, 0, y, 0.5, 0.25, 0.125, 0.125) for y in range(2)], "lat_idx int, lon_idx int, year_idx int, f_forest double, f_grass double, f_paddy double, f_nonpaddy double")
    soil = spark.createDataFrame([(0, 0, 1.0, 0.5, 0.4, 2.0, 0.3, 1.2)], "lat_idx int, lon_idx int, root_forest double, root_grass double, root_paddy double, root_nonpaddy double, store1 double, store2 double")
    df = layered(spark, *[[1.0 + t, 2.0 + t, 3.0 + t] for t in range(24)])
    got = sm(df.transform(recipes.land_cover_column(cover, soil)))
    for t in range(24):
        one, two, three, jan = 1.0 + t, 2.0 + t, 3.0 + t, 2.0 + t // 12 * 12
        d1, d2 = max(0.05, 0.3 - 0.05), max(0.05, 1.2)
        second = lambda root: min(d1 + d2 - 0.05, max(d1, root - 0.05))  # noqa: B023, E731
        deep = lambda root: three * ((1 - second(root) + 0.05) / max(0.05, d1 + d2 - second(root)))  # noqa: B023, E731
        woody = lambda f, root: f * one + f * jan if second(root) == 0.95 else f * (one + jan + deep(root))  # noqa: B023, E731
        assert got[t] == pytest.approx(0.25 * (one + two) / 0.5 + woody(0.5, 1.0) + 0.125 * (one * 0.05 + two + deep(0.4)) + woody(0.125, 2.0))


def test_months(spark):
    df = spark.createDataFrame([(datetime.datetime(2001, 2, 28),), (datetime.datetime(2001, 2, 3),)], "time timestamp_ntz")
    assert [r.month for r in months.month_start(df).collect()] == [datetime.date(2001, 2, 1)] * 2
    assert months.month_start(spark.range(1)).columns == ["id"]
    numbered = months.month_number(months.month_start(df), 1901)
    assert numbered.first().t == 1201
    assert months.between_months(numbered, "2001-02-01", "2001-02-01").count() == 2


def test_last_month_repair(spark):
    df = spark.createDataFrame([("a", 0, 1.0, [1.0]), ("a", 1, 0.0, [None]), ("b", 0, 2.0, [2.0]), ("b", 1, 0.0, [None])], "cell string, t int, sm double, layers array<double>")
    read = lambda f: {(r.cell, r.t): r.sm for r in f.collect()}
    assert read(months.repair_last_month(df, 2, ("cell",), raw="layers")) == {("a", 0): 1.0, ("a", 1): 1.0, ("b", 0): 2.0, ("b", 1): 2.0}
    assert read(months.repair_last_month(df, 2, ("cell",)))["a", 1] == 0.0
    assert read(months.repair_last_month(df, 2, ("cell",), mode="always"))["b", 1] == 2.0
    assert months.repair_last_month(df, 2, ("cell",), mode="off") is df
    with pytest.raises(ValueError, match="mode"):
        months.repair_last_month(df, 2, ("cell",), mode="x")


def test_global_means(spark):
    rows = [("m", float(lat), lon, datetime.date(2000 + y, mo, 1), None if lon == 2 else float(mo)) for lat in (-45, 0, 45, 60) for lon in range(3) for y in range(2) for mo in range(1, 13)]
    df = spark.createDataFrame(rows, "model string, lat double, lon int, month date, sm double")
    w = {r.lat: r.w for r in quality_checks.latitude_weights(df).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[0.0] / w[60.0] == pytest.approx(1 / math.cos(math.radians(60)))
    series = quality_checks.global_mean(df, 3)
    assert {r.month.month: r.gm for r in series.collect()}[6] == pytest.approx(6 * 2 / 3)
    assert {r.month: r.clim for r in quality_checks.climatology(series).collect()}[3] == pytest.approx(2.0)
    assert quality_checks.climatology_table(series, ["m"]).count() == 12
    assert quality_checks.report(series).first().line == f"  {'m':16s}: {6.5 * 2 / 3:8.3f}"


def test_registry_and_settings(tmp_path, spark):
    raw = tmp_path / "a.nc"
    raw.touch()
    (tmp_path / "r.yml").write_text(f"paths: {{root: x}}\nmodels:\n  h08: {{obsclim_histsoc: {raw}, counterclim_histsoc: {tmp_path}/none.nc, variable: soilmoist}}\nprocessed:\n  models_1m:\n    h08: {{obsclim_histsoc: {tmp_path}/out/a.nc}}\n")
    r = catalog.Registry.load(str(tmp_path / "r.yml"))
    assert r.raw("h08", "obsclim_histsoc") == str(raw)
    with pytest.raises(FileNotFoundError):
        r.raw("h08", "counterclim_histsoc")
    with pytest.raises(KeyError):
        r.raw("h08", "obsclim_1901soc")
    with pytest.raises(KeyError):
        r.processed("hydropy", "obsclim_histsoc")
    assert r.processed("h08", "obsclim_histsoc") and (tmp_path / "out").is_dir()
    assert r.table(spark).count() == 2 and "variable" in r.list_models()["h08"] and len(r.scenarios()) == 4
    (tmp_path / "bad.yml").write_text("models: {}\n")
    with pytest.raises(KeyError):
        catalog.Registry.load(str(tmp_path / "bad.yml"))
    (tmp_path / "s.yml").write_text("depth_target_m: 2\nssi: {scale_months: 3}\n")
    s = catalog.Settings.load(str(tmp_path / "s.yml"))
    assert s.depth_target_m == 2.0 and s.ssi["scale_months"] == 3 and s.time_resolution == "monthly"
    assert catalog.one_match(["h08_counterclim_x", "h08_obsclim_x"], "h08", "obsclim") == "h08_obsclim_x"
    with pytest.raises(FileNotFoundError):
        catalog.one_match([], "h08", "obsclim")


def classic_file(path, layers, variable="soilmoist", bounds=()):
    """A small classic NetCDF file: time, (depth,) lat, lon; values are 1000 t + 100 k + 10 i + j; one is missing."""
    n_t, n_lat, n_lon = 3, 4, 2
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
    dims = [("time", n_t), ("depth", layers), ("lat", n_lat), ("lon", n_lon)] if layers else [("time", n_t), ("lat", n_lat), ("lon", n_lon)]
    shape = [n for _, n in dims]
    used = list(range(len(dims)))
    dims += [("bnds", 2)] * bool(bounds)
    data = [1000.0 * t + 100 * k + 10 * i + j for t in range(n_t) for k in range(layers or 1) for i in range(n_lat) for j in range(n_lon)]
    data[0] = -9999.0
    fill = name("_FillValue") + struct.pack(">iif", 5, 1, -9999.0)
    own = {n: i for i, (n, _) in enumerate(dims)}
    variables = [
        ("lat", [own["lat"]], b"\0" * 8, 6, struct.pack(">4d", 10, 20, 30, 40)),
        ("lon", [own["lon"]], b"\0" * 8, 6, struct.pack(">2d", 1, 2)),
        ("time", [0], struct.pack(">ii", 12, 2) + text("units", "days since 2001-01-01") + text("calendar", "360_day"), 4, struct.pack(">3i", 14, 59, 75)),
        (variable, used, struct.pack(">ii", 12, 1) + fill, 5, struct.pack(f">{len(data)}f", *data)),
    ]
    if bounds:
        variables.append(("depth_bnds", [own["depth"], own["bnds"]], b"\0" * 8, 6, struct.pack(f">{2 * layers}d", *(x for b in bounds for x in b))))

    def head(begins):
        out = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(name(n) + struct.pack(">i", s) for n, s in dims) + b"\0" * 8
        out += struct.pack(">ii", 11, len(variables))
        for (n, d, attrs, kind, body), begin in zip(variables, begins, strict=True):
            out += name(n) + struct.pack(f">i{len(d)}i", len(d), *d) + attrs + struct.pack(">iii", kind, len(body), begin)
        return out

    begins, at = [], len(head([0] * len(variables)))
    for v in variables:
        begins.append(at)
        at += len(v[4])
    path.write_bytes(head(begins) + b"".join(v[4] for v in variables))
    return shape


@pytest.mark.parametrize("layers", [0, 2])
def test_classic_netcdf(spark, tmp_path, layers):
    classic_file(tmp_path / "x.nc", layers)
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("band", 3).option("months", 2).load(str(tmp_path / "x.nc"))
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert len(rows) == 3 * 4 * 2
    assert sorted({(r.year, r.month) for r in rows}) == [(2001, 1), (2001, 2), (2001, 3)]
    for r in rows:
        want = [1000.0 * r.t + 100 * k + 10 * r.lat_idx + r.lon_idx for k in range(layers or 1)]
        if r.t == r.lat_idx == r.lon_idx == 0:
            want[0] = None
        assert r.layers == want and r.lat == 10.0 * (r.lat_idx + 1) and r.lon == r.lon_idx + 1.0


def test_times_of_other_calendars():
    assert netcdf.months_since("days since 1901-01-01", (0, 59), "noleap") == [(1901, 1), (1901, 3)]
    assert netcdf.months_since("months since 1901-11-01", (0, 2), "standard") == [(1901, 11), (1902, 1)]
    assert netcdf.months_since("hours since 1900-02-28 00:00:00", (24,), "standard") == [(1900, 3)]


def test_harmonize_with_defaults(spark, tmp_path, monkeypatch, capsys):
    """The command without arguments: seven models, four scenarios, each from its own file to its registered place."""
    from loamline.plans import harmonize

    lines, done = ["paths: {root: x}", "models:"], ["processed:", "  models_1m:"]
    for m in harmonize.MODELS:
        variable, layers = "rootmoist" if m == "hydropy" else "soilmoist", {"jules-w2": 4, "miroc-integ-land": 4, "lpjml5-7-10-fire": 3}.get(m, 0)
        bounds = [(0.0, 0.2), (0.2, 1.2), (1.2, 2.0)] if m == "lpjml5-7-10-fire" else ()
        lines.append(f"  {m}:")
        done.append(f"    {m}:")
        for s in catalog.SCENARIOS:
            classic_file(tmp_path / f"{m}_{s}.nc", layers, variable, bounds)
            lines.append(f"    {s}: {tmp_path}/{m}_{s}.nc")
            done.append(f"      {s}: {tmp_path}/out/{m}/{s}_1m.nc")
        lines.append(f"    variable: {variable}")
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "data_registry.yml").write_text("\n".join(lines + done) + "\n")
    (tmp_path / "configs" / "settings.yml").write_text("depth_target_m: 0.7\n")
    monkeypatch.chdir(tmp_path)
    harmonize.main(["--table", str(tmp_path / "table")], spark)
    assert capsys.readouterr().out.count("wrote ") == 28
    registry = catalog.Registry.load("configs/data_registry.yml")
    got = {(r.model, r.climate, r.soc, r.t, r.lat_idx, r.lon_idx): r for r in harmonize.read_harmonized(spark, list(harmonize.MODELS), registry).collect()}
    assert len(got) == 28 * 24 and {str(r.month) for r in got.values()} == {"2001-01-01", "2001-02-01", "2001-03-01"}
    for (m, _, _, t, i, j), r in got.items():
        x = [1000.0 * t + 100 * k + 10 * i + j for k in range(4)]
        first = t == i == j == 0
        if m in ("jules-w2", "miroc-integ-land"):
            want = sum(x[:3]) - (x[0] if first else 0)
        elif m == "lpjml5-7-10-fire":  # the target depth of the settings
            want = x[0] * (not first) + x[1] * 0.5
        else:
            want = None if first else x[0]
        assert r.sm == (None if want is None else pytest.approx(want)) and (r.lat, r.lon) == (10.0 * (i + 1), j + 1.0)
    assert grids.read_soil(spark, str(tmp_path / "table")).count() == len(got)
    file = netcdf.open_file(str(tmp_path / "out" / "h08" / "obsclim_histsoc_1m.nc"))
    about = file.attributes("soilmoist_1m")
    assert (about["units"], about["model"], about["scenario"]) == ("kg m-2", "h08", "obsclim_histsoc") and about["_FillValue"] == (-9999.0,) and about["target_depth_m"][0] == pytest.approx(0.7)
    with pytest.raises(KeyError):
        harmonize.harmonize_all(spark, ["none"], registry)


def test_layer_bounds_are_needed(spark, tmp_path):
    from loamline.plans.harmonize import harmonized

    classic_file(tmp_path / "l.nc", 2)
    registry = catalog.Registry({"root": "x"}, {"lpjml5-7-10-fire": {"obsclim_histsoc": str(tmp_path / "l.nc")}})
    with pytest.raises(KeyError, match="bounds"):
        harmonized(spark, "lpjml5-7-10-fire", "obsclim_histsoc", registry)


def test_series_with_missing_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 1.5), (1, 1, 1, None)], "lat_idx int, lon_idx int, t int, sm double")
    path = netcdf.write_series(df, str(tmp_path / "s.nc"), [1.0, 2.0, 3.0], [5.0, 6.0], [(1901, 1), (1901, 2)], "v", {"units": "x"})
    netcdf.register(spark)
    rows = spark.read.format("netcdf").option("variable", "v").load(path).collect()
    assert {(r.t, r.lat_idx, r.lon_idx): r.layers[0] for r in rows if r.layers[0] is not None} == {(0, 1, 0): 1.5} and len(rows) == 12
    assert [p.name for p in tmp_path.iterdir()] == ["s.nc"]


def test_land(spark, tmp_path):
    from loamline.sources.land import FRACTIONS, read_land

    own = {}
    for k, v in enumerate([*FRACTIONS.values()]):
        own[v] = np.arange(12.0).reshape(2, 3, 2) + 100 * k
    dims = {"time": 2, "lat": 3, "lon": 2}
    coords = [("time", ["time"], {"units": "days since 1901-01-01"}, "d"), ("lat", ["lat"], {}, "d"), ("lon", ["lon"], {}, "d")]

    def write(name, variables, over):
        head, begins = netcdf.classic_header(dims, coords + [(v, over, {}, "d") for v in variables])
        data = [np.array([0.0, 365.0]), np.arange(3.0), np.arange(2.0), *variables.values()]
        (tmp_path / name).write_bytes(head + b"".join(x.astype(">f8").tobytes() for x in data))
        return str(tmp_path / name)

    fractions = write("f.nc", own, ["time", "lat", "lon"])
    roots = {k: write(f"{k}.nc", {"maxRootDepth": np.arange(6.0).reshape(3, 2) + i}, ["lat", "lon"]) for i, k in enumerate(("forest", "grass", "paddy", "nonpaddy"))}
    stores = tuple(write(f"s{i}.nc", {v: np.arange(6.0).reshape(3, 2) * 10}, ["lat", "lon"]) for i, v in enumerate(("firstStorDepth", "secondStorDepth")))
    cover, soil = read_land(spark, fractions, roots, stores)
    assert cover.count() == 12 and soil.count() == 6
    c, s = cover.filter("year_idx = 1 AND lat_idx = 2 AND lon_idx = 1").first(), soil.filter("lat_idx = 2 AND lon_idx = 1").first()
    assert (c.f_forest, c.f_grass, c.f_paddy, c.f_nonpaddy) == (11.0, 111.0, 211.0, 311.0)
    assert (s.root_forest, s.root_nonpaddy, s.store1, s.store2) == (5.0, 8.0, 50.0, 50.0)


def test_classes_from_a_workbook(spark, tmp_path):
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><v>1</v></c><c r="C2"><v>30</v></c></row><row r="3"><c r="B3"><v>-9999</v></c><c r="AB3" t="s"><v>4</v></c></row>'
    with zipfile.ZipFile(tmp_path / "k.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="other" sheetId="1" r:id="r1"/><sheet name="map" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    got = {(r.lat_idx, r.lon_idx): r["class"] for r in grids.read_classes(spark, str(tmp_path / "k.xlsx")).collect()}
    assert got == {(0, 0): 1, (0, 1): 30, (1, 0): None, (1, 1): None}


def test_grids(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1,30\n-9999,\n")
    got = {(r.lat_idx, r.lon_idx): r["class"] for r in grids.read_classes(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {(0, 0): 1, (0, 1): 30, (1, 0): None, (1, 1): None}
    df = spark.createDataFrame([(0, 0, 1.5), (1, 1, 2.0)], "lat_idx int, lon_idx int, v double")
    grids.write_ascii(df, "v", str(tmp_path / "g"), 2, 2, decimals=1)
    text = "".join(p.read_text() for p in (tmp_path / "g").glob("part-*"))
    assert text.splitlines()[0] == "ncols 2" and text.splitlines()[-2:] == ["-9999 2.0", "1.5 -9999"]
    assert grids.dense(df, "v", 2, 2).filter("v IS NULL").count() == 2


def test_maps(spark, tmp_path):
    df = spark.createDataFrame([("a", "EI", 0, 0, 1.0, 2.0), ("a", "EI", 1, 1, 3.0, None), ("b", "RP", 0, 1, 4.0, 5.0)], "model string, period string, lat_idx int, lon_idx int, d double, m double")
    grids.write_maps(df, ("d", "m"), str(tmp_path / "maps"), 2, 2, ("model", "period"), decimals=0, no_data="x")
    read = lambda name: "".join(p.read_text() for p in (tmp_path / "maps" / f"map={name}").glob("part-*")).splitlines()
    assert len(list((tmp_path / "maps").glob("map=*"))) == 4
    assert read("a_EI_d")[0] == "ncols 2" and read("a_EI_d")[5:] == ["NODATA_value x", "x 3", "1 x"]
    assert read("b_RP_m")[-2:] == ["x x", "x 5"]


def test_assertion_on_missing_index(spark):
    from loamline.operators import ssi
    from loamline.params import Params

    p = Params(months=24, slice_months=12, plot_a=10.0)
    rows = [("m", 0, 0, s, t, s * 24 + t, float(t)) for s in range(4) for t in range(24)]
    df = spark.createDataFrame(rows, "model string, lat_idx int, lon_idx int, scn int, t int, g int, x double")
    with pytest.raises(PySparkException, match="index is missing"):
        ssi.score(df, p, check=True).collect()


def test_months_that_arrive(spark, tmp_path):
    import random

    from loamline.params import Params
    from loamline.plans.attribution import metrics
    from loamline.streaming.rescore import SCHEMA, SeriesStore, rescore

    p, rnd = Params(months=24, slice_months=12), random.Random(3)
    rows = [("m", 0, c, climate, soc, t, round(rnd.random() * 9, 1)) for c in range(2) for climate, soc in p.pool for t in range(24)]
    early, late = [r for r in rows if r[5] < 20 or r[2] == 0], [r for r in rows if r[5] >= 20 and r[2] == 1]
    store, results = SeriesStore(spark, str(tmp_path / "store"), 8), []
    source = tmp_path / "in"
    batch = rescore(store, lambda df: results.append(df.collect()), p)
    for part in (early, late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        q = spark.readStream.schema(SCHEMA).parquet(str(source)).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    want = sorted(metrics(spark.createDataFrame(rows, SCHEMA), p).collect())
    assert sorted(results[-1]) == [r for r in want if r.lon_idx == 1]
    versions = store.versions()
    assert sorted(versions.values()) == [0, 1] and sorted(map(tuple, store.read().collect())) == sorted(rows)  # the other cell's bucket wasn't written again
    batch(spark.createDataFrame(late, SCHEMA), 1)  # delivered again
    assert results[-1] == results[-2] or sorted(results[-1]) == sorted(results[-2])
    (tmp_path / "store" / "batch=9" / "bucket=0").mkdir(parents=True)  # a version that wasn't finished
    assert store.versions() == versions
