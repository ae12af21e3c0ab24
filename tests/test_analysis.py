import random

import pytest
from literal import index, metrics, run_theory

from loamline.operators import ensemble, events, ssi
from loamline.params import METRICS, Params

P = Params(months=48, slice_months=24)


def soil_rows(spark, cells, p):
    """cells: {cell number: [4 series]}"""
    rows = [("m", 0, c, s, t, s * p.months + t, x) for c, series in cells.items() for s, xs in enumerate(series) for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "model string, lat_idx int, lon_idx int, scn int, t int, g int, x double")


def random_cells(seed, decimals, n=8):
    rnd = random.Random(seed)
    return {c: [[round(rnd.uniform(0, 9) if rnd.random() < 0.7 else rnd.uniform(0, 2), decimals) for _ in range(P.months)] for _ in range(4)] for c in range(n)}


@pytest.mark.parametrize(("seed", "decimals"), [(1, 0), (2, 1)])
def test_one_sort_equals_eight_literal_runs(spark, seed, decimals):
    cells = random_cells(seed, decimals)
    cells[100] = [[0.0] * P.months for _ in range(4)]
    cells[101] = [s[:] for s in cells[0]]
    cells[101][2][5] = None
    cells[102] = [s[:] for s in cells[1]]
    cells[102][1][7] = -1.0
    cells[103] = [s[:] for s in cells[1]]
    cells[103][0][0] = None
    df = soil_rows(spark, cells, P)
    scored = ssi.score(df, P, check=True)
    got = {(r.lon_idx, r.slice, r.t): r.z for r in scored.collect()}
    means = {(r.lon_idx, r.slice): tuple(r[m] for m in METRICS) for r in events.cell_metrics(scored, P).collect()}
    for c, series in cells.items():
        pool = [x for s in series for x in s]
        for s in P.slices():
            part = series[s.scenario][s.t0 : s.t0 + P.slice_months]
            z = index(pool, part) if c < 100 else None
            for t in range(P.slice_months):
                want = z[t] if z else None
                assert (got.get((c, s.number, t)) is None) == (want is None)
                if want is not None:
                    assert got[c, s.number, t] == pytest.approx(want, abs=1e-9)
            want = metrics(pool, part) if c < 100 else None
            assert (means.get((c, s.number)) is None) == (want is None)
            if want:
                assert means[c, s.number] == pytest.approx(want, abs=1e-9)


def test_sizes_of_the_full_series(spark):
    p = Params()
    rnd = random.Random(5)
    df = soil_rows(spark, {0: [[rnd.random() for _ in range(p.months)] for _ in range(4)]}, p)
    rows = ssi.ranks(df, p, p.slices()[:1]).collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, []).append(r.n)
    assert {k: set(v) for k, v in by.items()} == {k: {506 if k < 10 else 505} for k in range(12)}
    assert {k: len(v) for k, v in by.items()} == {k: 30 if k < 10 else 29 for k in range(12)}


def test_one_shuffle_for_the_whole_scoring(spark):
    df = soil_rows(spark, random_cells(1, 0, 2), P).repartition("model", "lat_idx", "lon_idx")
    plan = events.cell_metrics(ssi.score(df, P), P)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


SERIES = {
    "gap5": [-1.5, -1.2] + [0.5] * 5 + [-1.1] * 3 + [2.0] * 4,
    "gap6": [-1.5, -1.2] + [0.5] * 6 + [-1.1] * 3 + [2.0] * 4,
    "bounds": [-1.5, 0.0, 1.0, -0.2, 1.1, -0.9, -0.9, 1.2, -1.0],
    "beside_wet": [2.0, 0.4, 2.0, -1.3, 0.2, 2.0],
    "ends": [-1.2, -0.1, 3.0, 3.0, -0.1, -2.0],
    "ties": [-1.5, -2.0, -2.0, -1.0],
    "only_minus_one": [-1.0, 2.0, -1.0],
    "none": [0.5, 2.0, 3.0],
}


def test_run_theory_edges(spark):
    rows = [("m", 0, i, 0, t, z) for i, s in enumerate(SERIES.values()) for t, z in enumerate(s)]
    df = spark.createDataFrame(rows, "model string, lat_idx int, lon_idx int, slice int, t int, z double")
    got = {}
    for r in events.events(df, P).orderBy("lon_idx", "t0").collect():
        got.setdefault(r.lon_idx, []).append((r.d, r.m, r.pi, r.ddd, r.drd))
        assert r.d >= 1 and 1 <= r.ddd <= r.d and r.drd == r.d - r.ddd and r.m == pytest.approx(r.pi * r.d)
    for i, s in enumerate(SERIES.values()):
        want = run_theory(s)
        assert len(got.get(i, [])) == len(want)
        for a, b in zip(got.get(i, []), want, strict=True):
            assert a == pytest.approx(b, abs=1e-12)
    passed = {r.lon_idx for r in events.gated(df, P).select("lon_idx").distinct().collect()}
    assert list(SERIES).index("only_minus_one") not in passed


def test_quorum_and_masks(spark):
    rows = []
    for lon, models in ((0, 2), (1, 3), (2, 4)):
        for climate in ("obsclim", "counterclim"):
            for soc in ("histsoc", "1901soc"):
                for period in ("EI", "RP"):
                    for m in range(6):
                        v = float(m + 1 + (10 if climate == "obsclim" else 0)) if m < models else None
                        rows.append((f"m{m}", climate, soc, period, 0, lon, v, v, v, v, v))
    df = spark.createDataFrame(rows, "model string, climate string, soc string, period string, lat_idx int, lon_idx int, d double, m double, pi double, ddd double, drd double")
    classes = spark.createDataFrame([(0, 0, 29), (0, 2, 30)], "lat_idx int, lon_idx int, class int")
    masked = ensemble.apply_masks(df, classes, P)
    pick = lambda f, **k: f.filter(" AND ".join(f"{a} = {b!r}" for a, b in k.items())).collect()
    assert pick(masked, model="m0", climate="obsclim", soc="histsoc", period="EI", lon_idx=0)[0].d == 0.0
    assert pick(masked, model="m5", climate="obsclim", soc="histsoc", period="EI", lon_idx=0)[0].d is None
    assert pick(masked, model="m0", climate="obsclim", soc="histsoc", period="EI", lon_idx=1)[0].d == 11.0
    assert pick(masked, model="m0", climate="obsclim", soc="histsoc", period="EI", lon_idx=2)[0].d is None
    assert pick(masked, model="m0", climate="counterclim", soc="1901soc", period="EI", lon_idx=0)[0].d == 1.0
    assert pick(ensemble.apply_masks(df, classes, P, mask_all=True), model="m0", climate="counterclim", soc="1901soc", period="EI", lon_idx=0)[0].d == 0.0
    medians = ensemble.ensemble_medians(masked)
    assert pick(medians, climate="obsclim", soc="histsoc", period="RP", lon_idx=1)[0].d == 12.0
    diffs = ensemble.median_differences(masked)
    assert pick(diffs, name="factual_RP_histsoc-counterfact_RP_histsoc", lon_idx=1)[0].d == 10.0
    assert pick(diffs, name="counterfact_RP_histsoc-counterfact_EI_1901soc", lon_idx=0)[0].d == -1.5


def test_params_are_checked():
    with pytest.raises(ValueError, match="whole years"):
        Params(months=50)
    with pytest.raises(ValueError, match="slice"):
        Params(months=48, slice_months=60)
