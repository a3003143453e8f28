"""Operators that SQL cannot express, against plain numpy or known results; edge cases of the others."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalassa.functions import angles, arrays, times
from thalassa.operators import acoustics, doppler, flow, loads, quality, series, spectral, wave


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def arr(x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_welch_keeps_the_variance_and_finds_a_sine(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4096)
    t = np.arange(1024) / 16
    d = spark.createDataFrame([(x.tolist(),), ((3 * np.sin(2 * np.pi * 2 * t)).tolist(),), (None,), ([1.0],)], "x array<double>")
    got = [r.s for r in d.select(spectral.welch(F.col("x"), 16.0, 256).alias("s")).collect()]
    f = np.array(spectral.frequencies(16.0, 256))
    assert np.sum(got[0]) * f[1] == pytest.approx(x.var(), rel=0.05)
    assert f[int(np.argmax(got[1]))] == 2 and np.sum(got[1]) * f[1] == pytest.approx(4.5, rel=0.02)
    assert got[2] is None and got[3] is None


def test_instantaneous_frequency_of_a_tone(spark):
    t = np.arange(400) / 100
    r = one(spark, spectral.instantaneous_frequency(arr(np.cos(2 * np.pi * 5 * t)), arr(t)))
    assert np.allclose(r.c0[20:-20], 5, atol=1e-3) and len(r.c0) == 399


@pytest.mark.parametrize("grid", [50, 60])
def test_harmonics_of_a_tone(spark, grid):
    t = np.arange(20000) / 20000
    x = 2 * np.sin(2 * np.pi * grid * t) + 0.5 * np.sin(2 * np.pi * 5 * grid * t)
    d = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    h = d.select(spectral.harmonics(F.col("x"), 20000.0, grid).alias("h"))
    r = h.select("h", spectral.harmonic_subgroups(F.col("h"), grid).alias("g"), spectral.total_harmonic_distortion(spectral.harmonic_subgroups(F.col("h"), grid)).alias("t")).first()
    assert r.h[grid // 5] == pytest.approx(2) and r.g[5] == pytest.approx(0.5) and r.t == pytest.approx(25)
    assert len(r.h) == {60: 612, 50: 514}[grid]


def test_windows_overlap_and_drop_the_tail(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(11)], "k string, t int, x double")
    got = {r.block: r.x for r in spectral.windows(d, ["k"], "t", ["x"], 4, 2).collect()}
    assert got == {b: [float(b * 2 + i) for i in range(4)] for b in range(4)}


def test_rainflow():
    # one large cycle with a small one inside, the levels being 256 of the range
    x = np.array([0, 10, 4, 6, 0, 10, 0.0])
    r = sorted(loads.rainflow_ranges(x))
    assert np.allclose(r, [2, 10, 10], atol=0.1)
    assert len(loads.rainflow_ranges(np.ones(9))) == 0


def test_damage_equivalent_load_of_one_amplitude(spark):
    x = np.tile([0.0, 8.0], 300)
    r = one(spark, loads.damage_equivalent_load(arr(x), 4, length=600))
    # 300 cycles of range 8 in 600 cycles, counted in cells of 1 %
    assert r.c0 == pytest.approx(8 * (300 / 600) ** 0.25, rel=0.02)


def test_fits_find_their_distribution():
    rng = np.random.default_rng(1)
    assert np.allclose(loads.fit_weibull(2.5 * rng.weibull(1.7, 20000)), (1.7, 2.5), rtol=0.03)
    assert np.allclose(loads.fit_gumbel(rng.gumbel(10, 2, 20000)), (10, 2), rtol=0.03)
    u = rng.random(20000)
    c, loc, scale = loads.fit_gev(10 + 2 * (1 - (-np.log(u)) ** 0.2) / 0.2)
    assert np.allclose((c, loc, scale), (0.2, 10, 2), rtol=0.06)
    c, scale = loads.fit_pareto(3 * ((1 - u) ** -0.15 - 1) / 0.15)
    assert c == pytest.approx(0.15, abs=0.03) and scale == pytest.approx(3, rel=0.05)


def test_distribution_functions_invert(spark):
    p, v = F.lit(0.37), lambda x: F.lit(float(x))
    r = one(
        spark, loads.weibull_cdf(loads.weibull_ppf(p, v(1.7), v(2)), v(1.7), v(2)), loads.gumbel_cdf(loads.gumbel_ppf(p, v(3), v(2)), v(3), v(2)), *[loads.gev_cdf(loads.gev_ppf(p, v(c), v(3), v(2)), v(c), v(3), v(2)) for c in (-0.2, 0.0, 0.2)]
    )
    assert all(x == pytest.approx(0.37) for x in r)


def test_fits_side_by_side_are_those_of_each_row():
    """Series are fitted together, each with the steps it would take alone."""
    rng = np.random.default_rng(11)
    x = np.abs(rng.normal(size=(60, 40)) * rng.uniform(0.1, 30, (60, 1))) + 0.001
    for together in (loads.fit_gumbels, loads.fit_gevs, loads.fit_weibulls, loads.fit_paretos, loads.fit_tails):
        assert np.array_equal(together(x), np.concatenate([together(v[None]) for v in x]))
    calls = []
    start = rng.normal(size=(200, 2))
    got = loads.nelder_meads(lambda p, rows: calls.append(len(p)) or ((p - start[rows] - 1) ** 2).sum(1), start)
    assert np.allclose(got, start + 1, atol=1e-5) and len(calls) < 1000
    alone = loads.nelder_mead(lambda q: float(((q - start[7] - 1) ** 2).sum()), start[7])
    assert np.array_equal(alone, got[7])


def test_fits_of_short_series(spark):
    d = spark.createDataFrame([([],), (None,), ([1.0],), ([2.0, 2.0],)], "x array<double>")
    assert all(r.g.loc is None for r in d.select(loads.gumbel_of(F.col("x")).alias("g")).collect())


def test_peaks_over_threshold_and_tail(spark):
    rng = np.random.default_rng(2)
    x = 2 * rng.weibull(1.5, 4000)
    d = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    r = d.select(loads.over_threshold_of(F.col("x")).alias("o"), loads.weibull_tail_of(F.col("x")).alias("t"))
    r = r.select("*", loads.over_threshold_cdf(F.lit(5.0), F.col("o")).alias("p"), loads.over_threshold_cdf(F.lit(0.1), F.col("o")).alias("low")).first()
    assert r.p == pytest.approx((x < 5).mean(), abs=0.01) and r.low is None
    assert r.t.shape == pytest.approx(1.5, rel=0.1) and r.t.scale == pytest.approx(2, rel=0.1)


def test_storms_and_automatic_threshold():
    rng = np.random.default_rng(3)
    hours = np.arange(20 * 8766) / 1.0
    x = np.abs(np.convolve(rng.gumbel(2, 1, len(hours)), np.ones(24) / 24, "same")) + 0.3 * np.sin(hours / 8766 * 2 * np.pi)
    assert loads.hazen(np.arange(1.0, 11), 0.5) == 5.5
    assert 5 < loads.window_size(x, 1.0) < 24 * 14
    storms = loads.storm_peaks(x, 0.99, 1.0)
    assert 20 < len(storms) < 20 * 60 and storms.min() > 0
    share, value = loads.automatic_threshold(x, 1.0)
    assert 0.98 < share < 1 and value == pytest.approx(loads.hazen(x, share))


def test_ellipsoid_finds_spikes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2000)
    at = np.arange(100, 2000, 250)
    x[at] += 15
    r = one(spark, doppler.despike_gn(arr(x)))
    found = np.flatnonzero(r.c0)
    assert set(at) <= set(found) and len(found) < 60


def test_zero_phase_filter_keeps_slow_and_drops_fast():
    t = np.arange(4000) / 100
    slow, fast = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 20 * t)
    y = doppler.zero_phase_low_pass(slow + fast, 1 / 50)
    assert np.abs(y - slow)[200:-200].max() < 0.02
    assert np.allclose(doppler.zero_phase_low_pass(np.full(50, 3.0), 0.1), 3)


def test_integral_te01_without_mean_flow_angle(spark):
    r = one(spark, doppler.integral_te01(F.lit(0.4), F.lit(0.3)))
    x = np.arange(-20, 20, 0.01)
    y = np.cbrt(x**2 - 2 / 0.4 * math.cos(0.3) * x + 0.4**-2) * np.exp(-x * x / 2)
    assert r.c0 == pytest.approx(np.trapezoid(y, x) / math.sqrt(2 * math.pi) * 0.4 ** (2 / 3))


def test_orientation_matrices(spark):
    m = angles.orientation(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert [list(one(spark, *row)) for row in m] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    east = angles.dot(angles.orientation(F.lit(90.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert np.allclose(one(spark, *east), [1, 0, 0])
    q = angles.of_quaternion(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])
    assert np.allclose([list(one(spark, *r)) for r in q], np.eye(3))
    assert one(spark, angles.gimbal(F.lit(20.0), F.lit(60.0))).c0 == pytest.approx(math.degrees(math.atan(math.tan(math.radians(20)) * 0.5)))


def test_moments_skip_zero_frequency(spark):
    f, s = arr([0, 0.1, 0.3, 0.4]), arr([9, 1, 2, float("nan")])
    # the first width is that of the second frequency above 0
    assert one(spark, wave.moment(0, f, s)).c0 == pytest.approx(1 * 0.2 + 2 * 0.2)
    assert one(spark, wave.moment(1, f, s, arr([1, 1, 2, 1]))).c0 == pytest.approx(0.1 + 0.3 * 2 * 2)
    assert one(spark, wave.moment(0, arr([0.0]), arr([1.0]))).c0 == 0


def test_surface_has_the_variance_of_its_spectrum(spark):
    f = np.arange(1, 65) / 100
    s = np.exp(-(((f - 0.2) / 0.05) ** 2))
    phase = np.random.default_rng(5).random(64) * 2 * np.pi
    t = spark.range(2000).select((F.col("id") * 0.05).alias("t"))
    r = t.select(wave.surface_elevation(F.col("t"), arr(f), arr(s), arr(phase)).alias("e")).agg(F.var_pop("e").alias("v")).first()
    assert r.v == pytest.approx(s.sum() * 0.01, rel=0.02)


def test_arrays(spark):
    x, y = arr([0, 1, 3]), arr([0, 2, 2])
    r = one(spark, arrays.trapezoid(x, y), arrays.interpolate(F.lit(2.0), x, y), arrays.interpolate(F.lit(3.5), x, y), arrays.slope(x, y), arrays.argmax(x, y), arrays.trapezoid(arr([1]), arr([5])))
    assert (r.c0, r.c1, r.c2, r.c4, r.c5) == (5, 2, None, 1, 0) and r.c3 == pytest.approx(np.polyfit([0, 1, 3], [0, 2, 2], 1)[0])


def test_times(spark):
    r = one(spark, times.matlab_to_datetime(F.lit(730000.5)), times.excel_to_datetime(F.lit(43831.25)), times.full_year(F.lit(89)), times.full_year(F.lit(90)), times.full_year(F.lit(2004)), times.of_fields(*[F.lit(v) for v in (2020, 0, 0, 0, 0, 0, 0)]), times.of_bcd(F.lit(0x59)))
    assert (r.c0.isoformat(), r.c1.isoformat()) == ("1998-09-02T12:00:00", "2020-01-01T06:00:00")
    assert (r.c2, r.c3, r.c4, r.c5, r.c6) == (2089, 1990, 2004, None, 59)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, ts timestamp_ntz, x double")
    for d in (
        series.waves(e, ["k"], "ts", "x"), series.global_peaks(e, ["k"], "ts", "x"), series.fill_gaps(e, ["k"], "ts", "x"), series.block_statistics(e, ["k"], "ts", "x", 3), quality.check_delta(e, ["k"], "ts", "x", 1, 2, 60),
        flow.exceedance_probability(e, "x"), flow.principal_flow_directions(e, "x", 10).where("direction1 IS NOT NULL"), doppler.turbulence(e, ["k"], "x", "x", "x", "x"), spectral.windows(e, ["k"], "ts", ["x"], 4),
    ):
        assert d.count() == 0


def test_upcrossings_of_an_exact_zero(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([-1.0, 0.0, 1.0, -1.0, 2.0])], "k string, ts int, x double")
    assert [r.up for r in series.upcrossings(d, ["k"], "ts", "x").orderBy("ts").collect()] == [True, True, False, True, False]


def test_exceedance_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "i int, x double")
    assert {r.i: r.f for r in flow.exceedance_probability(d, "x").collect()} == {1: 62.5, 2: 62.5, 3: 25.0, 4: None}


def test_slices_cover_the_rotor():
    assert sum(a for _, a in flow.circular_slices(4.0, 5.0, 0.5)) == pytest.approx(math.pi * 4)
    assert sum(a for _, a in flow.rectangular_slices(2.0, 3.0, 5.0, 0.5)) == pytest.approx(6)


def test_bands():
    b = acoustics.frequency_bands(3, 2, 10, 1000)
    assert b[0][1] == pytest.approx(10) and all(x[2] == pytest.approx(y[0]) for x, y in zip(b, b[1:]))
    with pytest.raises(ValueError):
        acoustics.aggregate(F.lit(1), "nothing")


def test_spline_of_a_cubic_and_gaps(spark):
    x = np.array([0.0, 1, 2, 4, 7, 8])
    f = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    assert np.allclose(doppler.spline(x, f(x), np.array([3.0, 5, 6])), f(np.array([3.0, 5, 6])))
    assert np.allclose(doppler.spline(x[:2], x[:2] * 2, np.array([0.5])), [1])
    v = [float(f(t)) if t not in (3, 5, 6, 0) else float("nan") for t in range(9)]
    r = one(spark, doppler.fill_cubic(arr(v), most=1)).c0
    lost = lambda v: v is None or math.isnan(v)
    assert lost(r[0]) and r[3] == pytest.approx(f(3)) and r[5] == pytest.approx(f(5)) and lost(r[6])


def test_rotations_there_and_back(spark):
    m = angles.orientation(F.lit(33.0), F.lit(-5.0), F.lit(12.0))
    v = (F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    beam = ((1.0, 2.0, 0.0), (0.0, 1.0, -1.0), (1.0, 0.0, 1.0))
    way = doppler.rotated(v, "beam", "principal", beam=beam, orient=m, heading=F.lit(70.0))
    back = doppler.rotated(way, "principal", "beam", beam=beam, orient=m, heading=F.lit(70.0))
    assert np.allclose(one(spark, *back), [1, -2, 0.5])
    with pytest.raises(ValueError):
        doppler.rotated(v, "beam", "ship")


def test_nearest_points_without_neighbours(spark):
    from thalassa.operators import grids

    d = spark.createDataFrame([(0.0, 0.0, "a"), (1.0, 0.0, "b")], "x double, y double, v string")
    w = spark.createDataFrame([(0.4, 0.0), (0.6, 0.1), (9.0, 9.0)], "x double, y double")
    assert sorted(((r.x, r.v) for r in grids.to_nearest_points(d, w, ["x", "y"], 1.0).collect()), key=str) == [(0.4, "a"), (0.6, "b"), (9.0, None)]


def test_nearest_points_in_lists(spark, monkeypatch):
    """Rows meet lists of points, not points: brute force over crowded cells, with ties, missing and far places."""
    from thalassa.operators import grids

    monkeypatch.setattr(grids, "LIST", 4)
    rng = np.random.default_rng(5)
    points = [(float(x), float(y)) for x, y in {(int(a), int(b)) for a, b in rng.integers(-8, 9, (150, 2))}]
    places = [(float(x), float(y)) for x, y in rng.integers(-12, 13, (80, 2)) / 2] + [(None, 0.0), (float("nan"), 0.0), (50.0, 0.0)]
    d = spark.createDataFrame([(x, y, f"{x},{y}") for x, y in points], "x double, y double, v string").repartition(3)
    w = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "i int, x double, y double")
    got = {r.i: r.v for r in grids.to_nearest_points(d, w, ["x", "y"], 3.0).collect()}
    for i, (x, y) in enumerate(places):
        near = [((x - a) ** 2 + (y - b) ** 2, a, b) for a, b in points if x is not None and abs(x - a) <= 3 and abs(y - b) <= 3]
        assert got[i] == (f"{min(near)[1]},{min(near)[2]}" if near else None)
    plan = grids.to_nearest_points(d, w, ["x", "y"], 3.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("collect_list") < plan.index("explode")
    assert len(got) == len(places)


def test_harmonics_of_many_rows_come_in_slices(spark):
    """What a batch gives is ten times as long as the batch: it is yielded in slices of its rows."""
    import pandas as pd

    inner, real = [], F.pandas_udf
    F.pandas_udf = lambda kind: lambda f: inner.append(f) or (lambda *a: None)
    try:
        spectral.harmonics(F.col("x"), 6400.0, 60)
    finally:
        F.pandas_udf = real
    rows = np.random.default_rng(6).normal(size=(1000, 64))
    parts = list(inner[0](iter([pd.Series(list(rows)), pd.Series([None, rows[0]])])))
    assert max(len(p) for p in parts) <= 256 and sum(len(p) for p in parts) == 1002
    assert parts[-1][0] is None and np.array_equal(parts[-1][1], parts[0][0])


def test_quantiles_of_uneven_groups(spark):
    from thalassa.operators.quantiles import quantiles

    rng = np.random.default_rng(8)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 3000)] + [("b", float(x)) for x in rng.normal(size=11)] + [(None, 2.0), ("c", None), ("a", float("nan"))]
    d = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {r.k: (r.p10, r.p50, r.p99) for r in quantiles(d, ["k"], "x", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    want = {k: np.quantile([x for j, x in rows if j == k and x == x and x is not None], [0.1, 0.5, 0.99]) for k in ("a", "b", None)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_surface_record(spark):
    """Inverse transform, sums of uneven frequencies, seeded phases, and rows without a record."""
    from thalassa.operators import wave

    rng = np.random.default_rng(3)
    rows = []
    for i, m in enumerate((33, 33, 20, 20)):
        f = np.arange(m) * 0.01 if i % 2 == 0 else np.sort(rng.random(m)) * 0.3 + 0.01
        rows.append((i, f.tolist(), (rng.random(m) * (f > 0)).tolist()))
    rows += [(10, None, [1.0]), (11, [0.0], [1.0]), (12, [0.0, 0.1], [1.0]), (13, [0.0, 0.1, 0.2], [None, None, None])]
    d = spark.createDataFrame(rows, "k int, f array<double>, s array<double>").withColumn("p", wave.seeded_phases(F.col("f"), 5, F.col("k")))
    got = {r.k: r for r in d.withColumn("eta", wave.surface_record(F.col("f"), F.col("s"), F.col("p"), 64)).collect()}
    for k, f, s in rows[:4]:
        f, s, p = np.array(f), np.array(s), np.array(got[k].p)
        t = np.arange(64) / (64 * (f[1] - f[0]))
        assert np.allclose(got[k].eta, (np.sqrt(2 * s * (f[1] - f[0])) * np.cos(2 * np.pi * t[:, None] * f + p) * np.where(f * 64 == (f[1] - f[0]) * 64 * 32, 0.5, 1)).sum(1), atol=1e-9)
        assert len(set(p)) == len(p) and (0 <= p).all() and (p < 2 * np.pi).all()
    assert [got[k].eta for k in (10, 11, 12)] == [None] * 3 and got[13].eta == [0.0] * 64
    assert got[0].p != got[1].p and d.where("k = 0").first().p == got[0].p


def test_integral_te01_of_many_rows_takes_little_memory(spark):
    """A batch is worked off in slices: 10,000 rows of 4,000 numbers at once took a gigabyte."""
    import tracemalloc

    import pandas as pd

    of = doppler.integral_te01
    ratio, angle = 0.3 + np.arange(10_000) % 10 / 20, np.radians(np.arange(10_000) % 90)
    d = spark.createDataFrame(pd.DataFrame({"i": ratio[:300], "t": angle[:300]})).coalesce(1)
    x = np.arange(-20, 20, 0.01)
    got = [r.v for r in d.select(of(F.col("i"), F.col("t")).alias("v")).collect()]
    for k in (0, 127, 128, 299):
        y = np.cbrt(x**2 - 2 / ratio[k] * np.cos(angle[k]) * x + ratio[k] ** -2.0) * np.exp(-0.5 * x**2)
        assert math.isclose(got[k], np.trapezoid(y, x) * (2 * np.pi) ** -0.5 * ratio[k] ** (2 / 3), rel_tol=1e-12)
    inner, real = [], F.pandas_udf
    F.pandas_udf = lambda kind: lambda f: inner.append(f) or (lambda *a: None)
    try:
        of(F.col("i"), F.col("t"))
    finally:
        F.pandas_udf = real
    tracemalloc.start()
    inner[0](pd.Series(ratio), pd.Series(angle))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
