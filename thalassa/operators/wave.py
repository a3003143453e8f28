"""Wave spectra and sea-state metrics. A spectrum is a row with arrays `f` (Hz, ascending) and `s` (m^2/Hz)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalassa.functions import arrays
from thalassa.operators.quantiles import quantiles

G, RHO = 9.80665, 1025.0


def widths(f: Column) -> Column:
    """Backward differences of an array of frequencies; the first is the second's. One frequency alone has no width."""
    return F.transform(f, lambda v, i: F.when(i == 0, F.get(f, F.lit(1)) - v).otherwise(v - F.get(f, i - 1)))


def moment(n: int, f: str | Column = "f", s: str | Column = "s", width: Column | None = None) -> Column:
    """Sum of s f^n df over the frequencies above 0, df their backward differences or the given widths.

    Missing values of s count as nothing; without frequencies above 0 the moment is 0.
    """
    f, s = (F.col(c) if isinstance(c, str) else c for c in (f, s))
    zipped = F.zip_with(f, s, lambda x, y: F.struct(x.alias("f"), y.alias("s")))
    if width is not None:
        zipped = F.zip_with(zipped, width, lambda p, d: F.struct(p["f"].alias("f"), p["s"].alias("s"), d.alias("d")))

    def of(b: Column) -> Column:
        p = b["p"]
        d = F.transform(p, lambda q: q["d"]) if width is not None else widths(F.transform(p, lambda q: q["f"]))
        term = lambda q, w: F.coalesce(F.nanvl(q["s"], F.lit(0.0)) * F.pow(q["f"], F.lit(float(n))) * w, F.lit(0.0))
        return arrays.total(F.zip_with(p, d, term))

    return arrays.bind(of, p=F.filter(zipped, lambda q: q["f"] > 0))


def moments(spectra: DataFrame, orders=(-2, -1, 0, 1, 2, 4)) -> DataFrame:
    """spectra with m_<n> (minus as m_n<n>)."""
    return spectra.select("*", *[moment(n).alias(f"m_{'n' if n < 0 else ''}{abs(n)}") for n in orders])


def peak_period(f: str = "f", s: str = "s") -> Column:
    """1 / f of the highest s; ties to the lowest f."""
    return 1 / F.get(F.col(f), F.array_position(F.col(s), F.array_max(F.col(s))).cast("int") - 1)


def sea_state(spectra: DataFrame) -> DataFrame:
    """spectra with hm0, te, tm, tz, tavg, tp, e, v."""
    m = moments(spectra)
    c = F.col
    return m.select(
        "*",
        (4 * F.sqrt(c("m_0"))).alias("hm0"),
        (c("m_n1") / c("m_0")).alias("te"),
        F.sqrt(c("m_0") / c("m_1")).alias("tm"),
        F.sqrt(c("m_0") / c("m_2")).alias("tz"),
        F.sqrt(c("m_2") / c("m_4")).alias("tavg"),
        peak_period().alias("tp"),
        F.sqrt(1 - c("m_2") * c("m_2") / (c("m_0") / c("m_4"))).alias("e"),
        F.sqrt(c("m_0") * c("m_n2") / (c("m_n1") * c("m_n1")) - 1).alias("v"),
    )


def energy_flux_deep(hm0: Column, te: Column, rho: float = RHO, g: float = G) -> Column:
    return F.lit(rho * g * g / (64 * math.pi)) * hm0 * hm0 * te


def pierson_moskowitz(f: Column, tp: Column, hs: Column) -> Column:
    b = 1.25 / F.pow(tp, F.lit(4.0))
    return F.when(f == 0, 0.0).otherwise(b * F.pow(hs / 2, F.lit(2.0)) * F.pow(f, F.lit(-5.0)) * F.exp(-b * F.pow(f, F.lit(-4.0))))


def jonswap_gamma(tp: Column, hs: Column) -> Column:
    x = tp / F.sqrt(hs)
    return F.when(x <= 3.6, 5.0).when(x > 5, 1.0).otherwise(F.exp(5.75 - 1.15 * x))


def jonswap(f: Column, tp: Column, hs: Column, gamma: Column | None = None) -> Column:
    g = jonswap_gamma(tp, hs) if gamma is None else gamma
    width = F.when(f <= 1 / tp, 0.07).otherwise(0.09)
    peak = F.exp(-F.pow(f * tp - 1, F.lit(2.0)) / (2 * width * width))
    return (1 - 0.287 * F.log(g)) * pierson_moskowitz(f, tp, hs) * F.pow(g, peak)


def wave_number(f: Column, h: Column, g: float = G, steps: int = 30) -> Column:
    """k of (2 pi f)^2 = g k tanh(k h), by a fixed number of Newton steps from a shallow-to-deep guess."""
    w2 = F.pow(2 * math.pi * f, F.lit(2.0))
    first = w2 / g / F.sqrt(F.tanh(w2 * h / g))

    def newton(k: Column, _: Column) -> Column:
        t = F.tanh(k * h)
        return k - (g * k * t - w2) / (g * t + g * k * h * (1 - t * t))

    return F.when(f == 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, newton))


def wave_length(k: Column) -> Column:
    return 2 * math.pi / k


def depth_regime(length: Column, h: Column, ratio: float = 2) -> Column:
    return h / length > ratio


def wave_celerity(f: Column, k: Column, h: Column, depth_check: bool = False, ratio: float = 2) -> Column:
    """Group velocity; with depth_check the deep-water form where h is more than `ratio` wave lengths."""
    any_ = math.pi * f / k * (1 + 2 * h * k / F.sinh(2 * h * k))
    return F.when(depth_regime(wave_length(k), h, ratio), math.pi * f / k).otherwise(any_) if depth_check else any_


def energy_flux(f: Column, s: Column, h: Column, rho: float = RHO, g: float = G, ratio: float = 2) -> Column:
    """Energy flux of a spectrum (arrays f > 0 and s) in water of depth h: rho g times the sum of s, width and group velocity."""

    def of(b: Column) -> Column:
        at = F.transform(b["f"], lambda x: arrays.bind(lambda c: wave_celerity(c["f"], c["k"], c["h"], True, ratio), f=x, k=wave_number(x, b["h"], g), h=b["h"]))
        terms = F.zip_with(F.zip_with(b["s"], widths(b["f"]), lambda x, d: x * d), at, lambda x, c: F.coalesce(x * c, F.lit(0.0)))
        return rho * g * arrays.total(terms)

    return arrays.bind(of, f=f, s=s, h=h)


def surface_elevation(t: Column, f: Column, s: Column, phase: Column, width: Column | None = None) -> Column:
    """Elevation at time t of a spectrum (arrays) with given phases: the sum of sines of amplitude sqrt(2 s df).

    df is one width for all, by default the first difference. For even frequencies from 0 on this is what the inverse
    transform gives at the transform's own times.
    """

    def of(b: Column) -> Column:
        wave = F.zip_with(F.zip_with(b["f"], b["s"], lambda x, y: F.struct(x.alias("f"), F.sqrt(2 * y * b["d"]).alias("a"))), b["p"], lambda q, p: F.coalesce(q["a"] * F.cos(2 * math.pi * q["f"] * b["t"] + p), F.lit(0.0)))
        return arrays.total(wave)

    return arrays.bind(of, f=f, s=s, p=phase, t=t, d=F.get(f, F.lit(1)) - F.get(f, F.lit(0)) if width is None else width)


def seeded_phases(f: Column, seed: int, *key: Column | str) -> Column:
    """Phases (array, radians) for the frequencies of an array: evenly spread, fixed by the seed and the key of the row."""
    share = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key, i), 11).cast("double") / float(1 << 53)
    return F.transform(f, lambda _, i: 2 * math.pi * share(i))


def surface_record(f: Column, s: Column, phase: Column, n: int, step: float | None = None) -> Column:
    """array<double>: n samples of the elevation of a spectrum (arrays) with given phases.

    Frequencies that are even and begin with zero go by the inverse transform, which lasts one turn of their difference
    df: sample i is at i / (n df). The frequency zero and, of even n, the last one count half there. Others are summed as
    sines, at i * step (1 / (n df) if not given). Null where an array is null, has under two entries, or lengths differ;
    a null density counts 0.
    """

    @F.pandas_udf("array<double>")
    def record(fs: pd.Series, ss: pd.Series, ps: pd.Series) -> pd.Series:
        out: list = [None] * len(fs)
        alike: dict[tuple, list[int]] = {}
        for i, (x, y, p) in enumerate(zip(fs, ss, ps, strict=True)):
            if x is not None and y is not None and p is not None and len(x) == len(y) == len(p) > 1:
                alike.setdefault((len(x), float(x[0]), float(x[1])), []).append(i)
        for (size, first, second), rows in alike.items():
            # some thousand numbers at a time
            for lo in range(0, len(rows), max(1, (1 << 20) // max(n, size))):
                part = rows[lo : lo + max(1, (1 << 20) // max(n, size))]
                x, y, p = (np.array([np.asarray(c[i], float) for i in part]) for c in (fs, ss, ps))
                df = second - first
                even = (first == 0) & np.isclose(np.diff(x, axis=1), df).all(1)
                wave = np.sqrt(2 * np.nan_to_num(y) * df) * np.exp(1j * p)
                eta = np.empty((len(part), n))
                eta[even] = np.fft.irfft(0.5 * n * wave[even], n, axis=1)
                times = np.arange(n) * (1 / (n * df) if step is None else step)
                for k in np.flatnonzero(~even):
                    eta[k] = sum((w * np.exp(2j * np.pi * v * times)).real for v, w in zip(x[k], wave[k], strict=True))
                for k, i in enumerate(part):
                    out[i] = eta[k]
        return pd.Series(out, dtype=object)

    return record(f, s, phase)


def spread_function(direction: Column, r1: Column, r2: Column, a1: Column, a2: Column) -> Column:
    """Share per degree of a direction, of the first two Fourier terms of a buoy (angles in degrees)."""
    return F.degrees((0.5 + r1 * F.cos(F.radians(direction - a1)) + r2 * F.cos(2 * F.radians(direction - a2))) / math.pi)


def chakrabarti(height: Column, length: Column, diameter: Column) -> dict[str, Column]:
    """What places a device in the chart of wave forces: Keulegan-Carpenter number and diffraction parameter."""
    return {"keulegan_carpenter": math.pi * height / diameter, "diffraction": math.pi * diameter / length, "height_ratio": height / diameter}


def energy_period_to_peak_period(te: Column, gamma: Column) -> Column:
    return te / (0.8255 + 0.03852 * gamma - 0.005537 * gamma * gamma + 0.0003154 * gamma * gamma * gamma)


def centre(x: Column, width: float) -> Column:
    """The centre (a multiple of width, from 0) of the bin of x; bins are half-open, the lowest starts at 0."""
    return F.floor(x / width + 0.5) * width


def performance_matrix(df: DataFrame, x: str, y: str, z: str, dx: float, dy: float, median: bool = True) -> DataFrame:
    """x_center, y_center and the eight statistics of z per cell that holds rows; the median, if wanted, by ranks."""
    z_ = F.col(z)
    cells = df.select(centre(F.col(x), dx).alias("x_center"), centre(F.col(y), dy).alias("y_center"), z_)
    out = cells.groupBy("x_center", "y_center").agg(
        F.count(z_).alias("n"), F.avg(z_).alias("mean"), F.stddev_pop(z_).alias("std"), F.sum(z_).alias("total"), F.min(z_).alias("least"), F.max(z_).alias("most")
    )
    if median:
        keys = ["x_center", "y_center"]
        middle = quantiles(cells, keys, z, {"median": 0.5}).withColumnsRenamed({k: f"_{k}" for k in keys})
        out = out.join(middle, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    every = df.agg(F.count(z_).alias("_all"))
    return out.join(F.broadcast(every)).withColumn("frequency", F.col("n") / F.col("_all")).drop("_all")


_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def statistics(df: DataFrame, z: str) -> DataFrame:
    """count, mean, std (population), min, quartiles, max."""
    s = df.agg(F.count(z).alias("n"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("std"), F.min(z).alias("least"), F.max(z).alias("most"))
    return s.join(F.broadcast(quantiles(df, [], z, _QUARTILES))).select("n", "mean", "std", "least", *_QUARTILES, "most")


def annual_energy(df: DataFrame, cw: str, j: str) -> DataFrame:
    """Mean annual energy production of a series: 8766 / n * sum of capture width times flux."""
    return df.agg((8766 / F.count(F.lit(1)) * F.sum(F.col(cw) * F.col(j))).alias("maep"))


def capture_width(power: Column, flux: Column) -> Column:
    """Power over energy flux (also called capture length)."""
    return power / flux


def power_matrix(capture: DataFrame, flux: DataFrame, value: str = "mean") -> DataFrame:
    """x_center, y_center, power: the product of two matrices, cell by cell."""
    b = flux.select("x_center", "y_center", F.col(value).alias("_j"))
    return capture.join(b, ["x_center", "y_center"]).select("x_center", "y_center", (F.col(value) * F.col("_j")).alias("power"))


def annual_energy_of_matrices(capture: DataFrame, flux: DataFrame, share: DataFrame, value: str = "mean") -> DataFrame:
    """maep of matrices of capture width, flux and frequency, and `total`, the sum of frequencies, which is to be 1."""
    both = power_matrix(capture, flux, value).join(share.select("x_center", "y_center", "frequency"), ["x_center", "y_center"], "full_outer")
    return both.agg((8766 * F.sum(F.col("power") * F.col("frequency"))).alias("maep"), F.sum("frequency").alias("total"))


def annual_energy_matrix(df: DataFrame, ts: str, hm0: str, te: str, j: str, dh: float, dt: float) -> DataFrame:
    """te_bin, hm0_bin, count, share: rows and share of the year's energy per cell, averaged over all years (none counts as 0)."""
    cell = lambda x, w: F.floor(F.col(x) / w).cast("long")
    year = df.select(F.year(ts).alias("year"), cell(te, dt).alias("te_bin"), cell(hm0, dh).alias("hm0_bin"), F.col(j).alias("j"))
    cells = year.groupBy("year", "te_bin", "hm0_bin").agg(F.count(F.lit(1)).alias("n"), F.sum("j").alias("j"))
    whole = cells.groupBy(F.col("year").alias("_y")).agg(F.sum("j").alias("_j"))
    years = whole.agg(F.count(F.lit(1)).alias("_years"))
    shares = cells.join(F.broadcast(whole), F.col("year") == F.col("_y")).withColumn("share", F.col("j") / F.col("_j"))
    out = shares.groupBy("te_bin", "hm0_bin").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    return out.join(F.broadcast(years)).select("te_bin", "hm0_bin", (F.col("n") / F.col("_years")).alias("count"), (F.col("share") / F.col("_years")).alias("share"))


def monthly_statistics(df: DataFrame, ts: str, x: str) -> DataFrame:
    """month, n, mean and quartiles of x: what a boxplot by month shows."""
    d = df.select(F.month(ts).alias("month"), x)
    s = d.groupBy("month").agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    q = quantiles(d, ["month"], x, _QUARTILES).withColumnRenamed("month", "_m")
    return s.join(F.broadcast(q), F.col("month").eqNullSafe(F.col("_m"))).select("month", "n", "mean", *_QUARTILES)


def power_performance(spectra: DataFrame, depth: float, power: str, dh: float = 0.5, dt: float = 1.0, rho: float = 1205.0) -> dict[str, DataFrame]:
    """Of spectra (arrays f, s) with a power per row: capture width matrix, flux matrix, power matrix and annual energy."""
    s = sea_state(spectra).withColumn("j", energy_flux(F.col("f"), F.col("s"), F.lit(float(depth)), rho))
    s = s.withColumn("cw", capture_width(F.col(power), F.col("j")))
    capture, flux = performance_matrix(s, "hm0", "te", "cw", dh, dt, False), performance_matrix(s, "hm0", "te", "j", dh, dt, False)
    return {"capture_width": capture, "flux": flux, "power": power_matrix(capture, flux), "annual_energy": annual_energy_of_matrices(capture, flux, flux)}
