"""Underwater sound: bands, calibration, levels and exposure of spectral densities (arrays `f`, Hz, and `s`, Pa^2/Hz).

Band tables depend on the frequencies alone; they are built on the driver (at most a few thousand rows) and stand in the
plan as literals, so that bands of any number of spectra are a projection. Missing densities count as nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalassa.functions import arrays
from thalassa.sources.audio import full_scale

REFERENCE = 1e-12

#: NMFS 2024 parameters a, b, f1 and f2 (kHz), C and K of marine mammal groups under water and in air.
GROUPS = {
    "lf": (0.99, 5, 0.168, 26.6, 0.12, 177),
    "hf": (1.55, 5, 1.73, 129, 0.32, 181),
    "vhf": (2.23, 5, 5.93, 186, 0.91, 160),
    "pw": (1.63, 5, 0.81, 68.3, 0.29, 175),
    "ow": (1.58, 5, 2.53, 43.8, 1.37, 178),
}


def frequency_bands(per_octave: float, base: float, low: float, high: float) -> list[tuple[float, float, float]]:
    """(lower, centre, upper) of bands of base^(1/per_octave) from low on, as long as centres are below high."""
    step = math.log10(base) / per_octave
    n = max(0, math.ceil((math.log10(high) - math.log10(low)) / step))
    half = base ** (1 / (2 * per_octave))
    centres = [10 ** (math.log10(low) + i * step) for i in range(n)]
    return [(c / half, c, c * half) for c in centres]


def nyquist(fmax: float, highest: float) -> float:
    """fmax, or the highest frequency there is."""
    return min(fmax, highest)


def minimum_frequency(depth: Column, c: float = 1500, bed: float = 1700) -> Column:
    """The lowest frequency that carries far in water of a depth."""
    return c / (4 * depth * math.sqrt(1 - (c / bed) ** 2))


def calibrated(f: Column, s: Column, curve_f: list[float], curve_db: list[float], fill: float) -> Column:
    """s over the sensitivity (dB re 1 V^2/uPa^2) on the line through a curve, or `fill` beyond its ends; in Pa^2/Hz."""
    xs, ys = (F.array(*[F.lit(float(v)) for v in c]) for c in (curve_f, curve_db))
    level = lambda x: F.coalesce(arrays.interpolate(x, xs, ys), F.lit(float(fill)))
    return F.zip_with(f, s, lambda x, y: y / F.pow(F.lit(10.0), level(x) / 10) / 1e12)


def band_table(f: list[float], per_division: int, base: float) -> list[tuple[float, float, float]]:
    """(lower, centre, upper) of the bands of a grid of frequencies; the last one ends with the grid."""
    bands = [b for b in frequency_bands(per_division, base, f[0], f[-1]) if b[1] > 0]
    return [*bands[:-1], (*bands[-1][:2], f[-1])] if bands else []


def overlaps(f: list[float], bands: list[tuple[float, float, float]]) -> list[tuple[list[int], list[tuple[int, float]]]]:
    """Per band the bins of the grid that lie in it, and those that reach over an edge with the share inside."""
    width = f[1] - f[0]
    out = []
    for lo, _, hi in bands:
        full, part = [], []
        for i, x in enumerate(f):
            a, b = x - width / 2, x + width / 2
            if a >= lo and b <= hi:
                full.append(i)
            elif lo <= x <= hi or (b > lo and a < hi):
                part.append((i, (width - (lo - a)) / width if a < lo else (width - (b - hi)) / width if b > hi else 0.0))
        out.append((full, part))
    return out


def _picked(s: Column, bins: list[int]) -> Column:
    return F.array(*[F.coalesce(F.get(s, F.lit(i)), F.lit(0.0)) for i in bins])


def band_density(s: Column, f: list[float], per_division: int, base: float) -> Column:
    """array<struct<centre, s>>: mean density per band (millidecades: 1000, 10; decidecades: 10, 10; third octaves: 3, 2)."""
    bands, width = band_table(f, per_division, base), f[1] - f[0]
    out = []
    for (lo, c, hi), (full, part) in zip(bands, overlaps(f, bands)):
        terms = [F.coalesce(F.get(s, F.lit(i)), F.lit(0.0)) * w for i, w in [*((i, 1.0) for i in full), *part]]
        total = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
        out.append(F.struct(F.lit(c).alias("centre"), (total * width / (hi - lo)).alias("s")))
    return F.array(*out)


def band_level(s: Column, f: list[float], per_division: int, base: float) -> Column:
    """array<struct<centre, spl>>: level per band; whole bins and weighted bins are integrated by trapezoids apart."""
    bands, width = band_table(f, per_division, base), f[1] - f[0]
    grid = lambda n: F.array(*[F.lit(float(i) * width) for i in range(n)])
    out = []
    for (_, c, _), (full, part) in zip(bands, overlaps(f, bands)):
        power = F.lit(0.0)
        if len(full) > 1:
            power = power + arrays.trapezoid(grid(len(full)), _picked(s, full))
        if len(part) > 1:
            power = power + arrays.trapezoid(grid(len(part)), F.array(*[F.coalesce(F.get(s, F.lit(i)), F.lit(0.0)) * w for i, w in part]))
        out.append(F.struct(F.lit(c).alias("centre"), (10 * F.log10(F.nullif(power, F.lit(0.0)) / REFERENCE)).alias("spl")))
    return F.array(*out)


def spectral_density_level(s: Column) -> Column:
    return 10 * F.log10(s / REFERENCE)


def sound_pressure_level(f: Column, s: Column, fmin: float = 10, fmax: float = 100_000) -> Column:
    return 10 * F.log10(F.nullif(arrays.trapezoid(*arrays.between(f, s, fmin, fmax)), F.lit(0.0)) / REFERENCE)


def auditory_weighting(f: Column, group: str) -> tuple[Column, Column]:
    """Weighting and exposure functions (dB) of a marine mammal group at a frequency in Hz."""
    a, b, f1, f2, c, k = GROUPS[group.lower()]
    x, y = f / 1000 / f1, f / 1000 / f2
    band = 10 * F.log10(F.pow(x, F.lit(2.0 * a)) / (F.pow(1 + x * x, F.lit(float(a))) * F.pow(1 + y * y, F.lit(float(b)))))
    return c + band, k - band


def sound_exposure_level(f: Column, s: Column, seconds: float, group: str | None = None, fmin: float = 10, fmax: float = 100_000) -> Column:
    """Level of the energy of `seconds` of sound, weighted for a group if one is given."""
    xs, ys = arrays.between(f, s, fmin, fmax)
    if group:
        ys = F.zip_with(xs, ys, lambda x, y: y * F.pow(F.lit(10.0), auditory_weighting(x, group)[0] / 10))
    return 10 * F.log10(F.nullif(arrays.trapezoid(xs, ys), F.lit(0.0)) / REFERENCE) + 10 * math.log10(seconds)


#: What levels can be gathered by.
METHODS = {
    "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop, "count": F.count,
}


def aggregate(x: Column, method: str | dict[str, float]) -> Column:
    """An aggregate by name, or {"quantile": q}."""
    if isinstance(method, dict):
        (name, q), *more = method.items()
        if name != "quantile" or more:
            raise ValueError(f"not a method: {method}")
        return F.percentile(x, F.lit(float(q)))
    if method not in METHODS:
        raise ValueError(f"not one of {sorted(METHODS)}: {method}")
    return METHODS[method](x)


def time_aggregate(df: DataFrame, by: list[str], seconds_from_start: str, level: str, window: float, method: str | dict[str, float] = "median") -> DataFrame:
    """by, centre, value: levels per window (a, b] of seconds from the start; the start itself belongs to none."""
    n = F.ceil(F.col(seconds_from_start) / window)
    d = df.where(F.col(seconds_from_start) > 0).groupBy(*by, ((n - 0.5) * window).alias("centre"))
    return d.agg(aggregate(F.col(level), method).alias("value"))


def band_aggregate(df: DataFrame, by: list[str], f: str, level: str, per_octave: int = 3, base: int = 2, fmin: float = 10, fmax: float = 100_000, method: str | dict[str, float] = "median") -> DataFrame:
    """by, centre, value: levels per band (a, b] of frequency."""
    bands = frequency_bands(per_octave, base, fmin, fmax)
    edges = [b[0] for b in bands] + [bands[-1][2]]
    x = F.col(f)
    ratio = math.log(base) / per_octave
    guess = F.ceil(F.log(x / edges[0]) / ratio).cast("int")
    # rounding may put an edge into the band next to it: settle with the edges themselves
    table = F.array(*[F.lit(e) for e in edges])
    at = F.when(x <= F.get(table, guess - 1), guess - 1).when(x > F.get(table, guess), guess + 1).otherwise(guess)
    centres = F.array(*[F.lit(b[1]) for b in bands])
    d = df.where((x > edges[0]) & (x <= edges[-1])).groupBy(*by, F.element_at(centres, at).alias("centre"))
    return d.agg(aggregate(F.col(level), method).alias("value"))


def volts(count: Column, bits: int, peak: float) -> Column:
    """Volts of a sample of 12, 16, 24 or 32 bits; see full_scale()."""
    return count / full_scale(bits) * peak


def pressure(volt: Column, sensitivity_db: float, gain_db: float = 0) -> Column:
    """Pa of a sample, by a sensitivity in dB re 1 V/uPa."""
    return volt / (10 ** ((sensitivity_db + gain_db) / 20)) / 1e6
