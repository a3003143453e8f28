"""Spectra of time series: Welch's method, cross spectra, harmonics, instantaneous frequency.

Each function gets whole windows as arrays (one row per series and window), so that windows of one long series spread
over all executors; numpy works on Arrow batches of rows. A window with a missing value, or shorter than one segment,
gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def detrended(x: np.ndarray) -> np.ndarray:
    """x without its least-squares line, along the last axis."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    x = x - x.mean(-1, keepdims=True)
    return x - (x @ t / max(float(t @ t), 1e-300))[..., None] * t


def segments(x: np.ndarray, n: int, overlap: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n)[:: n - overlap]


def density(a: np.ndarray, b: np.ndarray, rate: float, n: int, overlap: int, constant: bool = False, line: bool = False) -> np.ndarray:
    """One-sided (cross) spectral density of segments of n points, averaged: Hann window, scaled so that white noise of
    variance 1 has the density 2 / rate. constant or line: take each segment's mean or line off first."""
    w = hann(n)
    parts = []
    for x in (a, b):
        s = segments(x, n, overlap)
        s = detrended(s) if line else s - s.mean(-1, keepdims=True) if constant else s
        parts.append(np.fft.rfft(s * w, axis=-1))
    p = (np.conj(parts[0]) * parts[1]).mean(0) / (rate * (w @ w))
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return p


def windows(df: DataFrame, by: list[str], ts: str, columns: list[str], rows: int, step: int | None = None) -> DataFrame:
    """by, block and an array per column: each run of `rows` rows in time order, a new one every `step` rows; the tail is dropped.

    Rows are dealt to the windows they belong to and gathered by window, never by series.
    """
    step = step or rows
    at = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(ts)) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - rows + 1) / step))
    at = at.withColumn("block", F.explode(F.sequence(first.cast("long"), F.floor(F.col("_i") / step).cast("long"))))
    kept = F.array_sort(F.collect_list(F.struct("_i", *[F.col(c).cast("double").alias(c) for c in columns])))
    held = at.groupBy(*by, "block").agg(kept.alias("_w")).where(F.size("_w") == rows)
    return held.select(*by, "block", *[F.col("_w").getField(c).alias(c) for c in columns])


def _whole(x) -> np.ndarray | None:
    x = None if x is None else np.asarray(x, float)
    return x if x is not None and np.isfinite(x).all() else None


def frequencies(rate: float, n: int, zero: bool = True) -> list[float]:
    return [float(f) for f in np.fft.rfftfreq(n, 1 / rate)][0 if zero else 1 :]


def welch(x: Column, rate: float, n: int, overlap: float = 0.5, detrend_whole: bool = True, zero: bool = True, noise: float = 0.0) -> Column:
    """Spectral density of an array of samples (`rate` a second), at frequencies(rate, n, zero).

    detrend_whole takes the line off the whole array first, else off each segment. noise: white noise of this deviation
    is taken off, values then below 0 become the least magnitude over 100.
    """
    step = int(n * overlap)

    @F.pandas_udf("array<double>")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            v = _whole(v)
            if v is None or len(v) < n:
                out.append(None)
                continue
            p = density(detrended(v), detrended(v), rate, n, step, constant=True).real if detrend_whole else density(v, v, rate, n, step, line=True).real
            p = p if zero else p[1:]
            if noise:
                p = p - noise**2 / (rate / 2)
                low = np.abs(p).min() / 100
                p = np.where(p < 0, low, p)
            out.append(p)
        return pd.Series(out)

    return of(x)


def cross(x: Column, y: Column, rate: float, n: int, overlap: float = 0.5) -> Column:
    """array<struct<re, im>>: the cross spectral density of two arrays, without f = 0, each segment without its line."""
    step = int(n * overlap)

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for u, v in zip(a, b):
            u, v = _whole(u), _whole(v)
            p = density(u, v, rate, n, step, line=True)[1:] if u is not None and v is not None and len(u) == len(v) >= n else None
            out.append((None, None) if p is None else (p.real, p.imag))
        return pd.DataFrame(out, columns=["re", "im"])

    return F.arrays_zip(of(x, y)["re"].alias("re"), of(x, y)["im"].alias("im"))


def instantaneous_frequency(x: Column, seconds: Column) -> Column:
    """Array of the frequencies between samples: the turn of the analytic signal over the time between; one shorter than x."""

    @F.pandas_udf("array<double>")
    def of(s: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for v, at in zip(s, t):
            v, at = _whole(v), _whole(at)
            if v is None or at is None or len(v) < 2:
                out.append(None)
                continue
            n = len(v)
            keep = np.zeros(n)
            keep[0], keep[1 : (n + 1) // 2] = 1, 2
            if n % 2 == 0:
                keep[n // 2] = 1
            phase = np.unwrap(np.angle(np.fft.ifft(np.fft.fft(v) * keep)))
            out.append(np.diff(phase) / (2 * np.pi) / np.diff(at))
        return pd.Series(out)

    return of(x, seconds)


#: The rows whose results are held at a time, where they are longer than what they come of.
SLICE = 256

#: Highest harmonic frequency (exclusive) of the 5 Hz grid, by grid frequency.
GRID = {60: (3060, 3060), 50: (2570, 2550)}


def harmonics(x: Column, rate: float, grid: int) -> Column:
    """Amplitudes at 0, 5, 10, ... Hz of an array of samples: those of the nearest frequencies of the transform."""
    hertz = np.arange(0, GRID[grid][0], 5)

    def one(v) -> np.ndarray | None:
        v = _whole(v)
        if v is None or not len(v):
            return None
        f = np.sort(np.fft.fftfreq(len(v), 1 / rate))
        a = np.abs(np.fft.fft(v))[np.argsort(np.fft.fftfreq(len(v), 1 / rate))] * 2 / len(v)
        hi = np.minimum(np.searchsorted(f, hertz), len(f) - 1)
        lo = np.maximum(hi - 1, 0)
        return a[np.where(np.abs(f[hi] - hertz) <= np.abs(hertz - f[lo]), hi, lo)]

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            # a row gives more than 500 numbers: few rows at a time
            for k in range(0, len(s), SLICE):
                yield pd.Series([one(v) for v in s[k : k + SLICE]])

    return of(x)


def _over(a: Column, first: Column, last: Column) -> Column:
    """Root of the sum of squares of the elements first to last (from 0, inclusive)."""
    part = F.slice(a, first + 1, last - first + 1)
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v))


def harmonic_subgroups(a: Column, grid: int) -> Column:
    """Per multiple of the grid frequency, itself and its neighbours of the 5 Hz grid together; below 0 Hz stands the last."""
    step = grid // 5
    of = lambda h: F.when(h == 0, F.sqrt(F.pow(F.element_at(a, -1), F.lit(2.0)) + F.pow(_over(a, F.lit(0), F.lit(1)), F.lit(2.0)))).otherwise(_over(a, h * step - 1, h * step + 1))
    return F.transform(F.sequence(F.lit(0), F.lit(GRID[grid][1] // grid - 1)), of)


def interharmonics(a: Column, grid: int) -> Column:
    """Per multiple of the grid frequency, what lies above it: the next 10 (60 Hz) or 6 (50 Hz) of the 5 Hz grid together."""
    step, n = grid // 5, 10 if grid == 60 else 6
    return F.transform(F.sequence(F.lit(0), F.lit(GRID[grid][1] // grid - 1)), lambda h: F.sqrt(F.aggregate(F.slice(a, h * step + 2, F.lit(n)), F.lit(0.0), lambda s, v: s + v * v)))


def total_harmonic_distortion(subgroups: Column) -> Column:
    """Percent: the second to the 49th harmonic together over the first."""
    return 100 * _over(subgroups, F.lit(2), F.lit(49)) / F.get(subgroups, F.lit(1))
