"""Loads and extremes: fatigue by rainflow counting, peaks, fitted distributions, return values, most likely extreme response.

Fits work on arrays (one row per series), so that many series are fitted side by side; a series has to fit in one task.
Distribution parameters are structs, and their distribution functions are Column expressions.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalassa.functions import arrays

from .wave import moment


def blade_moments(matrix: list[float], flap_offset: float, flap: Column, edge_offset: float, edge: Column) -> tuple[Column, Column]:
    a, b = flap - flap_offset, edge - edge_offset
    return matrix[0] * a + matrix[1] * b, matrix[2] * a + matrix[3] * b


def rainflow_ranges(x: np.ndarray, levels: int = 256) -> np.ndarray:
    """The ranges of all cycles of a load history: values are put on `levels` equal levels, turning points kept, four-point
    cycles taken out, and those of the residue, run through twice, added."""
    x = x[np.isfinite(x)]
    if len(x) < 2 or x.max() == x.min():
        return np.zeros(0)
    low, step = x.min(), (x.max() - x.min()) / levels
    # levels are cells; a value stands for the middle of its cell
    q = np.minimum(np.floor((x - low) / step), levels - 1)

    def turning(v):
        v = v[np.append(True, v[1:] != v[:-1])]
        d = np.sign(np.diff(v))
        return v[np.append(True, np.append(d[1:] != d[:-1], True))] if len(v) > 2 else v

    def count(points):
        stack, found = [], []
        for p in points:
            stack.append(p)
            while len(stack) > 3:
                a, b, c, d = stack[-4:]
                if min(a, d) <= min(b, c) and max(b, c) <= max(a, d):
                    found.append(abs(b - c))
                    del stack[-3:-1]
                else:
                    break
        return found, stack

    first, rest = count(turning(q))
    second, _ = count(turning(np.array([*rest, *rest]))) if len(rest) > 1 else ([], [])
    return np.array(first + second) * step


def damage_equivalent_load(x: Column, m: float, bins: int = 100, length: float = 600) -> Column:
    """The load whose `length` cycles do the damage of a history (array): ranges counted in `bins` cells, by their middles."""

    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            r = rainflow_ranges(np.asarray([] if v is None else v, float))
            if not len(r):
                out.append(0.0)
                continue
            n, edges = np.histogram(r, bins, (0, r.max()))
            out.append(float((((edges[1:] + edges[:-1]) / 2) ** m * n / length).sum() ** (1 / m)))
        return pd.Series(out)

    return of(x)


def short_term_peaks(n: Column, seconds: Column, short: float) -> Column:
    return n * short / seconds


def return_probability(years: float, hours: float) -> float:
    """The probability not to be exceeded in one sea state of the value that returns after so many years."""
    return 1 - 1 / (years * 365.25 * 24 / hours)


# --- distributions -------------------------------------------------------------------------------------------------


def weibull_cdf(x: Column, shape: Column, scale: Column) -> Column:
    return F.when(x > 0, 1 - F.exp(-F.pow(x / scale, shape))).otherwise(0.0)


def weibull_ppf(p: Column, shape: Column, scale: Column) -> Column:
    return scale * F.pow(-F.log(1 - p), 1 / shape)


def gumbel_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return F.exp(-F.exp(-(x - loc) / scale))


def gumbel_ppf(p: Column, loc: Column, scale: Column) -> Column:
    return loc - scale * F.log(-F.log(p))


def gev_cdf(x: Column, c: Column, loc: Column, scale: Column) -> Column:
    """c > 0 has an upper end."""
    y = 1 - c * (x - loc) / scale
    bounded = F.when(y > 0, F.exp(-F.pow(y, 1 / c))).otherwise(F.when(c > 0, 1.0).otherwise(0.0))
    return F.when(F.abs(c) < 1e-9, gumbel_cdf(x, loc, scale)).otherwise(bounded)


def gev_ppf(p: Column, c: Column, loc: Column, scale: Column) -> Column:
    return F.when(F.abs(c) < 1e-9, gumbel_ppf(p, loc, scale)).otherwise(loc + scale * (1 - F.pow(-F.log(p), c)) / c)


def pareto_cdf(x: Column, c: Column, scale: Column) -> Column:
    y = 1 + c * x / scale
    return F.when(x <= 0, 0.0).when(F.abs(c) < 1e-9, 1 - F.exp(-x / scale)).when(y <= 0, 1.0).otherwise(1 - F.pow(y, -1 / c))


def over_threshold_cdf(x: Column, fit: Column) -> Column:
    """Of all peaks, by the fit of those over a threshold; null below it."""
    above = 1 - fit["n_over"] / fit["n"] * (1 - pareto_cdf(x - fit["threshold"], fit["c"], fit["scale"]))
    return F.when(x >= fit["threshold"], above)


def short_term_extreme_cdf(peaks_cdf: Column, n: Column) -> Column:
    """Of the highest of n independent peaks."""
    return F.pow(peaks_cdf, n)


def long_term_extreme(df: DataFrame, by: list[str], cdf: str, weight: str) -> DataFrame:
    """by, cdf: the mean over sea states of a short-term distribution function, by weight."""
    return df.groupBy(*by).agg((F.sum(F.col(cdf) * F.col(weight)) / F.sum(weight)).alias("cdf"))


#: The most values of series that are fitted together.
TOGETHER = 1 << 18


def _by_length(series: list[np.ndarray]):
    """(places, matrix): the series of one length as rows, at most TOGETHER values at a time."""
    lengths = np.array([len(v) for v in series], int)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        step = max(1, TOGETHER // max(int(n), 1))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            yield part, np.stack([series[i] for i in part])


def _struct_fit(x: Column, schema: str, fits) -> Column:
    """fits: the parameters of the rows of a matrix, a row per row; NaN where there is no fit."""
    names = [f.split(":")[0] for f in schema[7:-1].split(",")]

    @F.pandas_udf(schema)
    def of(s: pd.Series) -> pd.DataFrame:
        series = [np.asarray([] if v is None else v, float) for v in s]
        series = [v[np.isfinite(v)] for v in series]
        fit = np.flatnonzero([len(v) > 1 and v.max() > v.min() for v in series])
        out = np.full((len(series), len(names)), np.nan)
        for places, rows in _by_length([series[i] for i in fit]):
            out[fit[places]] = fits(rows)
        return pd.DataFrame(out, columns=names)

    return of(x)


def nelder_meads(f, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """A minimum by the downhill simplex for each row of start, all rows side by side.

    f takes points, one a row, and of each the number of its row in start.
    """
    m, n = start.shape
    points = np.repeat(np.asarray(start, float)[:, None], n + 1, 1)
    for i in range(n):
        points[:, i + 1, i] = np.where(points[:, i + 1, i] != 0, points[:, i + 1, i] * 1.05, 0.00025)
    values = np.stack([f(points[:, i], np.arange(m)) for i in range(n + 1)], 1)
    on = np.arange(m)
    for _ in range(steps * n):
        order = np.argsort(values[on], 1, kind="stable")
        p, v = np.take_along_axis(points[on], order[..., None], 1), np.take_along_axis(values[on], order, 1)
        points[on], values[on] = p, v
        with np.errstate(invalid="ignore"):
            going = ~((np.abs(p[:, 1:] - p[:, :1]).max((1, 2)) < 1e-6) & (v[:, -1] - v[:, 0] < 1e-7))
        on, p, v = on[going], p[going], v[going]
        if not len(on):
            break
        centre, last = np.mean(p[:, :-1], axis=1), p[:, -1]
        away = centre + (centre - last)
        fa = f(away, on)
        new, value = away.copy(), fa.copy()
        best = fa < v[:, 0]
        if best.any():
            far = centre[best] + 2 * (centre[best] - last[best])
            ff = f(far, on[best])
            better = ff < fa[best]
            new[best], value[best] = np.where(better[:, None], far, away[best]), np.where(better, ff, fa[best])
        poor = np.flatnonzero(~best & ~(fa < v[:, -2]))
        if len(poor):
            a, e = fa[poor], v[poor, -1]
            near = centre[poor] + 0.5 * (np.where((a < e)[:, None], away[poor], last[poor]) - centre[poor])
            fn = f(near, on[poor])
            taken = fn < np.where(e < a, e, a)
            new[poor[taken]], value[poor[taken]] = near[taken], fn[taken]
            shrink = poor[~taken]
            if len(shrink):
                p[shrink, 1:] = p[shrink, :1] + 0.5 * (p[shrink, 1:] - p[shrink, :1])
                for i in range(1, n + 1):
                    v[shrink, i] = f(p[shrink, i], on[shrink])
                new[shrink], value[shrink] = p[shrink, -1], v[shrink, -1]
        p[:, -1], v[:, -1] = new, value
        points[on], values[on] = p, v
    return points[np.arange(m), np.argmin(values, 1)]


def nelder_mead(f, start: np.ndarray, steps: int = 400) -> np.ndarray:
    """A minimum of f by the downhill simplex."""
    return nelder_meads(lambda p, _: np.array([f(q) for q in p], float), np.asarray(start, float)[None], steps)[0]


def _halved(below, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The middle of 200 halvings of each span, to the upper half where below(middle); settled spans stay as they are."""
    for _ in range(200):
        mid = (lo + hi) / 2
        settled = bool(((mid == lo) | (mid == hi)).all())
        up = below(mid)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        if settled:
            break
    return (lo + hi) / 2


def fit_weibulls(x: np.ndarray) -> np.ndarray:
    """Shape and scale of greatest likelihood of positive values, by row: the shape is the root of a rising function."""
    logs = np.log(x / x.max(1, keepdims=True))
    mean = logs.mean(1)

    def g(c):
        w = np.exp(c[:, None] * logs)
        return (w * logs).sum(1) / w.sum(1) - 1 / c - mean

    lo, hi = np.full(len(x), 1e-3), np.ones(len(x))
    while (more := (g(hi) < 0) & (hi < 1e6)).any():
        hi = np.where(more, hi * 2, hi)
    c = _halved(lambda mid: g(mid) < 0, lo, hi)
    return np.stack([c, x.max(1) * np.exp(c[:, None] * logs).mean(1) ** (1 / c)], 1)


def fit_weibull(x: np.ndarray) -> tuple[float, float] | None:
    x = x[x > 0]
    return tuple(map(float, fit_weibulls(x[None])[0])) if len(x) > 1 else None


def fit_gumbels(x: np.ndarray) -> np.ndarray:
    """Location and scale of greatest likelihood, by row."""
    low, mean = x.min(1), x.mean(1)

    def g(b):
        w = np.exp(-(x - low[:, None]) / b[:, None])
        return mean - (x * w).sum(1) / w.sum(1) - b

    b = _halved(lambda mid: g(mid) > 0, 1e-12 * np.maximum(1.0, np.abs(mean)), x.max(1) - low)
    return np.stack([low - b * np.log(np.exp(-(x - low[:, None]) / b[:, None]).mean(1)), b], 1)


def fit_gumbel(x: np.ndarray) -> tuple[float, float]:
    return tuple(map(float, fit_gumbels(x[None])[0]))


def fit_gevs(x: np.ndarray) -> np.ndarray:
    """c, location and scale of greatest likelihood, from the Gumbel fit, by row."""
    start = fit_gumbels(x)

    def loss(p, rows):
        c, s = p[:, :1], np.exp(p[:, 2:])
        z, flat = (x[rows] - p[:, 1:2]) / s, np.abs(p[:, 0]) < 1e-9
        with np.errstate(all="ignore"):
            y = 1 - c * z
            t = np.log(np.where(y > 0, y, 1)) / c
            out = np.where((y <= 0).any(1), np.inf, x.shape[1] * p[:, 2] + (np.exp(t) - (1 - c) * t).sum(1))
            return np.where(flat, x.shape[1] * p[:, 2] + (z + np.exp(-z)).sum(1), out) if flat.any() else out

    q = nelder_meads(loss, np.stack([np.full(len(x), 0.1), start[:, 0], np.log(start[:, 1])], 1), 600)
    return np.stack([q[:, 0], q[:, 1], np.exp(q[:, 2])], 1)


def fit_gev(x: np.ndarray) -> tuple[float, float, float]:
    return tuple(map(float, fit_gevs(x[None])[0]))


def fit_paretos(x: np.ndarray) -> np.ndarray:
    """c and scale of greatest likelihood of excesses over a threshold, by row."""

    def loss(p, rows):
        c, s = p[:, :1], np.exp(p[:, 1:])
        with np.errstate(all="ignore"):
            y = 1 + c * x[rows] / s
            tail = np.where(np.abs(p[:, 0]) < 1e-9, x[rows].sum(1) / s[:, 0], (1 + 1 / c[:, 0]) * np.log(np.where(y > 0, y, 1)).sum(1))
        return np.where((y <= 0).any(1), np.inf, x.shape[1] * p[:, 1] + tail)

    q = nelder_meads(loss, np.stack([np.full(len(x), 0.1), np.log(x.mean(1))], 1), 600)
    return np.stack([q[:, 0], np.exp(q[:, 1])], 1)


def fit_pareto(x: np.ndarray) -> tuple[float, float] | None:
    x = x[x > 0]
    return tuple(map(float, fit_paretos(x[None])[0])) if len(x) > 1 else None


def fit_tails(x: np.ndarray) -> np.ndarray:
    """Shape and scale, by row: the mean of seven least-squares fits of a Weibull distribution to the empirical one above its
    60 to 90 %."""
    x = np.sort(x, 1)
    start, place, found = np.log(fit_weibulls(x)), np.arange(x.shape[1]) / (x.shape[1] + 1.0), []
    for limit in 0.6 + 0.05 * np.arange(7):
        top, p = x[:, place > limit], place[place > limit]
        if len(p) < 2:
            continue

        def loss(q, rows, top=top, p=p):
            with np.errstate(all="ignore"):
                return ((1 - np.exp(-((top[rows] / np.exp(q[:, 1:])) ** np.exp(q[:, :1]))) - p) ** 2).sum(1)

        found.append(np.exp(nelder_meads(loss, start)))
    return np.mean(found, axis=0) if found else np.full((len(x), 2), np.nan)


def _of_some(fits, keep, width: int):
    """Fits to the values of each row that keep(rows) marks; rows with fewer than two have none."""

    def of(x: np.ndarray) -> np.ndarray:
        some, out = [v[k] for v, k in zip(x, keep(x), strict=True)], np.full((len(x), width), np.nan)
        for places, rows in _by_length(some):
            if rows.shape[1] > 1:
                out[places] = fits(rows)
        return out

    return of


def weibull_of(x: Column) -> Column:
    """struct<shape, scale> fitted to an array of peaks."""
    return _struct_fit(x, "struct<shape:double,scale:double>", _of_some(fit_weibulls, lambda v: v > 0, 2))


def weibull_tail_of(x: Column) -> Column:
    """struct<shape, scale>: the mean of seven least-squares fits to the empirical distribution above its 60 to 90 %."""
    return _struct_fit(x, "struct<shape:double,scale:double>", _of_some(fit_tails, lambda v: v > 0, 2))


def gumbel_of(x: Column) -> Column:
    return _struct_fit(x, "struct<loc:double,scale:double>", fit_gumbels)


def gev_of(x: Column) -> Column:
    return _struct_fit(x, "struct<c:double,loc:double,scale:double>", fit_gevs)


def over_threshold_of(x: Column, threshold: float | None = None) -> Column:
    """struct<threshold, n, n_over, c, scale>: a Pareto fit of the peaks over a threshold, mean + 1.4 deviations by default."""

    def fits(v):
        at = v.mean(1) + 1.4 * v.std(1) if threshold is None else np.full(len(v), float(threshold))
        over = v - at[:, None]
        p = _of_some(fit_paretos, lambda u: u > 0, 2)(over)
        out = np.stack([at, np.full(len(v), float(v.shape[1])), (v > at[:, None]).sum(1), *p.T], 1)
        return np.where(np.isnan(p[:, :1]), np.nan, out)

    return _struct_fit(x, "struct<threshold:double,n:double,n_over:double,c:double,scale:double>", fits)


def hazen(x: np.ndarray, share: float) -> float:
    """The quantile that puts the i-th of n sorted values at (i - 1/2) / n."""
    x = np.sort(x)
    return float(np.interp(share * len(x) - 0.5, np.arange(len(x)), x))


def window_size(peaks: np.ndarray, hours: float) -> float:
    """The lag, in samples, at which the autocorrelation first falls below 1/2, of lags up to two weeks."""
    d = peaks - peaks.mean()
    n = min(int(14 * 24 / hours), len(d) - 1)
    size = 1 << int(2 * len(d) - 1).bit_length()
    acf = np.fft.irfft(np.abs(np.fft.rfft(d, size)) ** 2, size)[: n + 1]
    below = np.flatnonzero(acf / acf[0] < 0.5)
    return float(below[0]) if len(below) else float(n)


def declustered(places: np.ndarray, heights: np.ndarray, excess: np.ndarray, window: float) -> np.ndarray:
    """Which peaks (by rank) stand for storms: going from storm to storm, each one's peak is found by climbing to the next
    higher one within the window, until none is left.

    A published oddity is kept: a height climbs if it is above the other's excess over the threshold.
    """
    storms, i = [], 0
    while i < len(places):
        beyond = int(np.searchsorted(places, places[i] + window, "right"))
        climb = np.flatnonzero(heights[i + 1 : beyond] > excess[i])
        if not len(climb):
            storms.append(i)
        i = i + 1 + int(climb[0]) if len(climb) else beyond
    return np.array(storms, int)


def storm_peaks(x: np.ndarray, share: float, hours: float) -> np.ndarray:
    """Excesses over the quantile `share` of the peaks of independent storms, in order."""
    y = x - hazen(x, share)
    side = np.sign(y)
    cycles = np.append(np.flatnonzero(side[1:] > side[:-1]), len(y) - 1)
    if len(cycles) < 2:
        return np.zeros(0)
    tops = cycles[:-1] + np.array([part.argmax() for part in np.split(y, cycles)[1:-1]])
    return y[tops[declustered(tops, x[tops], y[tops], window_size(x, hours))]]


# Fixed values of the threshold search: storms a year that a threshold leaves, how little its best may move at the end, and
# by how many of the finer steps the grid goes on below its first and above its last point.
STORMS_A_YEAR, SETTLED, BELOW, ABOVE = 2, 0.0005, 9, 5


def finest(score, span: tuple[float, float, float], most: int) -> float:
    """The point of the highest score on a grid (first, end, step) that gets ten times finer around its best point, at most
    `most` grids, until that moves by less than SETTLED. A grid ends before the first point without a score."""
    (low, high, step), best = span, math.nan
    for _ in range(most):
        grid = np.arange(low, high, step)
        scores = list(itertools.takewhile(lambda v: v is not None, map(score, grid)))
        if not scores:
            break
        i = int(np.argmax(scores))
        last, best = best, float(grid[i])
        if abs(best - last) < SETTLED:
            break
        step /= 10
        around = np.concatenate([[grid[0] - BELOW * step], grid, [grid[-1] + ABOVE * step]])
        low, high = around[i], around[i + 2]
    return best


def automatic_threshold(x: np.ndarray, hours: float, span: tuple[float, float, float] = (0.99, 0.995, 0.001), most: int = 5) -> tuple[float, float]:
    """Share and value of the threshold whose fitted tail has the quantiles that correlate best with those of all values,
    among thresholds that leave STORMS_A_YEAR."""
    n, years, ordered = len(x), len(x) * hours / (24 * 365.25), np.sort(x)
    ends = 0.5 ** (1 / n)
    place = np.concatenate([[1 - ends], (np.arange(2, n) - 0.3175) / (n + 0.365), [ends]])

    def score(share: float) -> float | None:
        over = storm_peaks(x, share, hours)
        fitted = fit_pareto(over) if len(over) >= STORMS_A_YEAR * years else None
        if fitted is None:
            return None
        c, scale = fitted
        tail = -np.log1p(-place)
        return float(np.corrcoef(scale * (tail if abs(c) < 1e-9 else np.expm1(c * tail) / c), ordered)[0, 1])

    best = finest(score, span, most)
    return (best, hazen(x, best)) if best == best else (-1.0, math.nan)


def automatic_threshold_of(x: Column, hours: float) -> Column:
    return _struct_fit(x, "struct<share:double,value:double>", lambda rows: [automatic_threshold(v, hours) for v in rows])


# --- most likely extreme response ----------------------------------------------------------------------------------


def mler_coefficients(f: Column, s: Column, re: Column, im: Column, response: float) -> Column:
    """array<struct<f, spectrum, phase>>: the waves, per frequency, that most likely give a response, of a wave spectrum
    and a complex response amplitude operator (arrays; frequencies in radians a second)."""

    def of(b: Column) -> Column:
        m0, m1, m2 = b["m0"], b["m1"], b["m2"]
        step = 2 * math.pi / (F.size(b["f"]) - 1)
        rows = F.arrays_zip(b["f"].alias("f"), b["s"].alias("s"), b["rao"].alias("rao"), b["phase"].alias("phase"))

        def one(p: Column) -> Column:
            share = (m2 - p["f"] * m1 + m1 / m0 * (p["f"] * m0 - m1)) / (m0 * m2 - m1 * m1)
            a = p["rao"] * F.sqrt(2 * p["s"] * step) * share
            phase = -p["phase"] - F.when(a < 0, math.pi).otherwise(0.0) + (math.pi if response < 0 else 0.0)
            return F.struct(p["f"].alias("f"), (p["s"] * a * a * response**2).alias("spectrum"), phase.alias("phase"))

        return F.transform(rows, one)

    def turned(b: Column) -> Column:
        """Angles without jumps of more than half a turn."""
        state = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))

        def add(a: Column, v: Column) -> Column:
            near = F.when(a["last"].isNull(), v).otherwise(v - 2 * math.pi * F.round((v - a["last"]) / (2 * math.pi)))
            return F.struct(F.concat(a["out"], F.array(near)).alias("out"), near.alias("last"))

        return F.aggregate(b["a"], state, add, lambda a: a["out"])

    rao = F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y))
    plain = F.transform(s, lambda v: v / (2 * math.pi))
    respond = F.zip_with(rao, plain, lambda r, v: r * r * 2 * v)
    angle = arrays.bind(turned, a=F.zip_with(re, im, lambda x, y: F.atan2(y, x)))
    return arrays.bind(of, f=f, s=plain, rao=rao, phase=angle, m0=moment(0, f, respond), m1=moment(1, f, respond), m2=moment(2, f, respond))


def mler_elevation(t: Column, x: Column, waves: Column, k: Column, width: Column) -> Column:
    """Surface at time and place (from those of the peak) of the waves of mler_coefficients and their wave numbers."""
    both = F.zip_with(waves, k, lambda w, q: F.sqrt(2 * w["spectrum"] * width) * F.cos(w["f"] * t - q * x + w["phase"]))
    return arrays.total(both)


def mler_response(t: Column, waves: Column, rao: Column, width: Column) -> Column:
    """Linear response at a time from that of the peak; its phase is left out, as at the peak all terms add up."""
    return arrays.total(F.zip_with(waves, rao, lambda w, r: F.sqrt(2 * w["spectrum"] * width) * r * F.cos(w["f"] * t)))


def mler_normalised(waves: Column, k: Column, width: Column, amplitude: float, times: list[float], places: list[float]) -> Column:
    """waves scaled so that the highest surface over the times and places is `amplitude`."""
    ts, xs = (F.array(*[F.lit(float(v)) for v in c]) for c in (times, places))

    def of(b: Column) -> Column:
        top = F.array_max(F.transform(ts, lambda t: F.array_max(F.transform(xs, lambda x: F.abs(mler_elevation(t, x, b["w"], b["k"], b["d"]))))))
        return arrays.bind(lambda c: F.transform(c["w"], lambda w: F.struct(w["f"].alias("f"), (w["spectrum"] * c["r"] * c["r"]).alias("spectrum"), w["phase"].alias("phase"))), w=b["w"], r=abs(amplitude) / top)

    return arrays.bind(of, w=waves, k=k, d=width)
