"""Environmental contours: the sea states that are exceeded once in a return period, of a site's joint wave record.

A site's record is an array per variable (x1, usually height; x2, usually period), one row per site; each method is an
Arrow function that fits the record and gives the contour as array<struct<x1, x2>>. Sites run side by side; a record has
to fit in one task (a century of hourly sea states is 7 MB per variable). Rows where either value is missing, or not
above 0 where a logarithm is taken, are left out; records of fewer than MIN_ROWS rows give null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .loads import fit_weibull, nelder_mead

MIN_ROWS = 50
_erf = np.vectorize(math.erf)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def inverted(cdf, p: np.ndarray, low: float, high: float, steps: int = 80) -> np.ndarray:
    """x with cdf(x) = p, by halving [low, high]."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, float(low)), np.full(p.shape, float(high))
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def normal_ppf(p: np.ndarray) -> np.ndarray:
    return inverted(normal_cdf, p, -12, 12)


def weibull_ppf(p, shape: float, scale: float):
    return scale * (-np.log1p(-np.asarray(p))) ** (1 / shape)


def lognormal_ppf(p, mean, std):
    return np.exp(mean + std * normal_ppf(p))


def inverse_gaussian_cdf(x, mu: float, lam: float):
    x = np.maximum(x, 1e-300)
    a = np.sqrt(lam / x)
    with np.errstate(over="ignore", invalid="ignore"):
        return normal_cdf(a * (x / mu - 1)) + np.exp(np.minimum(2 * lam / mu, 700)) * normal_cdf(-a * (x / mu + 1))


def circle(seconds: float, years: float, steps: int) -> dict[str, np.ndarray]:
    """The circle of standard normal pairs that are exceeded once in `years`, sea states lasting `seconds`."""
    exceeded = seconds / (3600 * 24 * 365) / years
    radius = float(normal_ppf(np.array([1 - exceeded]))[0])
    angle = np.linspace(0, 2 * np.pi, steps)
    x, y = radius * np.cos(angle), radius * np.sin(angle)
    return {"exceeded": exceeded, "radius": radius, "x": x, "y": y, "px": normal_cdf(x), "py": normal_cdf(y)}


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Rank correlation with ties (tau-b), by counting inversions in a merge sort: n log n."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)

    def pairs(*columns):
        _, c = np.unique(np.stack(columns), axis=1, return_counts=True)
        return float((c * (c - 1) / 2).sum())

    swaps, width, part = 0.0, 1, y.copy()
    while width < n:
        out = np.empty_like(part)
        for lo in range(0, n, 2 * width):
            a, b = part[lo : lo + width], part[lo + width : lo + 2 * width]
            # elements of b that go before elements of a
            swaps += float((len(a) - np.searchsorted(a, b, "right")).sum())
            out[lo : lo + len(a) + len(b)] = np.sort(np.concatenate([a, b]), kind="stable")
        part, width = out, 2 * width
    total, tx, ty, both = n * (n - 1) / 2, pairs(x), pairs(y), pairs(x, y)
    return (total - tx - ty + both - 2 * swaps) / math.sqrt((total - tx) * (total - ty))


def marginals(x1: np.ndarray, x2: np.ndarray) -> tuple[tuple[float, float], tuple[float, float]]:
    """Weibull shape and scale of x1, mean and deviation of the logarithm of x2."""
    logs = np.log(x2)
    return fit_weibull(x1), (float(logs.mean()), float(logs.std()))


def conditional(x1: np.ndarray, x2: np.ndarray, least: int = 40, first: float = 1.0, width: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (from the constant on) of the mean (cubic) and deviation (square) of the logarithm of x2 given x1.

    x1 goes up in cells of `width` from `first` on until one holds fewer than `least` rows; every two neighbouring cells
    are fitted together, the first two from the start, what is left from the last but one on.
    """
    order = np.argsort(x1, kind="stable")
    x, logs = x1[order], np.log(x2[order])
    while (ends := [int(np.searchsorted(x, first, "right"))])[0] < max(1, least) and ends[0] < len(x):
        first += width
    while ends[-1] < len(x):
        ends.append(int(np.searchsorted(x, first + width * len(ends), "right")))
        if ends[-1] - ends[-2] < least:
            break
    spans = [(0, ends[0]), *([(0, ends[1])] if len(ends) > 1 else []), *((a, b) for a, b in zip(ends, ends[2:])), (ends[-2] if len(ends) > 1 else 0, len(x))]
    spans = [(a, b) for a, b in spans if b > a]
    # the mean of the first two cells leaves out their last row
    at = np.array([x[a : max(b - 1, a + 1)].mean() if i < 2 else x[a:b].mean() for i, (a, b) in enumerate(spans)])
    mean, std = (np.array([f(logs[a:b]) for a, b in spans]) for f in (np.mean, np.std))
    fit = lambda v, n: np.linalg.lstsq(np.vander(at, n, increasing=True), v, rcond=None)[0]
    return fit(mean, 4), fit(std, 3)


def principal_axes(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The axes of most and least variance, as rows, with signs so that both components of the first are positive."""
    _, v = np.linalg.eigh(np.cov(np.stack([x1, x2])))
    axes = np.abs(v.T[::-1])
    axes[1, 1] *= -1
    return axes


def from_components(c1, c2, axes: np.ndarray, shift: float):
    """x1 and x2 of the components."""
    a, b = axes[0, 0], axes[0, 1]
    return (b * (c2 - shift) + a * c1) / (a * a + b * b), (b * c1 - a * (c2 - shift)) / (a * a + b * b)


def principal_fit(x1: np.ndarray, x2: np.ndarray, size: int = 250) -> dict:
    """Components, inverse Gaussian of the first, line of the mean and square of the deviation of the second given it."""
    axes = principal_axes(x1, x2)
    c = np.stack([x1, x2], 1) @ axes
    shift = abs(c[:, 1].min()) + 0.1
    order = np.argsort(c[:, 0], kind="stable")
    c1, c2 = c[order, 0], c[order, 1] + shift
    mu = float(c1.mean())
    lam = float(1 / (1 / c1 - 1 / mu).mean())
    size = int(min(size, len(c1) // 4))
    cuts = list(range(0, len(c1) // size * size + 1, size))
    spans = [*zip(cuts, cuts[1:]), *([(cuts[-1], len(c1))] if cuts[-1] < len(c1) else [])]
    m1, m2, sd = (np.array([f(v[a:b]) for a, b in spans]) for f, v in ((np.mean, c1), (np.mean, c2), (np.std, c2)))
    slope, intercept = np.polyfit(m1, m2, 1)

    def loss(q):
        # at 0 and at its lowest point the deviation is not below 0
        bad = min(q[2], 0) ** 2 + (min(q[2] - q[1] ** 2 / (4 * q[0]), 0) ** 2 if q[0] else 0)
        return ((np.polyval(q, m1) - sd) ** 2).mean() + 1e3 * bad

    free = np.polyfit(m1, sd, 2)
    start = free if np.isfinite(loss(free)) and loss(free) < loss(np.full(3, 0.1)) else np.full(3, 0.1)
    return {"axes": axes, "shift": shift, "mu": mu, "lam": lam, "slope": slope, "intercept": intercept, "sigma": nelder_mead(loss, start, 800)}


def pca_contour(x1, x2, c, steps, size: int = 250):
    f = principal_fit(x1, x2, size)
    c1 = inverted(lambda v: inverse_gaussian_cdf(v, f["mu"], f["lam"]), c["px"], 0, f["mu"] * 1000)
    mean, std = f["slope"] * c1 + f["intercept"], np.polyval(f["sigma"], c1)
    a, b = from_components(c1, mean + std * normal_ppf(c["py"]), f["axes"], f["shift"])
    return np.maximum(a, 0), b


def gaussian_second(c, tau):
    """The probability of x2 along the contour under a Gaussian copula."""
    rho = math.sin(tau * math.pi / 2)
    return normal_cdf(c["y"] * math.sqrt(1 - rho * rho) + rho * c["x"])


def clayton_second(c, tau):
    t = 2 * tau / (1 - tau)
    u, v = c["px"], c["py"]
    return ((1 - u**-t + u**-t / v) ** (t / (1 + t))) ** (-1 / t)


def gumbel_density(u, v, theta: float):
    """Density of a Gumbel copula."""
    a, b = (-np.log(u)) ** theta, (-np.log(v)) ** theta
    s = (a + b) ** (1 / theta)
    return np.exp(-s) / (u * v) * (a * b) ** (1 - 1 / theta) * s ** (1 - 2 * theta) * (s + theta - 1)


def _lookup(grid: np.ndarray, cdf: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The middle of the two points of a grid between which a distribution function passes p."""
    at = np.clip(np.searchsorted(cdf, p), 1, len(grid) - 1)
    return (grid[at] + grid[at - 1]) / 2


def gumbel_second(c, tau, grid: np.ndarray, density: np.ndarray, cumulated: np.ndarray) -> np.ndarray:
    """x2 along the contour under a Gumbel copula, of a grid of x2 with its density and distribution function."""
    theta = 1 / (1 - tau)
    v = np.clip(cumulated, 1e-12, 1 - 1e-12)
    step = grid[1] - grid[0]
    return np.array([_lookup(grid, np.cumsum(gumbel_density(np.clip(u, 1e-12, 1 - 1e-12), v, theta) * density) * step, np.array([p]))[0] for u, p in zip(c["px"], c["py"])])


def kernel_marginal(x: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Density and distribution function on a grid, by Gaussian kernels of a width from the median deviation."""
    mad = np.median(np.abs(x - np.median(x))) / 0.6745
    width = (mad or x.std() or 1) * (4 / (3 * len(x))) ** 0.2
    density = np.zeros(len(grid))
    for lo in range(0, len(x), 4096):
        density += np.exp(-0.5 * ((grid[:, None] - x[lo : lo + 4096]) / width) ** 2).sum(1)
    density /= len(x) * width * math.sqrt(2 * math.pi)
    return density, np.cumsum(density) * (grid[1] - grid[0])


def _kernels(x1, x2, n: int = 1000):
    g1, g2 = np.linspace(0, x1.max() * 2, n), np.linspace(0, x2.max() * 2, n)
    return g1, kernel_marginal(x1, g1), g2, kernel_marginal(x2, g2)


def _parametric(second):
    def of(x1, x2, c, steps):
        w, (mean, std) = marginals(x1, x2)
        tau = kendall_tau(x2, x1)
        return weibull_ppf(c["px"], *w), second(x1, x2, c, tau, mean, std)

    return of


def _gumbel(x1, x2, c, tau, mean, std):
    grid = np.linspace(1e-6, x2.max() * 2, 1000)
    z = (np.log(grid) - mean) / std
    return gumbel_second(c, tau, grid, np.exp(-z * z / 2) / (grid * std * math.sqrt(2 * math.pi)), normal_cdf(z))


def rosenblatt_contour(x1, x2, c, steps):
    w, _ = marginals(x1, x2)
    mean, std = conditional(x1, x2)
    first = weibull_ppf(c["px"], *w)
    return first, lognormal_ppf(c["py"], np.polyval(mean[::-1], first), np.polyval(std[::-1], first))


def _nonparametric(second):
    def of(x1, x2, c, steps):
        g1, (_, p1), g2, (d2, p2) = _kernels(x1, x2)
        return _lookup(g1, p1, c["px"]), second(c, kendall_tau(x2, x1), g2, d2, p2)

    return of


def kernel_contour(x1, x2, c, steps, log: bool = False, n: int = 100):
    """The line on which a joint kernel density, on a grid of n by n, is the exceeded probability: the outermost grid
    points above it, joined by angle about the mean."""
    a, b = (np.log(x1), np.log(x2)) if log else (x1, x2)
    widths = [v.std() * len(v) ** (-1 / 6) for v in (a, b)]
    grids = [np.linspace(v.min() - 4 * w, v.max() + 6 * w, n) for v, w in zip((a, b), widths)]
    kernel = lambda g, v, w: np.exp(-0.5 * ((g[:, None] - v) / w) ** 2) / (w * math.sqrt(2 * math.pi))
    density = np.zeros((n, n))
    for lo in range(0, len(a), 4096):
        density += kernel(grids[0], a[lo : lo + 4096], widths[0]) @ kernel(grids[1], b[lo : lo + 4096], widths[1]).T
    density /= len(a)
    centre = np.array([a.mean(), b.mean()])
    out = []
    for angle in np.linspace(0, 2 * np.pi, steps):
        # along each ray the last place where the density, between grid points by planes, is above the level
        reach = np.linspace(0, 1, 400)[:, None] * np.array([np.cos(angle) * np.ptp(grids[0]), np.sin(angle) * np.ptp(grids[1])]) + centre
        at = [np.clip((reach[:, k] - grids[k][0]) / (grids[k][1] - grids[k][0]), 0, n - 1.001) for k in (0, 1)]
        i, j = (v.astype(int) for v in at)
        s, t = at[0] - i, at[1] - j
        d = density[i, j] * (1 - s) * (1 - t) + density[i + 1, j] * s * (1 - t) + density[i, j + 1] * (1 - s) * t + density[i + 1, j + 1] * s * t
        inside = (reach[:, 0] <= grids[0][-1]) & (reach[:, 0] >= grids[0][0]) & (reach[:, 1] <= grids[1][-1]) & (reach[:, 1] >= grids[1][0])
        over = np.flatnonzero((d >= c["exceeded"]) & inside)
        out.append(reach[over[-1]] if len(over) else centre)
    line = np.array(out)
    return (np.exp(line[:, 0]), np.exp(line[:, 1])) if log else (line[:, 0], line[:, 1])


METHODS = {
    "pca": pca_contour,
    "gaussian": _parametric(lambda x1, x2, c, tau, mean, std: lognormal_ppf(gaussian_second(c, tau), mean, std)),
    "clayton": _parametric(lambda x1, x2, c, tau, mean, std: lognormal_ppf(clayton_second(c, tau), mean, std)),
    "gumbel": _parametric(_gumbel),
    "rosenblatt": rosenblatt_contour,
    "nonparametric_gaussian": _nonparametric(lambda c, tau, g, d, p: _lookup(g, p, gaussian_second(c, tau))),
    "nonparametric_clayton": _nonparametric(lambda c, tau, g, d, p: _lookup(g, p, clayton_second(c, tau))),
    "nonparametric_gumbel": _nonparametric(gumbel_second),
    "kde": kernel_contour,
    "kde_log": lambda x1, x2, c, steps: kernel_contour(x1, x2, c, steps, log=True),
}


def environmental_contour(x1: Column, x2: Column, seconds: float, years: float, method: str = "pca", steps: int = 1000) -> Column:
    """array<struct<x1, x2>>: the contour of a site's record by a method of METHODS."""
    fit, around = METHODS[method], circle(seconds, years, steps)

    @F.pandas_udf("struct<x1:array<double>,x2:array<double>>")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for u, v in zip(a, b):
            u, v = (np.asarray([] if w is None else w, float) for w in (u, v))
            good = np.isfinite(u) & np.isfinite(v) & (u > 0) & (v > 0) if len(u) == len(v) else np.zeros(len(u), bool)
            out.append(fit(u[good], v[good], around, steps) if good.sum() >= MIN_ROWS else (None, None))
        return pd.DataFrame(out, columns=["x1", "x2"])

    both = of(x1, x2)
    return F.arrays_zip(both["x1"].alias("x1"), both["x2"].alias("x2"))


def samples_on_contour(t: np.ndarray, contour_t: np.ndarray, contour_h: np.ndarray) -> np.ndarray:
    """Heights at periods t on the upper branch of a closed contour."""
    lo, hi = sorted((int(np.argmin(contour_t)), int(np.argmax(contour_t))))
    inner = np.arange(lo, hi)
    outer = np.append(np.arange(hi, len(contour_t)), np.arange(lo))
    upper = inner if contour_h[inner].max(initial=-np.inf) > contour_h[outer].max(initial=-np.inf) else outer
    upper = upper[np.argsort(contour_t[upper], kind="stable")]
    return np.interp(t, contour_t[upper], contour_h[upper])


def samples_between(lines: list[float], per: int, seed: int) -> dict[str, np.ndarray]:
    """Standard normal pairs in the rings between circles of given radius and beyond the last, `per` to a ring: radius by
    equal parts of probability, angle at random; weight is the probability that each stands for."""
    rng = np.random.default_rng(seed)
    radii = np.append(0.0, np.asarray(lines, float))
    # the radius of a standard normal pair is exceeded with exp(-r^2 / 2)
    over = np.append(np.exp(-(radii**2) / 2), 0.0)
    x, y, w = [], [], []
    for a, b in zip(over, over[1:]):
        p = a - (a - b) * rng.random(per)
        r, angle = np.sqrt(-2 * np.log(np.maximum(p, 1e-300))), rng.random(per) * 2 * np.pi
        x.append(r * np.cos(angle)), y.append(r * np.sin(angle)), w.append(np.full(per, (a - b) / per))
    return {"x": np.concatenate(x), "y": np.concatenate(y), "weight": np.concatenate(w)}


def full_sea_state_samples(x1: np.ndarray, x2: np.ndarray, per: int, years: list[float], seconds: float, seed: int = 0) -> dict[str, np.ndarray]:
    """Sea states between the contours of several return periods, by principal components, with weights that add to 1."""
    f = principal_fit(x1, x2)
    s = samples_between([circle(seconds, y, 2)["radius"] for y in years], per, seed)
    c1 = inverted(lambda v: inverse_gaussian_cdf(v, f["mu"], f["lam"]), normal_cdf(s["x"]), 0, f["mu"] * 1000)
    a, b = from_components(c1, f["slope"] * c1 + f["intercept"] + np.polyval(f["sigma"], c1) * s["y"], f["axes"], f["shift"])
    return {"x1": np.maximum(a, 0), "x2": b, "weight": s["weight"]}
