import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalassa.operators import contours


@pytest.fixture(scope="module")
def site():
    """Heights and periods that go up together."""
    rng = np.random.default_rng(0)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], 4000)
    p = contours.normal_cdf(z[:, 0])
    return contours.weibull_ppf(p, 1.5, 2.0), np.exp(2 + 0.25 * z[:, 1])


def test_normal_and_circle():
    assert contours.normal_ppf(np.array([0.5, 0.975])) == pytest.approx([0, 1.959964], abs=1e-6)
    c = contours.circle(3600, 100, 5)
    assert c["radius"] == pytest.approx(float(contours.normal_ppf(np.array([1 - 1 / (100 * 8760)]))[0]))
    assert np.allclose(np.hypot(c["x"], c["y"]), c["radius"])


def test_kendall_tau_brute():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 12, 150)
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    a, b = (np.sign(v[:, None] - v) ** 2 for v in (x, y))
    assert contours.kendall_tau(x, y) == pytest.approx(s.sum() / math.sqrt(a.sum() * b.sum()))


def test_inverse_gaussian_inverts():
    p = np.array([0.01, 0.5, 0.999])
    x = contours.inverted(lambda v: contours.inverse_gaussian_cdf(v, 3.0, 5.0), p, 0, 3000)
    assert contours.inverse_gaussian_cdf(x, 3.0, 5.0) == pytest.approx(p, abs=1e-9)


def test_copula_density_integrates_to_one():
    u = (np.arange(400) + 0.5) / 400
    assert contours.gumbel_density(u[:, None], u[None, :], 1.6).mean() == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("method", sorted(contours.METHODS))
def test_contours_lie_about_the_record(spark, site, method):
    d = spark.createDataFrame([(1, site[0].tolist(), site[1].tolist()), (2, [1.0], [2.0]), (3, None, [1.0])], "site int, h array<double>, t array<double>")
    got = {r.site: r.c for r in d.select("site", contours.environmental_contour(F.col("h"), F.col("t"), 3600, 50, method, 60).alias("c")).collect()}
    assert got[2] is None and got[3] is None
    line = np.array([(p.x1, p.x2) for p in got[1]])
    assert len(line) == 60 and np.isfinite(line).all()
    # almost all of the record lies within the contour's box, which does not lie far beyond it
    inside = (site[0] <= line[:, 0].max()) & (site[1] <= line[:, 1].max()) & (site[1] >= line[:, 1].min())
    assert inside.mean() > 0.99
    assert line[:, 0].max() < 4 * site[0].max()


def test_gaussian_copula_finds_the_true_contour(site):
    c = contours.circle(3600, 50, 200)
    h, t = contours.METHODS["gaussian"](*site, c, 200)
    assert h.max() == pytest.approx(float(contours.weibull_ppf(c["px"].max(), 1.5, 2.0)), rel=0.08)
    assert t.max() == pytest.approx(math.exp(2 + 0.25 * c["radius"]), rel=0.05)


def test_components_round_trip(site):
    axes = contours.principal_axes(*site)
    c = np.stack(site, 1) @ axes
    a, b = contours.from_components(c[:, 0], c[:, 1] + 0.7, axes, 0.7)
    assert np.allclose(a, site[0]) and np.allclose(b, site[1])


def test_samples(site):
    angle = np.linspace(0, 2 * np.pi, 100)
    h = contours.samples_on_contour(np.array([9.0, 10.0]), 10 + 3 * np.cos(angle), 5 + 2 * np.sin(angle))
    assert h == pytest.approx([5 + 2 * math.sqrt(1 - 1 / 9), 7], abs=0.01)
    s = contours.full_sea_state_samples(*site, 50, [1, 10, 100], 3600)
    assert s["weight"].sum() == pytest.approx(1) and len(s["x1"]) == 200 and (s["x1"] >= 0).all()
