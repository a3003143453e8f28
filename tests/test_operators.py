import math

import pytest
from pyspark.sql import functions as F

from thalassa.operators import flow, wave


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("f,h", [(0.05, 10.0), (0.1, 50.0), (0.3, 200.0), (0.01, 5.0)])
def test_wave_number_solves_dispersion(spark, f, h):
    k = one(spark, wave.wave_number(F.lit(f), F.lit(h)))
    assert wave.G * k * math.tanh(k * h) == pytest.approx((2 * math.pi * f) ** 2, rel=1e-9)


def test_polynomial_and_froude(spark):
    assert one(spark, flow.polynomial(F.lit(2.0), [1.0, -3.0, 5.0])) == 3.0
    assert one(spark, flow.froude_number(F.lit(2.0), F.lit(5.0))) == pytest.approx(2 / math.sqrt(9.80665 * 5))


def test_spectrum_has_its_height(spark):
    f = F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: i / 1000.0)
    df = spark.range(1).select(f.alias("f")).select("f", F.transform("f", lambda x: wave.pierson_moskowitz(x, F.lit(8.0), F.lit(2.5))).alias("s"))
    r = wave.sea_state(df).first()
    assert r.hm0 == pytest.approx(2.5, rel=0.01)
    assert r.tp == pytest.approx(8.0, rel=0.01)
