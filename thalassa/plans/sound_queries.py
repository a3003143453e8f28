"""Underwater sound: levels, exposures, bands, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalassa.operators import acoustics
from thalassa.sources.tables import table

from .registry import query, rounded

#: The spectra of these queries: 64 densities every 100 Hz from 100 Hz on.
GRID = [100.0 * (i + 1) for i in range(64)]
_S = "s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT vec_id, i, i * 100.0::DOUBLE AS f, e * e AS s FROM s)"


def _spectra(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform("embedding", lambda _, i: (i + 1) * 100.0).alias("f"), F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("s"))


def _trapezoid(y: str) -> str:
    return f"sum(CASE WHEN before IS NOT NULL THEN 100 * ({y} + before) / 2 END)"


@query(f"WITH {_S}, l AS (SELECT *, lag(s) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM p WHERE f BETWEEN 500 AND 5000) SELECT vec_id, round(10 * log10({_trapezoid('s')} / 1e-12), 6) AS spl FROM l GROUP BY 1")
def sound_pressure_level(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", F.round(acoustics.sound_pressure_level(F.col("f"), F.col("s"), 500, 5000), 6).alias("spl"))


_W = {g: (f"({c} + 10 * log10((f / 1000 / {f1}) ** (2 * {a}) / ((1 + (f / 1000 / {f1}) ** 2) ** {a} * (1 + (f / 1000 / {f2}) ** 2) ** {b})))", f"({k} - 10 * log10((f / 1000 / {f1}) ** (2 * {a}) / ((1 + (f / 1000 / {f1}) ** 2) ** {a} * (1 + (f / 1000 / {f2}) ** 2) ** {b})))") for g, (a, b, f1, f2, c, k) in acoustics.GROUPS.items()}


@query(
    f"WITH {_S}, w AS (SELECT vec_id, i, f, s, {', '.join(f's * 10 ** ({w} / 10) AS {g}' for g, (w, _) in _W.items())} FROM p), l AS (SELECT *, lag(s) OVER o AS s0, {', '.join(f'lag({g}) OVER o AS {g}0' for g in _W)} FROM w WINDOW o AS (PARTITION BY vec_id ORDER BY i)) "
    f"SELECT vec_id, round(10 * log10(sum(50 * (s + s0)) / 1e-12) + 10 * log10(60), 6) AS sel, {', '.join(f'round(10 * log10(sum(50 * ({g} + {g}0)) / 1e-12) + 10 * log10(60), 6) AS {g}' for g in _W)} FROM l GROUP BY 1"
)
def sound_exposure_level(spark, sf_dir):
    f, s = F.col("f"), F.col("s")
    return _spectra(spark, sf_dir).select("vec_id", F.round(acoustics.sound_exposure_level(f, s, 60), 6).alias("sel"), *[F.round(acoustics.sound_exposure_level(f, s, 60, g), 6).alias(g) for g in acoustics.GROUPS])


@query(
    f"SELECT p_partkey, {', '.join(f'round({w}, 6) AS w_{g}, round({e}, 6) AS e_{g}' for g, (w, e) in _W.items())}, round(1500 / (4 * p_size * sqrt(1 - (1500 / 1700.0::DOUBLE) ** 2)), 6) AS fmin, round(10 * log10(p_retailprice / 1e-12), 6) AS level FROM (SELECT *, p_size * 200.0::DOUBLE AS f FROM part)"
)
def auditory_weighting(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    f = F.col("p_size") * 200.0
    both = {g: acoustics.auditory_weighting(f, g) for g in acoustics.GROUPS}
    return p.select(
        "p_partkey", *[F.round(c, 6).alias(f"{k}_{g}") for g, v in both.items() for k, c in zip("we", v)], F.round(acoustics.minimum_frequency(F.col("p_size")), 6).alias("fmin"), F.round(acoustics.spectral_density_level(F.col("p_retailprice")), 6).alias("level")
    )


@query(
    f"""WITH {_S}, c AS (SELECT vec_id, i, s, CASE WHEN f BETWEEN 500 AND 2000 THEN -180 + (f - 500) / 1500 * 10 WHEN f BETWEEN 2000 AND 4000 THEN -170 + (f - 2000) / 2000 * 5 ELSE -175 END AS db FROM p)
    SELECT vec_id, i::INTEGER AS i, round(s / 10 ** (db / 10) / 1e12, 5) AS s FROM c"""
)
def apply_calibration(spark, sf_dir):
    c = acoustics.calibrated(F.col("f"), F.col("s"), [500, 2000, 4000], [-180, -170, -165], -175)
    return _spectra(spark, sf_dir).select("vec_id", F.posexplode(c).alias("i", "s")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("s", 5).alias("s"))


def _bands(per: int, base: float) -> str:
    """SQL rows of the bands of GRID, from their definition."""
    n = f"ceil((log10(6400) - log10(100)) / (log10({base}) / {per}))"
    return f"""b AS (SELECT k, n, 10 ** (2 + k * log10({base}) / {per}) AS centre FROM (SELECT unnest(range(0, {n}::BIGINT)) AS k, {n} AS n)),
    t AS (SELECT centre, centre / {base} ** (1 / (2.0::DOUBLE * {per})) AS lo, CASE WHEN k = n - 1 THEN 6400 ELSE centre * {base} ** (1 / (2.0::DOUBLE * {per})) END AS hi FROM b)"""


_WEIGHT = "CASE WHEN f - 50 >= lo AND f + 50 <= hi THEN 1 WHEN f - 50 < lo THEN (100 - (lo - (f - 50))) / 100 WHEN f + 50 > hi THEN (100 - (f + 50 - hi)) / 100 ELSE 0 END"
_OVER = "((f BETWEEN lo AND hi) OR (f + 50 > lo AND f - 50 < hi))"


def _band_sql(per: int, base: float) -> str:
    return f"""WITH {_S}, {_bands(per, base)}, o AS (SELECT vec_id, centre, lo, hi, f, s, {_WEIGHT} AS w, f - 50 >= lo AND f + 50 <= hi AS whole FROM p JOIN t ON {_OVER}),
    d AS (SELECT vec_id, centre, sum(s * w) * 100 / max(hi - lo) AS s FROM o GROUP BY 1, 2)"""


def _level_sql(per: int, base: float) -> str:
    """Trapezoids of whole bins and of weighted ones, apart."""
    return f"""{_band_sql(per, base)}, l AS (SELECT *, lag(s * w) OVER (PARTITION BY vec_id, centre, whole ORDER BY f) AS before FROM o), q AS (SELECT vec_id, centre, sum(coalesce(50 * (s * w + before), 0)) AS q FROM l GROUP BY 1, 2)
    SELECT vec_id, round(centre, 6) AS centre, round(10 * log10(nullif(q, 0) / 1e-12), 5) AS spl FROM q"""


@query(f"{_band_sql(3, 2)} SELECT vec_id, 'third' AS bands, round(centre, 6) AS centre, round(s, 8) AS s FROM d UNION ALL ({_band_sql(10, 10)} SELECT vec_id, 'deci', round(centre, 6), round(s, 8) FROM d)")
def band_spectral_density(spark, sf_dir):
    s = _spectra(spark, sf_dir)
    parts = [s.select("vec_id", F.lit(name).alias("bands"), F.explode(acoustics.band_density(F.col("s"), GRID, per, base)).alias("b")) for name, per, base in (("third", 3, 2), ("deci", 10, 10))]
    return parts[0].unionByName(parts[1]).select("vec_id", "bands", F.round("b.centre", 6).alias("centre"), F.round("b.s", 8).alias("s"))


@query(_level_sql(3, 2))
def third_octave_level(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", F.explode(acoustics.band_level(F.col("s"), GRID, 3, 2)).alias("b")).select("vec_id", F.round("b.centre", 6).alias("centre"), F.round("b.spl", 5).alias("spl"))


@query(_level_sql(10, 10))
def decidecade_level(spark, sf_dir):
    return _spectra(spark, sf_dir).select("vec_id", F.explode(acoustics.band_level(F.col("s"), GRID, 10, 10)).alias("b")).select("vec_id", F.round("b.centre", 6).alias("centre"), F.round("b.spl", 5).alias("spl"))


@query(
    """WITH a AS (SELECT event_type, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000000 AS t, value FROM events) SELECT event_type, (ceil(t / 3600) - 0.5) * 3600 AS centre, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90, round(stddev_pop(value), 6) AS std,
    round(10 * log10(avg(10 ** (value / 10))), 5) AS average, round(10 * log10(sum(10 ** (value / 10))), 5) AS total FROM a WHERE t > 0 GROUP BY 1, 2"""
)
def time_aggregate(spark, sf_dir):
    from thalassa.operators import series

    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    start = e.agg(F.min(series.micros("ts")).alias("start"))
    e = e.join(F.broadcast(start)).select("event_type", ((series.micros("ts") - F.col("start")) / 1e6).alias("t"), "value")
    parts = {"median": "median", "q90": {"quantile": 0.9}, "std": "std"}
    out = None
    for name, method in parts.items():
        d = acoustics.time_aggregate(e, ["event_type"], "t", "value", 3600, method).withColumnRenamed("value", name)
        out = d if out is None else out.join(d, ["event_type", "centre"])
    levels = e.where("t > 0").groupBy("event_type", ((F.ceil(F.col("t") / 3600) - 0.5) * 3600).alias("centre")).agg(series.average_db("value").alias("average"), series.total_db("value").alias("total"))
    out = out.join(levels, ["event_type", "centre"]).withColumn("centre", F.col("centre").cast("double"))
    return rounded(rounded(out, "median", "q90", "std"), "average", "total", digits=5)


@query(
    f"""WITH {_S}, b AS (SELECT unnest(range(0, ceil((log10(5000) - log10(250)) / (log10(2) / 3))::BIGINT)) AS k), t AS (SELECT 10 ** (log10(250) + k * log10(2) / 3) AS centre FROM b), e AS (SELECT centre, centre / 2 ** (1 / 6.0::DOUBLE) AS lo, centre * 2 ** (1 / 6.0::DOUBLE) AS hi FROM t)
    SELECT vec_id, round(centre, 6) AS centre, round(median(s), 8) AS value FROM p JOIN e ON f > lo AND f <= hi GROUP BY 1, 2"""
)
def band_aggregate(spark, sf_dir):
    long = _spectra(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip("f", "s")).alias("p")).select("vec_id", "p.f", "p.s")
    return rounded(rounded(acoustics.band_aggregate(long, ["vec_id"], "f", "s", 3, 2, 250, 5000), "centre"), "value", digits=8)


@query("SELECT p_partkey, round((p_partkey % 30000 - 15000) * (2.5 / 32768), 10) AS volt, round((p_partkey % 30000 - 15000) * (2.5 / 32768) / (10 ** (-177 / 20.0::DOUBLE)) / 1e6, 6) AS pascal FROM part")
def hydrophone_samples(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey")
    volt = acoustics.volts(F.col("p_partkey") % 30000 - 15000, 16, 2.5)
    return p.select("p_partkey", F.round(volt, 10).alias("volt"), F.round(acoustics.pressure(volt, -177), 6).alias("pascal"))


