"""Waves: dispersion, fluxes, surfaces, directions, performance matrices."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from thalassa.functions import arrays
from thalassa.operators import flow, loads, wave
from thalassa.sources.tables import spectra, table

from .registry import query, rounded

_K = """k AS (WITH RECURSIVE r(f, h, k, i) AS (
      SELECT DISTINCT f, h, (2 * pi() * f) ** 2 / 9.80665 / sqrt(tanh((2 * pi() * f) ** 2 * h / 9.80665)), 0 FROM g WHERE f > 0
      UNION ALL SELECT f, h, k - (9.80665 * k * tanh(k * h) - (2 * pi() * f) ** 2) / (9.80665 * tanh(k * h) + 9.80665 * k * h * (1 - tanh(k * h) ** 2)), i + 1 FROM r WHERE i < 30)
    SELECT f, h, k FROM r WHERE i = 30)"""
_CG = "CASE WHEN h / (2 * pi() / k) > 2 THEN pi() * f / k ELSE pi() * f / k * (1 + 2 * h * k / sinh(2 * h * k)) END"


@query(
    f"""WITH g AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS f, (5 + p_partkey % 50)::DOUBLE AS h FROM part), {_K}
    SELECT p_partkey, round(k, 8) AS k, round(2 * pi() / k, 6) AS l, h / (2 * pi() / k) > 2 AS deep, round({_CG.split('ELSE')[1].replace('END', '')}, 6) AS cg, round({_CG}, 6) AS cg_checked FROM g JOIN k USING (f, h)"""
)
def dispersion(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_size") / 100.0).alias("f"), (5 + F.col("p_partkey") % 50).cast("double").alias("h"))
    p = p.withColumn("k", wave.wave_number(F.col("f"), F.col("h")))
    f, h, k = (F.col(c) for c in "fhk")
    return p.select(
        "p_partkey", F.round("k", 8).alias("k"), F.round(wave.wave_length(k), 6).alias("l"), wave.depth_regime(wave.wave_length(k), h).alias("deep"),
        F.round(wave.wave_celerity(f, k, h), 6).alias("cg"), F.round(wave.wave_celerity(f, k, h, True), 6).alias("cg_checked"),
    )


_SPECTRA = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
    y AS (SELECT vec_id, i, i / 100.0::DOUBLE AS f, e * e AS s, CASE WHEN i = 1 THEN 2 / 100.0::DOUBLE - 1 / 100.0::DOUBLE ELSE i / 100.0::DOUBLE - (i - 1) / 100.0::DOUBLE END AS d FROM x)"""


@query(f"WITH {_SPECTRA}, g AS (SELECT DISTINCT f, 20.0::DOUBLE AS h FROM y), {_K} SELECT vec_id, round(1025 * 9.80665 * sum(s * d * {_CG}), 4) AS j FROM y JOIN k USING (f) GROUP BY 1")
def energy_flux_depth(spark, sf_dir):
    return spectra(spark, sf_dir).select("vec_id", F.round(wave.energy_flux(F.col("f"), F.col("s"), F.lit(20.0)), 4).alias("j"))


@query(
    f"""WITH {_SPECTRA}, t AS (SELECT range * 0.5::DOUBLE AS t FROM range(0, 8))
    SELECT vec_id, t, round(sum(sqrt(2 * s * (2 / 100.0::DOUBLE - 1 / 100.0::DOUBLE)) * cos(2 * pi() * f * t + 2 * pi() * ((i * 37) % 100) / 100)), 6) AS eta FROM y, t GROUP BY 1, 2"""
)
def surface_elevation(spark, sf_dir):
    s = spectra(spark, sf_dir).withColumn("phase", F.transform("f", lambda _, i: 2 * math.pi * (((i + 1) * 37) % 100) / 100))
    s = s.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 0.5)))
    return s.select("vec_id", "t", F.round(wave.surface_elevation(F.col("t"), F.col("f"), F.col("s"), F.col("phase")), 6).alias("eta"))


@query(
    f"""WITH {_SPECTRA}, t AS (SELECT range AS t FROM range(0, 130))
    SELECT vec_id, t::INTEGER AS sample, round(sum(sqrt(2 * s / 100::DOUBLE) * cos(2 * pi() * (i * t % 130) / 130 + 2 * pi() * ((i * 37) % 100) / 100)), 6) + 0.0 AS eta FROM y, t GROUP BY 1, 2"""
)
def surface_record(spark, sf_dir):
    s = spectra(spark, sf_dir).select("vec_id", F.concat(F.array(F.lit(0.0)), "f").alias("f"), F.concat(F.array(F.lit(0.0)), "s").alias("s"))
    phase = F.transform("f", lambda _, i: 2 * math.pi * ((i * 37) % 100) / 100)
    eta = wave.surface_record(F.col("f"), F.col("s"), phase, 130)
    return s.select("vec_id", F.posexplode(eta).alias("sample", "eta")).withColumn("eta", F.round("eta", 6) + 0.0)


@query(
    """WITH p AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS r1, p_size / 200.0::DOUBLE AS r2, (p_partkey * 7) % 360 AS a1, (p_partkey * 13) % 360 AS a2, p_retailprice AS s FROM part), d AS (SELECT range * 45 AS d FROM range(0, 8)),
    w AS (SELECT *, degrees((0.5 + r1 * cos(radians(d - a1)) + r2 * cos(2 * radians(d - a2))) / pi()) AS spread FROM p, d) SELECT p_partkey, d::INTEGER AS direction, round(spread, 8) AS spread, round(spread * s, 5) AS spectrum FROM w"""
)
def directional_spectrum(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").withColumn("direction", F.explode(F.sequence(F.lit(0), F.lit(315), F.lit(45))))
    k = F.col("p_partkey")
    spread = wave.spread_function(F.col("direction"), F.col("p_size") / 100, F.col("p_size") / 200, (k * 7) % 360, (k * 13) % 360)
    return p.select("p_partkey", "direction", F.round(spread, 8).alias("spread"), F.round(spread * F.col("p_retailprice"), 5).alias("spectrum"))


_CELLS = """m AS (SELECT floor(l_quantity / 10 / 0.5 + 0.5) * 0.5::DOUBLE AS x_center, floor(l_tax * 100 / 1.0 + 0.5) * 1.0::DOUBLE AS y_center, avg(l_extendedprice / l_quantity) AS cw, avg(l_tax * 100 + 1) AS j,
    count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS share FROM lineitem GROUP BY ALL)"""


def _matrices(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_quantity", "l_tax", "l_extendedprice")
    sea = line.select((F.col("l_quantity") / 10).alias("hm0"), (F.col("l_tax") * 100).alias("te"), wave.capture_width(F.col("l_extendedprice"), F.col("l_quantity")).alias("cw"), (F.col("l_tax") * 100 + 1).alias("j"))
    return wave.performance_matrix(sea, "hm0", "te", "cw", 0.5, 1.0, False), wave.performance_matrix(sea, "hm0", "te", "j", 0.5, 1.0, False)


@query(f"WITH {_CELLS} SELECT x_center, y_center, round(cw * j, 5) AS power FROM m")
def power_matrix(spark, sf_dir):
    return rounded(wave.power_matrix(*_matrices(spark, sf_dir)), "power", digits=5)


@query(f"WITH {_CELLS} SELECT round(8766 * sum(cw * j * share), 3) AS maep, round(sum(share), 9) AS total FROM m")
def maep_matrix(spark, sf_dir):
    capture, flux = _matrices(spark, sf_dir)
    return rounded(rounded(wave.annual_energy_of_matrices(capture, flux, flux), "maep", digits=3), "total", digits=9)


@query(
    """WITH c AS (SELECT year(l_shipdate) AS y, floor(l_tax * 100)::BIGINT AS te_bin, floor(l_quantity / 10 / 0.5)::BIGINT AS hm0_bin, count(*) AS n, sum(l_extendedprice) AS j FROM lineitem GROUP BY ALL), t AS (SELECT y, sum(j) AS total FROM c GROUP BY 1)
    SELECT te_bin, hm0_bin, round(sum(n) / (SELECT count(*) FROM t), 6) AS count, round(sum(j / total) / (SELECT count(*) FROM t), 9) AS share FROM c JOIN t USING (y) GROUP BY 1, 2"""
)
def annual_energy_matrix(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_shipdate", "l_quantity", "l_tax", "l_extendedprice").select("l_shipdate", (F.col("l_quantity") / 10).alias("hm0"), (F.col("l_tax") * 100).alias("te"), F.col("l_extendedprice").alias("j"))
    return rounded(rounded(wave.annual_energy_matrix(line, "l_shipdate", "hm0", "te", "j", 0.5, 1.0), "count"), "share", digits=9)


@query(
    """WITH r AS (SELECT o_orderkey, month(o_orderdate)::INTEGER AS month, o_totalprice AS p FROM orders), a AS (SELECT *, count(*) OVER (PARTITION BY month) AS n, rank() OVER (PARTITION BY month ORDER BY p) + (count(*) OVER (PARTITION BY month, p) - 1) / 2.0::DOUBLE AS k FROM r)
    SELECT o_orderkey, month, round(1 - (n - k + 1) / (n + 1), 9) AS cdf FROM a"""
)
def monthly_cumulative_distribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("month", F.month("o_orderdate"))
    return flow.exceedance_probability(o, "o_totalprice", ["month"]).select("o_orderkey", "month", F.round(1 - F.col("f") / 100, 9).alias("cdf"))


@query("SELECT month(o_orderdate)::INTEGER AS month, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 5) AS q25, round(quantile_cont(o_totalprice, 0.5), 5) AS q50, round(quantile_cont(o_totalprice, 0.75), 5) AS q75 FROM orders GROUP BY 1")
def monthly_boxplot(spark, sf_dir):
    return rounded(rounded(wave.monthly_statistics(table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice"), "mean", digits=4), "q25", "q50", "q75", digits=5)


@query(
    """SELECT p_partkey, round(p_size / (0.8255 + 0.03852 * 3.3 - 0.005537 * 3.3 ** 2 + 0.0003154 * 3.3 ** 3), 6) AS tp, round(pi() * p_size / (p_retailprice / 100), 6) AS keulegan_carpenter,
    round(pi() * (p_retailprice / 100) / (p_size * 10), 6) AS diffraction, round(p_size / (p_retailprice / 100), 6) AS height_ratio FROM part"""
)
def wave_numbers_of_devices(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    c = wave.chakrabarti(F.col("p_size"), F.col("p_size") * 10, F.col("p_retailprice") / 100)
    return p.select("p_partkey", F.round(wave.energy_period_to_peak_period(F.col("p_size"), F.lit(3.3)), 6).alias("tp"), *[F.round(v, 6).alias(k) for k, v in c.items()])


@query(
    f"""WITH {_SPECTRA}, g AS (SELECT DISTINCT f, 20.0::DOUBLE AS h FROM y), {_K},
    r AS (SELECT vec_id, sum(s * d) AS m0, sum(s / f * d) AS mn1, 1205 * 9.80665 * sum(s * d * {_CG}) AS j FROM y JOIN k USING (f) GROUP BY 1),
    c AS (SELECT floor(4 * sqrt(m0) / 0.5 + 0.5) * 0.5::DOUBLE AS x_center, floor(mn1 / m0 / 1.0 + 0.5) * 1.0::DOUBLE AS y_center, avg(1000 / j) AS cw, avg(j) AS j FROM r GROUP BY 1, 2) SELECT x_center, y_center, round(cw * j, 5) AS power FROM c"""
)
def power_performance(spark, sf_dir):
    return rounded(wave.power_performance(spectra(spark, sf_dir).withColumn("p", F.lit(1000.0)), 20.0, "p")["power"], "power", digits=5)


# --- extremes ------------------------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT o_orderkey, o_totalprice / 1000 AS x, (o_orderkey % 97 + 1) / 99.0::DOUBLE AS p FROM orders)
    SELECT o_orderkey, round(1 - exp(-((x / 150) ** 1.7)), 9) AS weibull, round(150 * (-ln(1 - p)) ** (1 / 1.7), 6) AS weibull_ppf, round(exp(-exp(-(x - 100) / 50)), 9) AS gumbel, round(100 - 50 * ln(-ln(p)), 6) AS gumbel_ppf,
      round(exp(-(greatest(1 + 0.1 * (x - 100) / 50, 0) ** (1 / -0.1))), 9) AS gev, round(100 + 50 * (1 - (-ln(p)) ** -0.1) / -0.1, 6) AS gev_ppf, round(1 - (1 + 0.2 * x / 80) ** (-1 / 0.2), 9) AS pareto, round((1 - exp(-((x / 150) ** 1.7))) ** 50, 9) AS short_term FROM x"""
)
def extreme_distributions(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    x, p, v = F.col("o_totalprice") / 1000, (F.col("o_orderkey") % 97 + 1) / 99.0, lambda a: F.lit(float(a))
    c = {
        "weibull": (loads.weibull_cdf(x, v(1.7), v(150)), 9), "weibull_ppf": (loads.weibull_ppf(p, v(1.7), v(150)), 6), "gumbel": (loads.gumbel_cdf(x, v(100), v(50)), 9), "gumbel_ppf": (loads.gumbel_ppf(p, v(100), v(50)), 6),
        "gev": (loads.gev_cdf(x, v(-0.1), v(100), v(50)), 9), "gev_ppf": (loads.gev_ppf(p, v(-0.1), v(100), v(50)), 6), "pareto": (loads.pareto_cdf(x, v(0.2), v(80)), 9),
        "short_term": (loads.short_term_extreme_cdf(loads.weibull_cdf(x, v(1.7), v(150)), v(50)), 9),
    }
    return o.select("o_orderkey", *[F.round(e, d).alias(k) for k, (e, d) in c.items()])


@query(
    """SELECT o_custkey, round(sum(w * c) / sum(w), 9) AS cdf, round(max(n * 10800.0::DOUBLE / 86400), 6) AS peaks, max(round(150 * (-ln(1 / (50 * 365.25 * 24 / 3))) ** (1 / 1.7), 6)) AS year50 FROM
    (SELECT o_custkey, o_orderkey % 7 + 1 AS w, 1 - exp(-((o_totalprice / 1000 / 150) ** 1.7)) AS c, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1"""
)
def long_term_extreme(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    o = o.select("o_custkey", (F.col("o_orderkey") % 7 + 1).alias("w"), loads.weibull_cdf(F.col("o_totalprice") / 1000, F.lit(1.7), F.lit(150.0)).alias("c"))
    n = o.groupBy(F.col("o_custkey").alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    out = loads.long_term_extreme(o, ["o_custkey"], "c", "w").join(n, F.col("o_custkey") == F.col("_k"))
    year = loads.weibull_ppf(F.lit(loads.return_probability(50, 3)), F.lit(1.7), F.lit(150.0))
    return out.select("o_custkey", F.round("cdf", 9).alias("cdf"), F.round(loads.short_term_peaks(F.col("n"), F.lit(86400.0), 10800.0), 6).alias("peaks"), F.round(year, 6).alias("year50"))


_MLER = f"""WITH {_SPECTRA}, w AS (SELECT vec_id, i, f, s / (2 * pi()) AS s, 1 / (1 + f) AS rao, d FROM y), r AS (SELECT *, rao * rao * 2 * s AS rs FROM w),
    m AS (SELECT vec_id, sum(rs * d) AS m0, sum(rs * f * d) AS m1, sum(rs * f * f * d) AS m2 FROM r GROUP BY 1),
    a AS (SELECT r.*, rao * sqrt(2 * s * 2 * pi() / 63) * (m2 - f * m1 + m1 / m0 * (f * m0 - m1)) / (m0 * m2 - m1 * m1) AS a FROM r JOIN m USING (vec_id)),
    c AS (SELECT vec_id, i, f, s * a * a * 9 AS spectrum, CASE WHEN a < 0 THEN -pi() ELSE 0 END - f / 10 AS phase, rao FROM a)"""


def _mler(spark, sf_dir):
    s = spectra(spark, sf_dir)
    re, im = F.transform("f", lambda x: F.cos(x / 10) / (1 + x)), F.transform("f", lambda x: F.sin(x / 10) / (1 + x))
    return s.select("vec_id", "f", loads.mler_coefficients(F.col("f"), F.col("s"), re, im, 3.0).alias("w"))


@query(f"{_MLER} SELECT vec_id, i::INTEGER AS i, round(spectrum, 6) AS spectrum, round(phase, 6) AS phase FROM c")
def mler_coefficients(spark, sf_dir):
    return _mler(spark, sf_dir).select("vec_id", F.posexplode("w").alias("i", "w")).select("vec_id", (F.col("i") + 1).alias("i"), F.round("w.spectrum", 6).alias("spectrum"), F.round("w.phase", 6).alias("phase"))


@query(
    f"""{_MLER}, t AS (SELECT range - 2 AS t FROM range(0, 5)) SELECT vec_id, t::INTEGER AS t, round(sum(sqrt(2 * spectrum * 0.01) * cos(f * t + phase)), 6) AS wave, round(sum(sqrt(2 * spectrum * 0.01) * rao * cos(f * t)), 6) AS response FROM c, t GROUP BY 1, 2"""
)
def mler_time_series(spark, sf_dir):
    m = _mler(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    rao, none = F.transform("f", lambda x: 1 / (1 + x)), F.transform("f", lambda x: F.lit(0.0))
    return m.select("vec_id", "t", F.round(loads.mler_elevation(F.col("t"), F.lit(0.0), F.col("w"), none, F.lit(0.01)), 6).alias("wave"), F.round(loads.mler_response(F.col("t"), F.col("w"), rao, F.lit(0.01)), 6).alias("response"))


@query(
    f"""{_MLER}, g AS (SELECT a.range AS t, b.range * 10 AS x FROM range(0, 3) a, range(0, 2) b), e AS (SELECT vec_id, t, x, abs(sum(sqrt(2 * spectrum * 0.01) * cos(f * t - f * f * x + phase))) AS e FROM c, g GROUP BY ALL),
    h AS (SELECT vec_id, max(e) AS top FROM e GROUP BY 1) SELECT vec_id, round(sum(spectrum * (2 / top) ** 2), 5) AS total FROM c JOIN h USING (vec_id) GROUP BY 1"""
)
def mler_normalised(spark, sf_dir):
    m = _mler(spark, sf_dir)
    w = loads.mler_normalised(F.col("w"), F.transform("f", lambda x: x * x), F.lit(0.01), 2.0, [0, 1, 2], [0, 10])
    return m.select("vec_id", F.round(arrays.total(F.transform(w, lambda x: x["spectrum"])), 5).alias("total"))


def _histories(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query()
def damage_equivalent_load(spark, sf_dir):
    return _histories(spark, sf_dir).select("vec_id", F.round(loads.damage_equivalent_load(F.col("x"), 4), 6).alias("load"))


@query()
def extreme_fits(spark, sf_dir):
    # fits take long for a row: more tasks than files
    h = _histories(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    up = F.transform("x", lambda v: F.abs(v) + 0.001)
    return h.select("vec_id", loads.gumbel_of(F.col("x")).alias("gumbel"), loads.gev_of(F.col("x")).alias("gev"), loads.weibull_of(up).alias("weibull"), loads.weibull_tail_of(up).alias("tail"), loads.over_threshold_of(up).alias("over"))


@query()
def environmental_contours(spark, sf_dir):
    """By site (line status): contours of one in 50 years by three methods, of records as arrays."""
    from thalassa.operators import contours

    line = table(spark, sf_dir, "lineitem", "l_linestatus", "l_quantity", "l_tax", "l_discount", "l_orderkey").where("l_orderkey % 7 = 0")
    h, t = F.col("l_quantity") / 10 + F.col("l_discount"), F.col("l_quantity") / 8 + F.col("l_tax") * 100 + 1
    site = line.groupBy("l_linestatus").agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), t.alias("t")))).alias("r"))
    c = lambda m: contours.environmental_contour(F.transform("r", lambda x: x["h"]), F.transform("r", lambda x: x["t"]), 3600, 50, m, 90)
    return site.select("l_linestatus", *[c(m).alias(m) for m in ("pca", "gaussian", "rosenblatt")])
