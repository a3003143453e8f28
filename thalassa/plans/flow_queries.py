"""Rivers and tides: fits, energy, directions, phases, power curves, profiles, grids, regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalassa.functions import angles, codes
from thalassa.operators import flow
from thalassa.sources.tables import table

from .registry import query, rounded


@query(
    """WITH m AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1), z AS (SELECT g, m, sd, (l_quantity - m) / sd AS z, l_extendedprice AS y FROM lineitem JOIN m ON l_returnflag = g),
    s AS (SELECT g, m, sd, count(*)::DOUBLE AS n, sum(z) AS s1, sum(z * z) AS s2, sum(z ** 3) AS s3, sum(z ** 4) AS s4, sum(y) AS t0, sum(z * y) AS t1, sum(z * z * y) AS t2, sum(y * y) AS yy FROM z GROUP BY ALL),
    d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s),
    c AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS a, (n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - t1 * s2)) / det AS b,
      (n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS c FROM d),
    f AS (SELECT *, a * n + b * s1 + c * s2 AS fit, a * t0 + b * t1 + c * t2 AS fy FROM c)
    SELECT g AS l_returnflag, round(a - b * m / sd + c * m * m / sd / sd, 3) AS c0, round(b / sd - 2 * c * m / sd / sd, 4) AS c1, round(c / sd / sd, 6) AS c2, round((fy - fit * t0 / n) ** 2 / ((fy - fit * fit / n) * (yy - t0 * t0 / n)), 8) AS r2 FROM f"""
)
def polynomial_fit(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    fit = flow.polynomial_fit(line, "l_quantity", "l_extendedprice", ["l_returnflag"], 2)
    return fit.select("l_returnflag", F.round("c0", 3).alias("c0"), F.round("c1", 4).alias("c1"), F.round("c2", 6).alias("c2"), F.round("r2", 8).alias("r2"))


@query(
    """WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders), h AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 100), 99)::INT AS c, count(*) AS k FROM orders, r GROUP BY 1),
    g AS (SELECT i, lo + i * (hi - lo) / 999 AS x, CASE WHEN i = 999 THEN 100 ELSE floor((lo + i * (hi - lo) / 999 - lo) / (hi - lo) * 100 + 1e-9)::INT END AS c, lo, hi, n FROM r, range(0, 1000) t(i))
    SELECT round(3600 * sum(x * coalesce(k, 0) / n * 100 / (hi - lo) * (hi - lo) / 999 * CASE WHEN i IN (0, 999) THEN 0.5 ELSE 1 END), 2) AS energy FROM g LEFT JOIN h ON g.c = h.c"""
)
def energy_produced(spark, sf_dir):
    return rounded(flow.energy_produced(table(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice", 3600), "energy", digits=2)


@query(
    """SELECT p_partkey, round(2.0 * p_size ** 3 - 0.5 * p_size + 7, 4) AS velocity, round(p_size / sqrt(9.80665 * (p_partkey % 40 + 1)), 8) AS froude, round(pi() / 4 * p_size ** 2, 6) AS circle, round(sqrt(4 * p_size * 3 / pi()), 8) AS rectangle,
    round(sqrt(p_size ** 2 + 4 + 9), 8) AS several, round(pi() / 4 * (p_size ** 2 + 4 + 9), 6) AS several_area, round(p_size * pi() * 3 / (p_partkey % 5 + 1), 6) AS tip_speed_ratio, round(p_retailprice / (0.5 * 1000 * 4 * p_size ** 3), 8) AS cp,
    round(1.25 * abs((p_retailprice - p_size) / p_retailprice) / 3, 9) AS gci, round(sqrt(CASE WHEN p_size > 5 THEN p_size WHEN p_size > 4 THEN 0 END * 2 / 3) / sqrt(p_size * p_size + 13) * 100, 6) AS ti FROM part"""
)
def river_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    s, k, price = F.col("p_size").cast("double"), F.col("p_partkey"), F.col("p_retailprice")
    several = flow.multiple_circular(F.array(s, F.lit(2.0), F.lit(3.0)))
    energy = F.when(s > 5, s).when(s > 4, -0.00005).otherwise(-1.0)
    c = {
        "velocity": (flow.polynomial(s, [2.0, 0.0, -0.5, 7.0]), 4), "froude": (flow.froude_number(s, k % 40 + 1), 8), "circle": (flow.ducted(s)[1], 6), "rectangle": (flow.rectangular(s, F.lit(3))[0], 8),
        "several": (several[0], 8), "several_area": (several[1], 6), "tip_speed_ratio": (flow.tip_speed_ratio(s, F.lit(3), k % 5 + 1), 6), "cp": (flow.power_coefficient(price, s, F.lit(4), 1000), 8),
        "gci": (flow.grid_convergence_index(price, s, 2), 9), "ti": (flow.turbulent_intensity(energy, s, F.lit(2.0), F.lit(3.0)), 6),
    }
    return p.select("p_partkey", *[F.round(e, d).alias(n) for n, (e, d) in c.items()])


@query(
    """WITH d AS (SELECT (l_partkey * 37 % 360)::DOUBLE AS d FROM lineitem WHERE l_partkey * 37 % 360 < 60 OR l_partkey % 3 = 0), h AS (SELECT least(floor(d / 10), 35)::INT AS b, count(*) AS n FROM d GROUP BY 1),
    f AS (SELECT b % 18 AS b, sum(n) AS n FROM h GROUP BY 1), t AS (SELECT arg_max(b, (n, -b)) AS b FROM f), q AS (SELECT least((b + 90) % 360, (b + 270) % 360) AS q FROM t),
    s AS (SELECT d BETWEEN q AND q + 180 AS first, CASE WHEN d BETWEEN q AND q + 180 THEN d ELSE (d - 180 + 360) % 360 END AS d FROM d, q), r AS (SELECT first, min(d) AS lo, max(d) AS hi FROM s GROUP BY 1),
    c AS (SELECT first, lo, hi, least(floor((d - lo) / (hi - lo) * 18), 17)::INT AS c, count(*) AS n FROM s JOIN r USING (first) GROUP BY ALL), b AS (SELECT first, lo, hi, arg_max(c, (n, -c)) AS c FROM c GROUP BY ALL)
    SELECT round(max(CASE WHEN first THEN lo + (c + 0.5) * (hi - lo) / 18 END), 6) AS direction1, round(max(CASE WHEN NOT first THEN lo + (c + 0.5) * (hi - lo) / 18 END) + 180, 6) AS direction2 FROM b"""
)
def principal_flow_directions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_partkey").select("l_partkey", (F.col("l_partkey") * 37 % 360).cast("double").alias("d"))
    return rounded(flow.principal_flow_directions(line.where("d < 60 OR l_partkey % 3 = 0"), "d", 10), "direction1", "direction2")


@query(
    """WITH d AS (SELECT l_quantity AS v, (l_partkey % 360) >= 175 AND (l_partkey % 360) < 355 AS e FROM lineitem), r AS (SELECT min(v) AS lo, max(v) AS hi FROM d),
    c AS (SELECT lo, hi, least(floor((v - lo) / (hi - lo) * 12), 11)::INTEGER AS bin, count(*) AS n, count(*) FILTER (e) AS k FROM d, r GROUP BY ALL)
    SELECT bin, round(lo + (bin + 0.5) * (hi - lo) / 12, 6) AS centre, round(k / n, 9) AS ebb, round(1 - k / n, 9) AS flood FROM c"""
)
def tidal_phase_probability(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").select((F.col("l_partkey") % 360).alias("d"), "l_quantity")
    return rounded(rounded(flow.phase_probability(line, "d", "l_quantity", 80, 250, 12), "centre"), "ebb", "flood", digits=9)


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, (l_partkey % 360) >= 175 AND (l_partkey % 360) < 355 AS ebb FROM lineitem), a AS (SELECT *, count(*) OVER (PARTITION BY ebb) AS n, rank() OVER (PARTITION BY ebb ORDER BY v) + (count(*) OVER (PARTITION BY ebb, v) - 1) / 2.0::DOUBLE AS k FROM r)
    SELECT ebb, v, round(max(100 * (n - k + 1) / (n + 1)), 9) AS f FROM a GROUP BY 1, 2"""
)
def tidal_phase_exceedance(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity").select(F.col("l_quantity").alias("v"), flow.is_ebb(F.col("l_partkey") % 360, 80, 250).alias("ebb"))
    return flow.exceedance_probability(line, "v", ["ebb"]).groupBy("ebb", "v").agg(F.round(F.max("f"), 9).alias("f"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * cos(radians(l_partkey % 360 - 40)), 6) AS speed, ((l_partkey - 500) % 360 + 360) % 360 AS direction FROM lineitem")
def signed_currents(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(flow.signed_speed(F.col("l_quantity"), F.col("l_partkey") % 360, 40), 6).alias("speed"), angles.normalised((F.col("l_partkey") - 500).cast("double")).cast("long").alias("direction")
    )


_WINDOWS = "w AS (SELECT l_quantity / 20 AS hub, (l_quantity / 18) ** 3 AS weighted, l_extendedprice AS power, l_linenumber * 2.0::DOUBLE AS height, l_tax + 1 AS value, 1000 + l_discount * 100 AS rho FROM lineitem)"


def _windows(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_linenumber", "l_tax", "l_discount")
    q = F.col("l_quantity")
    return line.select((q / 20).alias("hub"), F.pow(q / 18, F.lit(3.0)).alias("weighted"), F.col("l_extendedprice").alias("power"), (F.col("l_linenumber") * 2.0).alias("height"), (F.col("l_tax") + 1).alias("value"), (1000 + F.col("l_discount") * 100).alias("rho"))


@query(
    f"""WITH {_WINDOWS} SELECT ceil(hub / 0.1)::BIGINT AS bin, round(avg(hub), 6) AS u_avg, round(avg(weighted ** (-1 / 3.0::DOUBLE)), 6) AS u_weighted, round(avg(power), 4) AS p_avg, round(stddev_pop(power), 4) AS p_std, max(power) AS p_max, min(power) AS p_min FROM w GROUP BY 1"""
)
def power_curve(spark, sf_dir):
    return rounded(rounded(flow.power_curve(_windows(spark, sf_dir), "hub", "weighted", "power"), "u_avg", "u_weighted"), "p_avg", "p_std", digits=4)


@query(f"WITH {_WINDOWS} SELECT ceil(hub / 0.1)::BIGINT AS bin, round(avg(hub), 6) AS u_avg, round(avg(power) / (0.5 * avg(rho) * 78.5 * avg(hub) ** 3), 8) AS efficiency FROM w GROUP BY 1")
def device_efficiency(spark, sf_dir):
    return rounded(rounded(flow.device_efficiency(_windows(spark, sf_dir), "hub", "power", F.col("rho"), 78.5), "u_avg"), "efficiency", digits=8)


@query(
    f"""WITH {_WINDOWS}, p AS (SELECT ceil(hub / 0.5)::BIGINT AS bin, height, avg(value) AS value FROM w GROUP BY 1, 2)
    SELECT bin, height, round(value, 8) AS value FROM (SELECT * FROM p WHERE height < 10 UNION ALL SELECT DISTINCT bin, 0.0::DOUBLE, 0.0::DOUBLE FROM p UNION ALL SELECT bin, 10.0::DOUBLE, arg_max(value, height) FROM p GROUP BY 1)"""
)
def velocity_profiles(spark, sf_dir):
    return rounded(flow.velocity_profiles(_windows(spark, sf_dir), "height", "hub", "value", 10.0), "value", digits=8)


@query(
    """WITH e AS (SELECT i, 3 - 2 + i * 0.7::DOUBLE AS e FROM range(0, 7) t(i)), m AS (SELECT avg(e) AS m FROM e), y AS (SELECT i, e, greatest(-2, least(2, e - m)) AS y FROM e, m),
    b AS (SELECT i, e, pi() * 2 + y * sqrt(4 - y * y) + 4 * asin(y / 2) AS b FROM y), c AS (SELECT e + 0.35 AS height, lead(b) OVER (ORDER BY i) - b AS area FROM b)
    SELECT 'circle' AS shape, round(height, 6) AS height, round(area, 8) AS area FROM c WHERE area IS NOT NULL
    UNION ALL SELECT 'rectangle', round(3 - 2 + (i + 0.5) * 0.7, 6), round(5 * 0.7, 8) FROM range(0, 6) t(i)"""
)
def capture_slices(spark, sf_dir):
    rows = [("circle", *r) for r in flow.circular_slices(4.0, 3.0, 0.7)] + [("rectangle", *r) for r in flow.rectangular_slices(4.0, 5.0, 3.0, 0.7)]
    return rounded(rounded(spark.createDataFrame(rows, "shape string, height double, area double"), "height"), "area", digits=8)


@query(
    """WITH c AS (SELECT c_custkey, 10 + c_custkey % 45 AS lat, -170 + c_custkey % 110 AS lon FROM customer) SELECT c_custkey,
    CASE WHEN lat BETWEEN 15 AND 27.000002 AND lon BETWEEN -164 AND -151 THEN 'Hawaii' WHEN lat BETWEEN 30.0906 AND 48.8641 AND lon BETWEEN -130.072 AND -116.899 THEN 'West_Coast' WHEN lat BETWEEN 24.382 AND 44.8247 AND lon BETWEEN -81.552 AND -65.721 THEN 'Atlantic' END AS hindcast,
    CASE WHEN lat BETWEEN 41.213 AND 42.642 AND lon BETWEEN -129.09 AND -121.672 THEN 'NW_Pacific' WHEN lat BETWEEN 31.932 AND 42.642 AND lon BETWEEN -129.09 AND -115.806 THEN 'Offshore_CA' WHEN lat BETWEEN 15.565 AND 26.221 AND lon BETWEEN -164.451 AND -151.278 THEN 'Hawaii'
      WHEN lat BETWEEN 41.213 AND 49.579 AND lon BETWEEN -130.831 AND -121.672 THEN 'NW_Pacific' WHEN lat BETWEEN 37.273 AND 42.211 AND lon BETWEEN -76.427 AND -64.8 THEN 'Mid_Atlantic' END AS wind FROM c"""
)
def region_selection(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    lat, lon = 10 + F.col("c_custkey") % 45, -170 + F.col("c_custkey") % 110
    return c.select("c_custkey", codes.region(lat, lon).alias("hindcast"), codes.region(lat, lon, codes.WIND, "NW_Pacific").alias("wind"))
