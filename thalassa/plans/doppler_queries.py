"""Doppler velocimeters: ensembles, turbulence, rotations, spectra, profiles, cleaning, discharge; moored lines."""

from __future__ import annotations


from pyspark.sql import functions as F

from thalassa.functions import angles
from thalassa.operators import doppler, spectral
from thalassa.sources.tables import spectra, table

from .registry import query, rounded

_V = "v AS (SELECT year(l_shipdate)::INTEGER AS y, l_orderkey::DOUBLE AS t, l_quantity - 20 AS u, l_discount * 100 - 3 AS v, l_tax * 100 - 4 AS w FROM lineitem)"


def _velocities(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_shipdate", "l_orderkey", "l_quantity", "l_discount", "l_tax")
    return line.select(F.year("l_shipdate").alias("y"), F.col("l_orderkey").cast("double").alias("t"), (F.col("l_quantity") - 20).alias("u"), (F.col("l_discount") * 100 - 3).alias("v"), (F.col("l_tax") * 100 - 4).alias("w"))


_COV = "(covar_pop({0}, {1}) - covar_pop(t, {0}) * covar_pop(t, {1}) / var_pop(t))"


@query(
    f"""WITH {_V}, a AS (SELECT y, avg(u) AS u, avg(v) AS v, avg(w) AS w, {_COV.format('u', 'u')} - 0.01 AS upup, {_COV.format('v', 'v')} - 0.01 AS vpvp, {_COV.format('w', 'w')} - 0.04 AS wpwp, {_COV.format('u', 'v')} AS upvp, {_COV.format('u', 'w')} AS upwp, {_COV.format('v', 'w')} AS vpwp,
      stddev_pop(sqrt(u * u + v * v)) AS us, avg(sqrt(u * u + v * v)) AS sp FROM v GROUP BY 1), b AS (SELECT *, sqrt(u * u + v * v) AS m, (upup + vpvp + wpwp) / 2 AS k FROM a)
    SELECT y, round(m, 6) AS u_mag, round((90 - degrees(atan2(v, u)) + 360) % 360, 5) AS u_dir, round(upup, 5) AS upup, round(vpvp, 5) AS vpvp, round(wpwp, 5) AS wpwp, round(upvp, 5) AS upvp, round(upwp, 5) AS upwp, round(vpwp, 5) AS vpwp, round(k, 5) AS tke,
      round(sqrt(upwp ** 2 + upvp ** 2 + vpwp ** 2), 5) AS e_coh, round(sqrt(2 * k) / m, 6) AS i_tke, round(us / m, 6) AS i, round(sqrt(us * us - 0.01), 6) AS speed_rms, round(sqrt(us * us - 0.01) / sp, 6) AS turbulence_intensity FROM b"""
)
def turbulence(spark, sf_dir):
    d = doppler.turbulence(_velocities(spark, sf_dir), ["y"], "t", "u", "v", "w", noise=(0.1, 0.1, 0.2)).drop("u", "v", "w")
    five = ["u_dir", "upup", "vpvp", "wpwp", "upvp", "upwp", "vpwp", "tke", "e_coh"]
    return rounded(rounded(d, *five, digits=5), *[c for c in d.columns if c not in (*five, "y")])


@query(f"WITH {_V} SELECT y, round(covar_pop(u, v), 6) AS upvp, round(var_pop(w), 6) AS wpwp FROM v GROUP BY 1")
def reynolds_stress_demeaned(spark, sf_dir):
    return rounded(doppler.turbulence(_velocities(spark, sf_dir), ["y"], "t", "u", "v", "w", line=False).select("y", "upvp", "wpwp"), "upvp", "wpwp")


@query(f"WITH {_V} SELECT y, round(avg(u), 6) AS u, round(avg(v), 6) AS v, round(avg(w), 6) AS w, round(stddev_pop(sqrt(u * u + v * v)), 6) AS u_std, round(var_pop(u), 6) AS u_var, round(var_pop(w), 6) AS w_var FROM v GROUP BY 1")
def bin_average(spark, sf_dir):
    v = _velocities(spark, sf_dir)
    out = doppler.bin_average(v, ["y"], ["u", "v", "w"]).join(doppler.bin_variance(v, ["y"], ["u", "w"]), "y")
    return rounded(out, "u", "v", "w", "u_std", "u_var", "w_var")


@query(
    """WITH e AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, regr_slope(value, event_id) OVER w AS s, avg(event_id) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round(value - m, 8) AS demeaned, round(value - m - coalesce(s, 0) * (event_id - t), 5) AS detrended FROM e"""
)
def residuals(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumns({"demeaned": F.col("value"), "detrended": F.col("value")})
    d = doppler.with_residuals(doppler.with_residuals(e, ["user_id"], "event_id", ["demeaned"], line=False), ["user_id"], "event_id", ["detrended"])
    return d.select("event_id", F.round("demeaned", 8).alias("demeaned"), F.round("detrended", 5).alias("detrended"))


@query(
    f"""WITH {_V}, f AS (SELECT y, u, v, CASE WHEN v <= 0 THEN -u ELSE u END AS a, CASE WHEN v <= 0 THEN -v ELSE v END AS b, sqrt(u * u + v * v) AS s FROM v), c AS (SELECT y, u, v, CASE WHEN s > 0 THEN (a * a - b * b) / s ELSE 0 END AS re, CASE WHEN s > 0 THEN 2 * a * b / s ELSE 0 END AS im FROM f),
    h AS (SELECT y, round(90 - degrees(atan2(avg(im), avg(re)) / 2), 4) AS heading, round(90 - degrees(atan2(avg(v), avg(u))), 4) AS mean_heading FROM c GROUP BY 1)
    SELECT y, heading, mean_heading, round(5 * cos(radians(heading - 90)) - 2 * sin(radians(heading - 90)), 6) AS along, round(5 * sin(radians(heading - 90)) + 2 * cos(radians(heading - 90)), 6) AS across FROM h"""
)
def principal_heading(spark, sf_dir):
    v = _velocities(spark, sf_dir)
    h = doppler.principal_heading(v, ["y"], "u", "v").join(doppler.principal_heading(v, ["y"], "u", "v", tidal=False).withColumnRenamed("heading", "mean_heading"), "y")
    along, across = doppler.to_principal(F.lit(5.0), F.lit(2.0), F.col("heading"))
    return h.select("y", "heading", "mean_heading", F.round(along, 6).alias("along"), F.round(across, 6).alias("across"))


@query(
    """WITH p AS (SELECT p_partkey AS k, radians(p_partkey % 360) AS h, radians(p_size - 25) AS p, radians(p_partkey % 31 - 15) AS r FROM part), c AS (SELECT k, cos(h) AS ch, sin(h) AS sh, cos(p) AS cp, sin(p) AS sp, cos(r) AS cr, sin(r) AS sr FROM p),
    m AS (SELECT k, ch * cr + sh * sp * sr AS a, sh * cp AS b, ch * sr - sh * sp * cr AS c, ch * sp * sr - sh * cr AS d, ch * cp AS e, -sh * sr - ch * sp * cr AS f, -cp * sr AS g, sp AS h, cp * cr AS i FROM c)
    SELECT k, round(a + 2 * b + 3 * c, 8) AS east, round(d + 2 * e + 3 * f, 8) AS north, round(g + 2 * h + 3 * i, 8) AS up, round(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g), 9) AS det FROM m"""
)
def rotate_to_earth(spark, sf_dir):
    k = F.col("p_partkey")
    m = angles.orientation(k % 360, F.col("p_size") - 25, k % 31 - 15)
    e, n, u = angles.dot(m, (F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(k.alias("k"), F.round(e, 8).alias("east"), F.round(n, 8).alias("north"), F.round(u, 8).alias("up"), F.round(angles.determinant(m), 9).alias("det"))


@query(
    """WITH p AS (SELECT p_partkey AS k, (p_partkey * 7 % 3600) / 10.0::DOUBLE AS h, (p_size - 25)::DOUBLE AS p, (p_partkey % 31 - 15)::DOUBLE AS r FROM part)
    SELECT k, round((90 - (90 - h) + 360) % 360, 5) AS heading, round(p, 5) AS pitch, round(r, 5) AS roll, CASE WHEN h + 15 > 180 THEN round(h + 15 - 360, 5) ELSE round(h + 15, 5) END AS declined, round(sin(radians(h + 15)) * cos(radians(p)), 7) AS east_of_x FROM p"""
)
def euler_round_trip(spark, sf_dir):
    k = F.col("p_partkey")
    h, p, r = (k * 7 % 3600) / 10.0, (F.col("p_size") - 25).cast("double"), (k % 31 - 15).cast("double")
    m = angles.euler(h, p, r)
    a = angles.heading_pitch_roll(m)
    turned, heading = doppler.declined(m, h, 15.0)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("k"), (F.round(F.pmod(F.round(a["heading"], 7), F.lit(360.0)), 5)).alias("heading"), F.round(a["pitch"], 5).alias("pitch"), F.round(a["roll"], 5).alias("roll"), F.round(heading, 5).alias("declined"), F.round(turned[0][0], 7).alias("east_of_x")
    )


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, (p_partkey % 7)::DOUBLE AS b, (p_partkey % 11)::DOUBLE AS c, (p_partkey % 3 + 1)::DOUBLE AS d FROM part), n AS (SELECT k, a / s AS w, b / s AS x, c / s AS y, d / s AS z FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS s FROM p))
    SELECT k, round(1 - 2 * (y * y + z * z), 8) AS xx, round(2 * (x * y - w * z), 8) + 0.0 AS xy, round(2 * (x * z + w * y), 8) AS xz, round(2 * (x * y + w * z), 8) AS yx, round(1 - 2 * (x * x + y * y), 8) AS zz,
      round(1 / (2 * sin(radians(20))) * (w - x), 7) + 0.0 AS beam_x, round(1 / (4 * cos(radians(20))) * (w + x + y + z), 7) AS beam_z, round(1 / (2 * sin(radians(20)) * sqrt(2)) * (w + x - y - z), 7) + 0.0 AS beam_error FROM n"""
)
def quaternions_and_beams(spark, sf_dir):
    k = F.col("p_partkey")
    parts = [F.col("p_size").cast("double"), (k % 7).cast("double"), (k % 11).cast("double"), (k % 3 + 1).cast("double")]
    size = F.sqrt(sum((c * c for c in parts[1:]), parts[0] * parts[0]))
    q = table(spark, sf_dir, "part", "p_partkey", "p_size").select(k.alias("k"), *[(c / size).alias(n) for c, n in zip(parts, "wxyz")])
    m = angles.of_quaternion(*[F.col(n) for n in "wxyz"])
    beam = [sum((F.lit(a) * F.col(n) for a, n in zip(row, "wxyz")), F.lit(0.0)) for row in angles.beam_matrix(20)]
    c = {"xx": m[0][0], "xy": m[0][1], "xz": m[0][2], "yx": m[1][0], "zz": m[2][2]}
    return q.select("k", *[(F.round(v, 8) + 0.0).alias(n) for n, v in c.items()], (F.round(beam[0], 7) + 0.0).alias("beam_x"), F.round(beam[2], 7).alias("beam_z"), (F.round(beam[3], 7) + 0.0).alias("beam_error"))


_PSD = "x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT vec_id, i, i / 100.0::DOUBLE AS f, e * e AS s FROM x)"


@query(
    f"""WITH {_PSD}, n AS (SELECT vec_id, sqrt(avg(s * f) FILTER (f BETWEEN 0.8 * 0.6 AND 0.6)) AS noise, regr_slope(log10(s), log10(f)) FILTER (f > 0.1 AND f < 0.4 AND s > 0) AS slope, (avg(s * f ** (5 / 3.0::DOUBLE) / 0.67) FILTER (f > 0.1 AND f < 0.4)) ** 1.5 / (1.5 / (2 * pi())) AS lt83 FROM p GROUP BY 1),
    c AS (SELECT vec_id, s - 0.01 / 0.6 AS s, min(abs(s - 0.01 / 0.6)) OVER (PARTITION BY vec_id) / 100 AS low FROM p), d AS (SELECT vec_id, sum(CASE WHEN s > 0 THEN s ELSE low END) AS clean FROM c GROUP BY 1)
    SELECT vec_id, round(noise, 8) AS noise, round(slope, 5) AS slope, round(lt83, 6) AS lt83, round(clean, 6) AS clean FROM n JOIN d USING (vec_id)"""
)
def spectrum_turbulence(spark, sf_dir):
    f, s = F.col("f"), F.col("s")
    clean = F.aggregate(doppler.less_noise(s, 0.1, 1.2), F.lit(0.0), lambda a, x: a + x)
    return spectra(spark, sf_dir).select(
        "vec_id", F.round(doppler.noise_level(f, s, 1.2), 8).alias("noise"), F.round(doppler.cascade_slope(f, s, 0.1, 0.4), 5).alias("slope"), F.round(doppler.dissipation_lt83(f, s, F.lit(1.5), 0.1, 0.4), 6).alias("lt83"), F.round(clean, 6).alias("clean")
    )


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings), d AS (SELECT a.vec_id, l, avg((a.e - b.e) ** 2) / (1.5 / 32 * l) ** (2 / 3.0::DOUBLE) AS c FROM range(8, 16) r(l), x a JOIN x b ON a.vec_id = b.vec_id WHERE a.i = b.i + l GROUP BY 1, 2),
    m AS (SELECT vec_id, avg(e) AS m FROM x GROUP BY 1), z AS (SELECT vec_id, i, e - m AS e FROM x JOIN m USING (vec_id)), a AS (SELECT a.vec_id, l, avg(a.e * b.e) AS c FROM range(0, 16) r(l), z a JOIN z b ON a.vec_id = b.vec_id WHERE a.i = b.i + l GROUP BY 1, 2),
    f AS (SELECT vec_id, min(l) AS first FROM a WHERE c < 0 GROUP BY 1), n AS (SELECT a.vec_id, l, c / first_value(c) OVER (PARTITION BY a.vec_id ORDER BY l) AS r, first FROM a JOIN f USING (vec_id)), t AS (SELECT vec_id, l, r, lag(r) OVER (PARTITION BY vec_id ORDER BY l) AS q FROM n WHERE l < first),
    i AS (SELECT vec_id, sum(coalesce((r + q) / 2 / 32, 0)) * 1.5 AS length FROM t GROUP BY 1), s AS (SELECT vec_id, (median(c) / 2.1) ** 1.5 AS sf FROM d GROUP BY 1), v AS (SELECT vec_id, max(c) FILTER (l = 3) AS lag3 FROM a GROUP BY 1)
    SELECT vec_id, round(sf, 5) AS sf, round(lag3, 8) AS lag3, round(length, 8) AS length FROM s JOIN v USING (vec_id) JOIN i USING (vec_id)"""
)
def structure_function(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("u"))
    e = e.withColumn("a", doppler.autocovariance(F.col("u"), 16)).where(F.exists("a", lambda v: v < 0))
    return e.select("vec_id", F.round(doppler.dissipation_sf(F.col("u"), F.lit(1.5), 32.0), 5).alias("sf"), F.round(F.get("a", F.lit(3)), 8).alias("lag3"), F.round(doppler.integral_length(F.col("a"), F.lit(1.5), 32.0), 8).alias("length"))


_Z = "z AS (SELECT l_orderkey AS o, l_linenumber * 0.5::DOUBLE AS z, avg(l_quantity) AS u, avg(l_discount * 100) AS v, avg(l_tax - 0.04) AS s FROM lineitem GROUP BY 1, 2)"


def _profiles(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return line.groupBy(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") * 0.5).alias("z")).agg(F.avg("l_quantity").alias("u"), F.avg(F.col("l_discount") * 100).alias("v"), F.avg(F.col("l_tax") - 0.04).alias("s"))


def _gradient(c: str) -> str:
    return f"CASE WHEN pz IS NULL THEN (lead({c}) OVER w - {c}) / (nz - z) WHEN nz IS NULL THEN ({c} - lag({c}) OVER w) / (z - pz) ELSE (lead({c}) OVER w - lag({c}) OVER w) / (2 * (nz - z)) END"


@query(
    f"""WITH {_Z}, n AS (SELECT *, lag(z) OVER w AS pz, lead(z) OVER w AS nz FROM z WINDOW w AS (PARTITION BY o ORDER BY z)), g AS (SELECT o, z, {_gradient('u')} AS du, {_gradient('v')} AS dv, CASE WHEN pz IS NOT NULL AND nz IS NOT NULL THEN (lead(u) OVER w - lag(u) OVER w) / (2 * (nz - z)) END AS centred FROM n WINDOW w AS (PARTITION BY o ORDER BY z))
    SELECT o, z, round(du, 6) + 0.0 AS dudz, round(dv, 6) + 0.0 AS dvdz, round(du * du + dv * dv, 5) AS shear2, round(-centred, 6) + 0.0 AS centred FROM g"""
)
def shear(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    d = doppler.gradients(p, ["o"], "z", ["u", "v"])
    c = doppler.gradients(p, ["o"], "z", ["u"], "centered", down=True).select("o", "z", F.col("dudz").alias("centred"))
    d = d.join(c, ["o", "z"])
    return d.select("o", "z", (F.round("dudz", 6) + 0.0).alias("dudz"), (F.round("dvdz", 6) + 0.0).alias("dvdz"), F.round(doppler.shear_squared(F.col("dudz"), F.col("dvdz")), 5).alias("shear2"), (F.round("centred", 6) + 0.0).alias("centred"))


@query(
    f"""WITH {_Z}, i AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY z) - 1 AS i FROM z), m AS (SELECT o, avg(sign(s)) * avg(s / (1 - z / 20)) AS m FROM i WHERE i BETWEEN 1 AND 4 GROUP BY 1) SELECT o, round(CASE WHEN m >= 0 THEN sqrt(m) END, 7) AS u_star FROM m"""
)
def friction_velocity(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("depth", F.lit(20.0))
    return rounded(doppler.friction_velocity(p, ["o"], "z", "s", "depth"), "u_star", digits=7)


@query(
    """WITH v AS (SELECT p_partkey AS k, p_size + 1.0 AS a, p_partkey % 9 AS b, p_partkey % 13 AS c, p_partkey % 4 AS d FROM part) SELECT k, round((a - b) / (4 * sin(radians(25)) * cos(radians(25))), 7) AS upwp, round((c - d) / (4 * sin(radians(25)) * cos(radians(25))), 7) AS vpwp,
    round((c * 10000 / (9.81 * (1027 - 0.15 * (d - 10) + 0.0045 * c))) + 0.5, 6) AS depth, c > (10 - 0.5) * cos(radians(25)) - 1 + 0.5 AS above, CASE WHEN b > 5 THEN a END::DOUBLE AS filtered, CASE WHEN abs(d - 2) > 1 THEN -1 ELSE d - 2 END::DOUBLE AS limited,
    round(2.0 * c - 3.0 * b, 6)::DOUBLE AS vx, round(3.0 * a - 1.0 * c, 6)::DOUBLE AS vy, round(1.0 * b - 2.0 * a, 6)::DOUBLE AS vz FROM v"""
)
def profiler_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    a, b, c, d = F.col("p_size") + 1.0, (k % 9).cast("double"), (k % 13).cast("double"), (k % 4).cast("double")
    uw, vw = doppler.stresses_4beam([a, b, c, d], 25)
    x, y, z = doppler.tangential_velocity((F.lit(1.0), F.lit(2.0), F.lit(3.0)), (a, b, c))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("k"), F.round(uw, 7).alias("upwp"), F.round(vw, 7).alias("vpwp"), F.round(doppler.depth_from_pressure(c, d, offset=0.5)[0], 6).alias("depth"), doppler.above_surface(c, F.lit(10.0), 25, 1, 0.5).alias("above"),
        doppler.correlation_filter(a, b, 5).alias("filtered"), doppler.exceeding(d - 2, 1, -1.0).alias("limited"), F.round(x, 6).alias("vx"), F.round(y, 6).alias("vy"), F.round(z, 6).alias("vz"),
    )


@query(
    f"""WITH {_Z}, b AS (SELECT o // 400 AS e, o, z, round(z / 0.5)::BIGINT AS c, u FROM z), d AS (SELECT *, u - avg(u) OVER (PARTITION BY e, z) AS v FROM b), p AS (SELECT d.e, d.z, i, avg((d.v - q.v) ** 2) AS d FROM range(1, 7) r(i), d JOIN d q ON d.o = q.o WHERE d.c = q.c + i AND i > 1 GROUP BY 1, 2, 3),
    f AS (SELECT e, z, regr_slope(d, (i * 0.5) ** 2 / 3) AS s, regr_intercept(d, (i * 0.5) ** 2 / 3) AS n, count(*) AS k FROM p GROUP BY 1, 2) SELECT e, z, round(CASE WHEN s >= 0 THEN (s / 2.1) ** 1.5 END, 3) AS epsilon, round(CASE WHEN n >= 0 THEN sqrt(n / 2) END, 5) AS noise FROM f WHERE k > 1"""
)
def dissipation_profile(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("e", F.floor(F.col("o") / 400).cast("long"))
    return rounded(rounded(doppler.dissipation_profile(p, ["e"], "o", "z", "u", 0.5, 0.5, 3.0), "epsilon", digits=3), "noise", digits=5)


@query(
    """WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 6 > 0 THEN value END AS x FROM events) SELECT event_id, round(CASE WHEN 5 - count(x) OVER w <= 3 THEN median(x) OVER w END, 6) AS filtered FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def median_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("x", F.when(F.col("event_id") % 6 > 0, F.col("value")))
    return rounded(doppler.median_filter(e, ["user_id"], "ts", "x", 5, 3).select("event_id", "filtered"), "filtered")


@query(
    f"""WITH {_Z}, s AS (SELECT o, z, u FROM z UNION ALL SELECT o, 0.0::DOUBLE, arg_min(u, z) FROM z GROUP BY 1), l AS (SELECT *, lag(u) OVER w AS pu, lag(z) OVER w AS pz FROM s WINDOW w AS (PARTITION BY o ORDER BY z)), d AS (SELECT o, sum(coalesce((z - pz) * (u + pu) / 2, 0)) AS q, sum(coalesce((z - pz) * (u ** 3 + pu ** 3) / 2, 0)) AS c FROM l GROUP BY 1),
    x AS (SELECT o // 4000 AS g, o, q, c, lag(q) OVER w AS pq, lag(c) OVER w AS pc, o - lag(o) OVER w AS dx FROM d WINDOW w AS (PARTITION BY o // 4000 ORDER BY o)), f AS (SELECT g, sum(dx * (q + pq) / 2) AS q, 0.5 * 1025 * sum(dx * (c + pc) / 2) AS p FROM x GROUP BY 1), j AS (SELECT o // 4000 AS g, avg(0.5 * 1025 * u ** 3) AS j FROM z GROUP BY 1)
    SELECT g, round(q, 3) AS q, round(p / 1e6, 3) AS p, round(j, 3) AS j FROM f JOIN j USING (g)"""
)
def discharge(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("g", F.floor(F.col("o") / 4000).cast("long"))
    d = doppler.discharge(p, ["g"], "o", "z", "u", 1025.0)
    return d.select("g", F.round("q", 3).alias("q"), F.round(F.col("p") / 1e6, 3).alias("p"), F.round("j", 3).alias("j"))


@query(
    """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE * 100 AS a, generate_subscripts(embedding, 1) - 1 AS i, label FROM embeddings), t AS (SELECT vec_id, arg_max(i, (a, -i)) AS top FROM a GROUP BY 1), d AS (SELECT vec_id, i - 1 AS i, a - lag(a) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM a),
    f AS (SELECT vec_id, coalesce(max(i) FILTER (d < 0), 0) + 1 AS fall FROM d WHERE i >= 0 GROUP BY 1), r AS (SELECT d.vec_id, count(*) FILTER (d >= 10 AND i >= top) > 0 AS rises FROM d JOIN t USING (vec_id) WHERE i >= 0 GROUP BY 1)
    SELECT vec_id, CASE WHEN rises THEN ((top + 1) / 2.0 + (fall + 1) / 2.0) / 2 END::DOUBLE AS depth FROM t JOIN f USING (vec_id) JOIN r USING (vec_id)"""
)
def depth_from_amplitude(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("a"))
    return e.select("vec_id", doppler.depth_from_amplitude([(i + 1) / 2 for i in range(64)], [F.col("a")]).alias("depth"))


@query()
def despike_gn(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    w = spectral.windows(e, ["event_type"], "ts", ["value"], 256)
    return w.select("event_type", "block", doppler.despike_gn(F.col("value")).alias("spikes"))


@query()
def dissipation_te01(spark, sf_dir):
    s = spectra(spark, sf_dir)
    integral = doppler.integral_te01(F.lit(0.3) + F.col("vec_id") % 10 / 20, F.radians(F.col("vec_id") % 90))
    x, y = F.col("f"), F.col("s")
    return s.withColumn("integral", integral).select("vec_id", "integral", doppler.dissipation_te01(x, y, y, y, F.lit(1.5), F.col("integral"), 0.1, 0.4).alias("epsilon"))


@query()
def velocity_of_acceleration(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.select("vec_id", doppler.high_passed_integral(F.col("a"), 16.0, 0.03, 0.1).alias("velocity"))


