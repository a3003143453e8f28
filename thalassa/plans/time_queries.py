"""Times, packed fields, angles, quality control, spectra of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalassa.functions import angles, codes, times
from thalassa.operators import quality, scans, series, spectral
from thalassa.sources.tables import table

from .registry import query, rounded


@query(
    """SELECT event_id, epoch_us(ts) AS us, (epoch_us(ts) // 86400000000 + 719529)::BIGINT AS matlab_day, round(epoch_us(ts) % 86400000000 / 1000000.0::DOUBLE, 0)::BIGINT AS matlab_second, round(epoch_us(ts) / 1000000, 6) AS epoch, CASE WHEN user_id % 120 > 100 THEN user_id % 120 WHEN user_id % 120 < 90 THEN user_id % 120 + 2000 ELSE user_id % 120 + 1900 END::BIGINT AS year,
    epoch_us(ts) // 1000 * 1000 AS from_excel, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS text FROM events"""
)
def time_conversions(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    us = times.micros("ts")
    ms = F.floor(us / 1000)
    day, past = times.matlab_parts(F.col("ts"))
    back = times.excel_to_datetime(ms / 86_400_000 + times.EXCEL)
    return e.select(
        "event_id", us.alias("us"), day.alias("matlab_day"), F.round(past / 1_000_000).cast("long").alias("matlab_second"), F.round(times.datetime_to_epoch(F.col("ts")), 6).alias("epoch"), times.full_year(F.col("user_id") % 120).cast("long").alias("year"),
        (F.round(F.unix_micros(back) / 1000) * 1000).cast("long").alias("from_excel"), times.text(F.col("ts")).alias("text"),
    )


@query(
    """WITH e AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS w FROM events) SELECT event_id, (w >> 28 & 15)::INTEGER AS wakeup_state, (w >> 25 & 7)::INTEGER AS orient_up, (w >> 5 & 31)::INTEGER AS echo_freq_bin, (w >> 1 & 1)::INTEGER AS bd_scaling,
    CASE WHEN w >> 15 & 1 = 1 THEN (w >> 2 & 1)::INTEGER END AS idle, (w >> 3 & 15)::INTEGER AS n_beams_alt, (w & 1023)::INTEGER AS n_cells, (['ENU', 'XYZ', 'beam', NULL])[(w >> 10 & 3) + 1] AS frame, (w >> 12 & 1048575)::INTEGER AS n_beams,
    ((w >> 4 & 15) * 10 + (w & 15))::INTEGER AS bcd FROM e"""
)
def status_words(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id").withColumn("w", F.col("event_id") * 2654435761 % 4294967296)
    w = F.col("w")
    s, a, b = codes.fields(w, codes.STATUS), codes.fields(w, codes.ALTIMETER), codes.beams(w)
    return e.select(
        "event_id", s["wakeup_state"].alias("wakeup_state"), s["orient_up"].alias("orient_up"), s["echo_freq_bin"].alias("echo_freq_bin"), s["bd_scaling"].alias("bd_scaling"), codes.status0(w)["proc_idle_less_12pct"].alias("idle"),
        a["n_beams_alt"].alias("n_beams_alt"), b["n_cells"].alias("n_cells"), b["frame"].alias("frame"), b["n_beams"].alias("n_beams"), times.of_bcd(w).cast("int").alias("bcd"),
    )


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN '4' || lpad((c_custkey % 9999)::VARCHAR, 4, '0') END AS id, CASE WHEN c_custkey % 3 > 0 THEN (1990 + c_custkey % 30)::VARCHAR END AS year, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 77 END::DOUBLE AS value,
    round(degrees(atan2(sin(radians(c_custkey % 360)) + sin(radians(30)), cos(radians(c_custkey % 360)) + cos(radians(30)))), 6) + 0.0 AS between FROM customer WHERE c_custkey % 360 <> 210"""
)
def buoy_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_custkey % 360 <> 210")
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 > 0, "4").otherwise("44"), F.lpad((k % 9999).cast("string"), 4, "0"), F.lit("w"), (1990 + k % 30).cast("string"), F.lit(".txt.gz"))
    text = F.when(k % 4 == 0, F.when(k % 2 == 0, "MM").otherwise("999.0")).otherwise((k % 77).cast("string"))
    file = codes.buoy_file(name, "swden")
    return c.select("c_custkey", file["id"].alias("id"), file["year"].alias("year"), codes.present(text).alias("value"), (F.round(codes.mean_of_two_angles(k % 360, F.lit(30)), 6) + 0.0).alias("between"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, (p_partkey % 17 - 8)::DOUBLE AS y, (p_partkey % 5 - 2)::DOUBLE AS z FROM part)
    SELECT k, round(sqrt(x * x + y * y + z * z), 8) AS norm, round(atan2(y, x), 8) AS theta, round(atan2(sqrt(x * x + y * y), z), 8) AS phi, CASE WHEN k % 1000 - 300 BETWEEN 0 AND 360 THEN k % 1000 - 300 WHEN k % 1000 - 300 > 360 THEN (k % 1000 - 300 - 1) % 360 + 1 ELSE (k % 1000 - 300 + 360) % 360 END::DOUBLE AS unwrapped,
      round(CASE WHEN (90 - k % 360 + 360) % 360 > 180 THEN (90 - k % 360 + 360) % 360 - 360 ELSE (90 - k % 360 + 360) % 360 END, 6)::DOUBLE AS tidal, round((90 - degrees(atan2(y, x)) + 360) % 360, 6) AS direction,
      round(degrees(atan(sqrt(tan(radians(radians(y))) ** 2 + tan(radians(radians(z))) ** 2))), 9) AS tilt_twice, round(degrees(atan(sqrt(tan(radians(y)) ** 2 + tan(radians(z)) ** 2))), 8) AS tilt FROM p"""
)
def angles_and_magnitudes(spark, sf_dir):
    k = F.col("p_partkey")
    x, y, z = F.col("p_size").cast("double"), (k % 17 - 8).cast("double"), (k % 5 - 2).cast("double")
    m = angles.magnitude_phase(x, y, z)
    d = (k % 1000 - 300).cast("double")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("k"), F.round(m["magnitude"], 8).alias("norm"), F.round(m["theta"], 8).alias("theta"), F.round(m["phi"], 8).alias("phi"), angles.unwrapped(d).alias("unwrapped"), F.round(angles.converted((k % 360).cast("double")), 6).alias("tidal"),
        F.round(angles.direction_to(x, y), 6).alias("direction"), F.round(angles.tilt(z, y), 9).alias("tilt_twice"), F.round(angles.tilt(z, y, twice=False), 8).alias("tilt"),
    )


_QC = "WITH e AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, CASE WHEN event_id % 7 > 0 THEN value END AS x FROM events)"


def _qc(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts", "value").withColumn("x", F.when(F.col("event_id") % 7 > 0, F.col("value")))


@query(
    f"""{_QC} SELECT event_id, x IS NOT NULL AS missing, coalesce(x NOT IN (1.63, 2.5), true) AS corrupt, coalesce(x BETWEEN 1 AND 200, true) AS range,
    coalesce(abs(x - avg(x) OVER (PARTITION BY user_id)) / nullif(stddev_pop(x) OVER (PARTITION BY user_id), 0) <= 2, true) AS outlier FROM e"""
)
def quality_masks(spark, sf_dir):
    e = _qc(spark, sf_dir)
    for name, f in {"missing": lambda d: quality.check_missing(d, "x"), "corrupt": lambda d: quality.check_corrupt(d, "x", [1.63, 2.5]), "range": lambda d: quality.check_range(d, "x", 1, 200), "outlier": lambda d: quality.check_outlier(d, ["user_id"], "ts", "x", 2)}.items():
        e = f(e).withColumnRenamed("ok", name)
    return e.select("event_id", "missing", "corrupt", "range", "outlier")


@query(
    f"""{_QC}, w AS (SELECT *, max(x) OVER o - min(x) OVER o AS d, us - min(us) OVER (PARTITION BY event_type) >= 600000000 AS whole FROM e WINDOW o AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, NOT coalesce((whole AND d < 5) OR d > 150, false) AS ok FROM w"""
)
def quality_delta(spark, sf_dir):
    return quality.check_delta(_qc(spark, sf_dir), ["event_type"], "ts", "x", 5, 150, 600).select("event_id", "ok")


@query(
    """WITH e AS (SELECT user_id % 5 AS u, date_trunc('minute', ts) AS t FROM events), d AS (SELECT DISTINCT u, t FROM e) SELECT u, t AS ts, coalesce(abs(epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY u ORDER BY t) - 60000000) < 500, true) AS ok FROM d"""
)
def quality_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "ts").select((F.col("user_id") % 5).alias("u"), F.date_trunc("minute", "ts").alias("ts"))
    out = quality.check_timestamp(e, ["u"], "ts", 60)
    return out.select("u", F.col("ts").cast("timestamp_ntz").alias("ts"), "ok")


@query(
    """WITH d AS (SELECT DISTINCT user_id % 5 AS u, date_trunc('hour', ts) AS t FROM events), s AS (SELECT u, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM d GROUP BY 1) SELECT s.u, s.t AS ts FROM s ANTI JOIN d ON s.u = d.u AND s.t = d.t"""
)
def missing_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "ts").select((F.col("user_id") % 5).alias("u"), F.date_trunc("hour", "ts").alias("ts"))
    return quality.missing_timestamps(e, ["u"], "ts", 3600).select("u", F.col("ts").cast("timestamp_ntz").alias("ts"))


_WINDOWS = """WITH a AS (SELECT event_type, value AS x, event_id % 13 AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    b AS (SELECT event_type, i // 64 AS block, i % 64 AS j, x, y FROM a WHERE i < n // 64 * 64)"""
_LINE = "regr_slope({0}, j) OVER {1} * (j - avg(j) OVER {1}) + avg({0}) OVER {1}"


def _blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "ts", "value", "event_id").select("event_type", "ts", F.col("value").alias("x"), (F.col("event_id") % 13).alias("y"))
    return spectral.windows(e, ["event_type"], "ts", ["x", "y"], 64)


@query(
    f"""{_WINDOWS}, d AS (SELECT event_type, block, j, x - ({_LINE.format('x', 'w')}) AS x FROM b WINDOW w AS (PARTITION BY event_type, block)), s AS (SELECT d.*, g.s, d.j - g.s * 8 AS m FROM d, range(0, 7) g(s) WHERE d.j BETWEEN g.s * 8 AND g.s * 8 + 15),
    c AS (SELECT event_type, block, s, m, (x - avg(x) OVER (PARTITION BY event_type, block, s)) * (0.5 - 0.5 * cos(2 * pi() * m / 16)) AS v FROM s), f AS (SELECT event_type, block, s, k, sum(v * cos(2 * pi() * k * m / 16)) AS re, sum(v * sin(2 * pi() * k * m / 16)) AS im FROM c, range(0, 9) r(k) GROUP BY ALL)
    SELECT event_type, block::BIGINT AS block, k::INTEGER AS k, round(avg(re * re + im * im) / (2 * 6) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END, 5) AS s FROM f GROUP BY event_type, block, k"""
)
def elevation_spectrum(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("event_type", "block", F.posexplode(spectral.welch(F.col("x"), 2.0, 16)).alias("k", "s"))
    return rounded(b, "s", digits=5)


_CROSS = f"""{_WINDOWS}, s AS (SELECT b.*, g.s, b.j - g.s * 8 AS m FROM b, range(0, 7) g(s) WHERE b.j BETWEEN g.s * 8 AND g.s * 8 + 15),
    c AS (SELECT event_type, block, s, m, (x - ({_LINE.format('x', 'w')})) * (0.5 - 0.5 * cos(2 * pi() * m / 16)) AS x, (y - ({_LINE.format('y', 'w')})) * (0.5 - 0.5 * cos(2 * pi() * m / 16)) AS y FROM s WINDOW w AS (PARTITION BY event_type, block, s)),
    f AS (SELECT event_type, block, s, k, sum(x * cos(2 * pi() * k * m / 16)) AS xr, -sum(x * sin(2 * pi() * k * m / 16)) AS xi, sum(y * cos(2 * pi() * k * m / 16)) AS yr, -sum(y * sin(2 * pi() * k * m / 16)) AS yi FROM c, range(1, 9) r(k) GROUP BY ALL)"""


@query(
    f"""{_CROSS} SELECT event_type, block::BIGINT AS block, k::INTEGER AS k, round(avg(xr * yr + xi * yi) / (2 * 6) * CASE WHEN k = 8 THEN 1 ELSE 2 END, 4) + 0.0 AS re, round(avg(xr * yi - xi * yr) / (2 * 6) * CASE WHEN k = 8 THEN 1 ELSE 2 END, 4) + 0.0 AS im FROM f GROUP BY event_type, block, k"""
)
def cross_spectrum(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("event_type", "block", F.posexplode(spectral.cross(F.col("x"), F.col("y"), 2.0, 16)).alias("k", "s"))
    return b.select("event_type", "block", (F.col("k") + 1).alias("k"), (F.round("s.re", 4) + 0.0).alias("re"), (F.round("s.im", 4) + 0.0).alias("im"))


@query(
    f"""{_CROSS}, p AS (SELECT event_type, block, k, avg(xr * xr + xi * xi) / (2 * 6) * CASE WHEN k = 8 THEN 1 ELSE 2 END - 9 AS s FROM f GROUP BY event_type, block, k), l AS (SELECT *, min(abs(s)) OVER (PARTITION BY event_type, block) / 100 AS low FROM p)
    SELECT event_type, block::BIGINT AS block, k::INTEGER AS k, round(CASE WHEN s < 0 THEN low ELSE s END, 5) AS s FROM l"""
)
def power_spectral_density(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("event_type", "block", F.posexplode(spectral.welch(F.col("x"), 2.0, 16, detrend_whole=False, zero=False, noise=3.0)).alias("k", "s"))
    return b.select("event_type", "block", (F.col("k") + 1).alias("k"), F.round("s", 5).alias("s"))


@query(
    f"""{_WINDOWS}, f AS (SELECT event_type, block, k, 2 * sqrt(sum(x * cos(2 * pi() * k * j / 64)) ** 2 + sum(x * sin(2 * pi() * k * j / 64)) ** 2) / 64 AS a FROM b, range(-32, 32) r(k) GROUP BY ALL),
    h AS (SELECT event_type, block, g, k, a, row_number() OVER (PARTITION BY event_type, block, g ORDER BY abs(k * 100 - g * 5), -k) AS n FROM f, range(0, 612) t(g))
    SELECT event_type, block::BIGINT AS block, g::INTEGER AS g, round(a, 7) AS amplitude FROM h WHERE n = 1"""
)
def harmonics(spark, sf_dir):
    b = _blocks(spark, sf_dir).select("event_type", "block", F.posexplode(spectral.harmonics(F.col("x"), 6400.0, 60)).alias("g", "amplitude"))
    return rounded(b, "amplitude", digits=7)


_AMPLITUDES = "WITH a AS (SELECT vec_id, i, abs(embedding[i % 64 + 1]::DOUBLE) AS a FROM embeddings, range(0, 612) r(i))"


def _amplitudes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(611)), lambda i: F.abs(F.get(F.col("embedding"), i % 64).cast("double"))).alias("a"))


@query(
    f"""{_AMPLITUDES}, h AS (SELECT vec_id, h, sqrt(sum(a * a)) AS s FROM a, range(0, 51) r(h) WHERE i BETWEEN h * 12 - 1 AND h * 12 + 1 OR (h = 0 AND i = 611) GROUP BY 1, 2), g AS (SELECT vec_id, h, sqrt(sum(a * a)) AS s FROM a, range(0, 51) r(h) WHERE i BETWEEN h * 12 + 1 AND h * 12 + 10 GROUP BY 1, 2)
    SELECT h.vec_id, h.h::INTEGER AS h, round(h.s, 8) AS subgroup, round(g.s, 8) AS interharmonic FROM h JOIN g ON h.vec_id = g.vec_id AND h.h = g.h"""
)
def harmonic_subgroups(spark, sf_dir):
    a = _amplitudes(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(spectral.harmonic_subgroups(F.col("a"), 60).alias("s"), spectral.interharmonics(F.col("a"), 60).alias("i"))).alias("h", "p"))
    return a.select("vec_id", "h", F.round("p.s", 8).alias("subgroup"), F.round("p.i", 8).alias("interharmonic"))


@query(
    f"""{_AMPLITUDES}, h AS (SELECT vec_id, h, sqrt(sum(a * a)) AS s FROM a, range(0, 51) r(h) WHERE i BETWEEN h * 12 - 1 AND h * 12 + 1 OR (h = 0 AND i = 611) GROUP BY 1, 2)
    SELECT vec_id, round(100 * sqrt(sum(s * s) FILTER (h BETWEEN 2 AND 49)) / max(s) FILTER (h = 1), 6) AS thcd FROM h GROUP BY 1"""
)
def total_harmonic_distortion(spark, sf_dir):
    return _amplitudes(spark, sf_dir).select("vec_id", F.round(spectral.total_harmonic_distortion(spectral.harmonic_subgroups(F.col("a"), 60)), 6).alias("thcd"))


@query()
def instantaneous_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    t = F.transform("embedding", lambda _, i: i / 10.0)
    return e.select("vec_id", spectral.instantaneous_frequency(F.transform("embedding", lambda x: x.cast("double")), t).alias("frequency"))


@query(
    """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) / 1000000 END AS t FROM events), b AS (SELECT *, last_value(t IGNORE NULLS) OVER p AS t0, last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0,
      first_value(t IGNORE NULLS) OVER q AS t1, first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER q AS i1 FROM a WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, i::INTEGER AS i, round(coalesce(t, t0 + (t1 - t0) * (i - i0) / (i1 - i0), t0 + (i - i0) / 4, t1 - (i1 - i) / 4), 2) AS t FROM b"""
)
def fill_time_gaps(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events", "user_id", "ts", "event_id")
    e = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("i"), F.when(F.col("event_id") % 4 > 0, series.micros("ts") / 1e6).alias("t"))
    return rounded(times.fill_gaps(e, ["user_id"], "i", "t", 4.0).select("user_id", "i", "t"), "t", digits=2)


@query(
    """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 > 0 THEN value END AS v FROM events),
    f AS (SELECT *, row_number() OVER w AS number, lag(v) OVER w AS earlier, last_value(v IGNORE NULLS) OVER (ORDER BY ts) AS filled FROM e WINDOW w AS (ORDER BY ts)),
    g AS (SELECT *, lag(filled) OVER (ORDER BY ts) AS before FROM f)
    SELECT event_id, number::DOUBLE AS number, earlier, filled, sum(CASE WHEN v >= 50 AND before < 50 THEN 1 ELSE 0 END) OVER (ORDER BY ts)::DOUBLE AS cycle FROM g"""
)
def series_scans(spark, sf_dir):
    """One series of all events, scanned by many tasks."""
    df = table(spark, sf_dir, "events", "event_id", "ts", "value").select("event_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    for name, scan in (("number", scans.Number()), ("earlier", scans.Earlier()), ("filled", scans.Earlier(skip=True)), ("cycle", scans.Cycles(50.0))):
        df = scans.scanned(df, [], ["ts"], "v", name, scan)
    return df.drop("ts", "v")
