"""The registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalassa.operators import devices, flow, series, wave
from thalassa.plans.registry import ORACLES, QUERIES, query, rounded
from thalassa.sources.tables import spectra, table

__all__ = ["ORACLES", "QUERIES"]

_MOMENTS = """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
y AS (SELECT vec_id, i, i / 100.0::DOUBLE AS f, e * e AS s, CASE WHEN i = 1 THEN 2 / 100.0::DOUBLE - 1 / 100.0::DOUBLE ELSE i / 100.0::DOUBLE - (i - 1) / 100.0::DOUBLE END AS d FROM x),
m AS (SELECT vec_id, sum(s * f ** -2 * d) AS m_n2, sum(s / f * d) AS m_n1, sum(s * d) AS m_0, sum(s * f * d) AS m_1, sum(s * f ** 2 * d) AS m_2, sum(s * f ** 4 * d) AS m_4,
        1 / arg_max(f, s * 1e6 - i * 1e-12) AS tp FROM y GROUP BY vec_id)
"""


@query(_MOMENTS + "SELECT vec_id, round(m_n2, 6) AS m_n2, round(m_n1, 6) AS m_n1, round(m_0, 6) AS m_0, round(m_1, 6) AS m_1, round(m_2, 6) AS m_2, round(m_4, 6) AS m_4 FROM m")
def spectral_moments(spark, sf_dir):
    names = ["m_n2", "m_n1", "m_0", "m_1", "m_2", "m_4"]
    return rounded(wave.moments(spectra(spark, sf_dir)).select("vec_id", *names), *names)


@query(
    _MOMENTS
    + """SELECT vec_id, round(4 * sqrt(m_0), 6) AS hm0, round(m_n1 / m_0, 6) AS te, round(sqrt(m_0 / m_1), 6) AS tm, round(sqrt(m_0 / m_2), 6) AS tz, round(sqrt(m_2 / m_4), 6) AS tavg,
    round(tp, 6) AS tp, round(sqrt(1 - m_2 * m_2 / (m_0 / m_4)), 6) AS e, round(sqrt(m_0 * m_n2 / (m_n1 * m_n1) - 1), 6) AS v FROM m"""
)
def wave_metrics(spark, sf_dir):
    names = ["hm0", "te", "tm", "tz", "tavg", "tp", "e", "v"]
    return rounded(wave.sea_state(spectra(spark, sf_dir)).select("vec_id", *names), *names)


@query(_MOMENTS + "SELECT vec_id, round(1025.0 * 9.80665 * 9.80665 / (64 * pi()) * 16 * m_0 * m_n1 / m_0, 4) AS j FROM m")
def energy_flux_deep(spark, sf_dir):
    s = wave.sea_state(spectra(spark, sf_dir))
    return s.select("vec_id", F.round(wave.energy_flux_deep(F.col("hm0"), F.col("te")), 4).alias("j"))


_GRID = "WITH p AS (SELECT p_partkey, 4 + p_size / 5.0::DOUBLE AS tp, 1 + p_size / 25.0::DOUBLE AS hs FROM part), g AS (SELECT p_partkey, tp, hs, i / 50.0::DOUBLE AS f FROM p, range(0, 21) r(i))"
_PM = "CASE WHEN f = 0 THEN 0.0::DOUBLE ELSE 1.25 / tp ** 4 * (hs / 2) ** 2 * f ** -5 * exp(-(1.25 / tp ** 4 * f ** -4)) END"


def _grid(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    p = p.select("p_partkey", (4 + F.col("p_size") / 5.0).alias("tp"), (1 + F.col("p_size") / 25.0).alias("hs"))
    return p.select("*", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")).select("p_partkey", "tp", "hs", (F.col("i") / 50.0).alias("f"))


@query(f"{_GRID} SELECT p_partkey, f, round({_PM}, 6) AS s FROM g")
def pm_spectrum(spark, sf_dir):
    return _grid(spark, sf_dir).select("p_partkey", "f", F.round(wave.pierson_moskowitz(F.col("f"), F.col("tp"), F.col("hs")), 6).alias("s"))


@query(
    f"""{_GRID}, a AS (SELECT *, CASE WHEN tp / sqrt(hs) <= 3.6 THEN 5.0::DOUBLE WHEN tp / sqrt(hs) > 5 THEN 1.0::DOUBLE ELSE exp(5.75 - 1.15 * tp / sqrt(hs)) END AS gam,
    CASE WHEN f <= 1 / tp THEN 0.07::DOUBLE ELSE 0.09::DOUBLE END AS sg FROM g)
    SELECT p_partkey, f, round((1 - 0.287 * ln(gam)) * {_PM} * gam ** exp(-((f * tp - 1) ** 2) / (2 * sg * sg)), 6) AS s FROM a"""
)
def jonswap_spectrum(spark, sf_dir):
    return _grid(spark, sf_dir).select("p_partkey", "f", F.round(wave.jonswap(F.col("f"), F.col("tp"), F.col("hs")), 6).alias("s"))


def _sea(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_quantity", "l_tax", "l_extendedprice")
    return line.select((F.col("l_quantity") / 10).alias("hm0"), (F.col("l_tax") * 100).alias("te"), F.col("l_extendedprice").alias("p"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("cw"))


@query(
    """WITH x AS (SELECT floor(l_quantity / 10 / 0.5 + 0.5) * 0.5 AS x_center, floor(l_tax * 100 / 1.0 + 0.5) * 1.0 AS y_center, l_extendedprice / l_quantity AS cw FROM lineitem)
    SELECT x_center::DOUBLE AS x_center, y_center::DOUBLE AS y_center, count(cw)::BIGINT AS n, round(avg(cw), 6) AS mean, round(stddev_pop(cw), 6) AS std, round(median(cw), 6) AS median,
      round(sum(cw), 3) AS total, min(cw) AS least, max(cw) AS most, round(count(cw) / (SELECT count(cw) FROM x)::DOUBLE, 9) AS frequency FROM x GROUP BY ALL"""
)
def capture_width_matrix(spark, sf_dir):
    m = wave.performance_matrix(_sea(spark, sf_dir), "hm0", "te", "cw", 0.5, 1.0)
    return rounded(rounded(rounded(m, "mean", "std", "median"), "total", digits=3), "frequency", digits=9)


@query(
    """SELECT count(*)::BIGINT AS n, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std, min(p) AS least, round(quantile_cont(p, 0.25), 6) AS q25,
    round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.75), 6) AS q75, max(p) AS most FROM (SELECT l_extendedprice AS p FROM lineitem)"""
)
def statistics(spark, sf_dir):
    return rounded(rounded(wave.statistics(_sea(spark, sf_dir), "p"), "mean", "std", digits=4), "q25", "q50", "q75")


@query("SELECT round(8766 / count(*) * sum(l_extendedprice / l_quantity * (l_tax * 100)), 2) AS maep FROM lineitem")
def maep_timeseries(spark, sf_dir):
    return rounded(wave.annual_energy(_sea(spark, sf_dir), "cw", "te"), "maep", digits=2)


@query(
    """SELECT o_orderkey, round(100 * (count(*) OVER () - (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE) + 1)
    / (count(*) OVER () + 1), 9) AS f FROM orders WHERE o_totalprice IS NOT NULL"""
)
def exceedance_probability(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    return rounded(flow.exceedance_probability(o, "o_totalprice").select("o_orderkey", "f"), "f", digits=9)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def polyfit1_r2(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(rounded(rounded(flow.linear_fit(line, "l_quantity", "l_extendedprice", ["l_returnflag"]), "slope", digits=5), "intercept", digits=3), "r2", digits=8)


@query("SELECT event_id, round(CASE WHEN value < 1 OR value > 100 THEN 0 ELSE (0.002 * value + 0.5) * value - 0.25 END::DOUBLE, 6) AS power FROM events")
def velocity_to_power(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "value")
    return e.select("event_id", F.round(flow.velocity_to_power(F.col("value"), [0.002, 0.5, -0.25], 1, 100), 6).alias("power"))


@query(
    """SELECT floor((l_partkey % 360) / 10.0)::BIGINT AS dir_bin, floor(l_quantity / 5.0)::BIGINT AS speed_bin, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem), 9) AS percent FROM lineitem GROUP BY 1, 2"""
)
def joint_probability(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity")
    return rounded(flow.joint_probability(line, "l_partkey", "l_quantity", 10.0, 5.0), "percent", digits=9)


@query("SELECT (d >= 175 AND d < 355) AS ebb, count(*)::BIGINT AS n FROM (SELECT l_partkey % 360 AS d FROM lineitem) GROUP BY 1")
def flood_or_ebb(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_partkey")
    return line.groupBy(flow.is_ebb(F.col("l_partkey") % 360, 80, 250).alias("ebb")).agg(F.count(F.lit(1)).alias("n"))


_BLOCKS = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    b AS (SELECT *, i // 25 AS block FROM a WHERE i < n // 25 * 25)"""


@query(f"{_BLOCKS} SELECT event_type, block::BIGINT AS block, min(ts) AS begin, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS std FROM b GROUP BY 1, 2")
def block_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    return rounded(series.block_statistics(e, ["event_type"], "ts", "value", 25), "mean", "std")


@query(
    f"""{_BLOCKS}, s AS (SELECT event_type, block, avg(sin(radians(value))) AS s, avg(cos(radians(value))) AS c FROM b GROUP BY 1, 2), e AS (SELECT *, sqrt(greatest(1 - round(s * s + c * c, 8), 0)) AS e FROM s)
    SELECT event_type, block::BIGINT AS block, round((degrees(atan2(s, c)) + 360) % 360, 5) AS mean, round(degrees(asin(e) * (1 + 0.1547 * e ** 3)), 4) AS std FROM e"""
)
def block_statistics_circular(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    return rounded(rounded(series.block_statistics(e, ["event_type"], "ts", "value", 25, circular=True).select("event_type", "block", "mean", "std"), "mean", digits=5), "std", digits=4)


@query(
    """WITH s AS (SELECT event_type, avg(sin(radians(value))) AS s, avg(cos(radians(value))) AS c FROM events GROUP BY 1), e AS (SELECT *, sqrt(greatest(1 - round(s * s + c * c, 8), 0)) AS e FROM s)
    SELECT event_type, round((degrees(atan2(s, c)) + 360) % 360, 5) AS direction, round(degrees(asin(e) * (1 + 0.1547 * e ** 3)), 4) AS spread FROM e"""
)
def vector_statistics(spark, sf_dir):
    return rounded(series.vector_statistics(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], "value").withColumn("spread", F.round("spread", 4)), "direction", digits=5)


_UP = """WITH a AS (SELECT user_id, ts, round(value) - 50 AS x FROM events), u AS (SELECT *, coalesce(sign(lead(x) OVER w) - sign(x), 0) IN (1, 2) AS up, lead(ts) OVER w AS next FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, x)),
    c AS (SELECT *, sum(up::INT) OVER (PARTITION BY user_id ORDER BY ts, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS wave FROM u)"""


def _waves(spark, sf_dir):
    return table(spark, sf_dir, "events", "user_id", "ts", "value").select("user_id", "ts", (F.round("value") - 50).alias("x"))


@query(
    f"""{_UP}, g AS (SELECT user_id, wave, min(ts) AS begin, count(*)::BIGINT AS n, max(x) AS peak, min(x) AS trough FROM c WHERE wave > 0 GROUP BY 1, 2),
    p AS (SELECT *, round((epoch_us(lead(begin) OVER (PARTITION BY user_id ORDER BY wave)) - epoch_us(begin)) / 1000000, 6) AS period FROM g)
    SELECT user_id, wave, begin, n, peak, trough, period, peak - trough AS height FROM p WHERE period IS NOT NULL"""
)
def upcrossing_waves(spark, sf_dir):
    return rounded(series.waves(_waves(spark, sf_dir), ["user_id"], "ts", "x"), "period")


@query(f"{_UP}, m AS (SELECT user_id, max(wave) AS last FROM c GROUP BY 1) SELECT user_id, wave, round(sqrt(avg(x * x)), 6) AS value FROM c JOIN m USING (user_id) WHERE wave > 0 AND wave < last GROUP BY 1, 2")
def upcrossing_custom(spark, sf_dir):
    return rounded(series.custom_waves(_waves(spark, sf_dir), ["user_id"], "ts", "x", F.sqrt(F.avg(F.col("x") * F.col("x")))), "value")


@query(f"{_UP} SELECT user_id, wave, arg_min(ts, (-x, ts)) AS time, max(x) AS peak FROM c WHERE wave > 0 AND next IS NOT NULL GROUP BY 1, 2")
def global_peaks(spark, sf_dir):
    return series.global_peaks(_waves(spark, sf_dir), ["user_id"], "ts", "x")


@query(
    """WITH a AS (SELECT event_type, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000000 AS t, value FROM events), m AS (SELECT event_type, floor(max(t) / 3600) AS last FROM a GROUP BY 1)
    SELECT event_type, floor(t / 3600)::BIGINT AS block, max(value) AS peak FROM a JOIN m USING (event_type) WHERE floor(t / 3600) < last GROUP BY 1, 2"""
)
def block_maxima(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_type", "ts", "value")
    start = e.agg(F.min(series.micros("ts")).alias("start"))
    e = e.join(F.broadcast(start)).select("event_type", ((series.micros("ts") - F.col("start")) / 1e6).alias("t"), "value")
    return series.block_maxima(e, ["event_type"], "t", "value", 3600)


@query(
    """WITH e AS (SELECT * FROM (VALUES (0, 0.0, 10.0), (1, 10.0, 25.0), (2, 25.0, 26.0), (3, 26.0, 50.0), (4, 50.0, 60.0)) e(bin, lo, hi)), n AS (SELECT unnest(['l_extendedprice', 'l_discount', 'l_tax']) AS signal),
    v AS (SELECT l_quantity AS q, unnest(['l_extendedprice', 'l_discount', 'l_tax']) AS signal, unnest([l_extendedprice, l_discount, l_tax]) AS value FROM lineitem),
    s AS (SELECT bin, signal, avg(value) AS mean, stddev_pop(value) AS std FROM v JOIN e ON q >= lo AND (q < hi OR (bin = 4 AND q = hi)) GROUP BY 1, 2)
    SELECT e.bin::INTEGER AS bin, n.signal, round(s.mean, 6) AS mean, round(s.std, 6) AS std FROM e CROSS JOIN n LEFT JOIN s ON e.bin = s.bin AND n.signal = s.signal"""
)
def bin_statistics(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(series.bin_statistics(line, "l_quantity", [0.0, 10.0, 25.0, 26.0, 50.0, 60.0], ["l_extendedprice", "l_discount", "l_tax"]), "mean", "std")


@query(
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 5 <> 0 THEN value END AS x FROM events),
    b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(x IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1, first_value(x IGNORE NULLS) OVER n AS v1 FROM a
      WINDOW p AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(x, v0 + (v1 - v0) * (t - t0)::DOUBLE / (t1 - t0)::DOUBLE), 6) AS filled FROM b"""
)
def fillgaps_linear(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("x", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return rounded(series.fill_gaps(e, ["user_id"], "ts", "x").select("event_id", "filled"), "filled")


@query(
    """WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 > 1 THEN value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    b AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(x IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER q AS i1, first_value(x IGNORE NULLS) OVER q AS v1 FROM a
      WINDOW p AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN x IS NOT NULL THEN x WHEN i0 IS NOT NULL AND i1 IS NOT NULL THEN CASE WHEN i1 - i0 <= 3 THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) END
      WHEN i0 IS NULL AND i1 - 1 <= 2 THEN v1 WHEN i1 IS NULL AND n - i0 <= 2 THEN v0 END, 6) AS filled FROM b"""
)
def fillgaps_by_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("x", F.when(F.col("event_id") % 5 > 1, F.col("value")))
    return rounded(series.fill_gaps(e, ["user_id"], "ts", "x", max_gap=2, by_time=False, extrapolate=True).select("event_id", "filled"), "filled")


@query(
    """WITH a AS (SELECT event_id, event_type, CASE WHEN event_id % 5 > 1 THEN value END AS x, (row_number() OVER (PARTITION BY event_type ORDER BY ts, CASE WHEN event_id % 5 > 1 THEN value END) - 1) // 20 AS b FROM events)
    SELECT event_id, round(coalesce(x, avg(x) OVER (PARTITION BY event_type, b)), 6) AS filled FROM a"""
)
def fill_with_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value").withColumn("x", F.when(F.col("event_id") % 5 > 1, F.col("value")))
    return rounded(series.fill_with_mean(e, ["event_type"], "ts", "x", 20).select("event_id", "filled"), "filled")


@query("SELECT event_id, abs(value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, value)) > 40 AS spike, value < 5 OR value > 90 AS outside FROM events")
def despike_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return series.spikes(e, ["user_id"], "ts", "value", 40).select("event_id", "spike", series.outside(F.col("value"), 5, 90).alias("outside"))


@query(
    """WITH a AS (SELECT user_id, ts, value > 40 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), b AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a WHERE high)
    SELECT user_id, min(ts) AS begin, max(ts) AS end, count(*)::BIGINT AS n FROM b GROUP BY user_id, g HAVING count(*) >= 2"""
)
def segments(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "ts", "value").withColumn("high", F.col("value") > 40)
    return series.segments(e, ["user_id"], "ts", "high", 2)


@query("SELECT event_id, (value BETWEEN 1 AND 200 AND value <> 1.63) AS ok FROM events")
def quality_mask(spark, sf_dir):
    return series.quality_mask(table(spark, sf_dir, "events", "event_id", "value"), "value", 1, 200, [1.63]).select("event_id", "ok")


@query(
    """SELECT a.event_id, b.value AS power FROM (SELECT * FROM events WHERE event_type = 'click') a
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def interp_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value", "event_type")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("power"))
    return series.as_of(left, right, ["user_id"], "ts", "power").select("event_id", "power")


@query(
    """WITH r AS (SELECT user_id, epoch_us(ts) AS t, value AS v FROM events WHERE event_type = 'view'), l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
    p AS (SELECT l.*, a.t AS t0, a.v AS v0 FROM l ASOF LEFT JOIN r a ON l.user_id = a.user_id AND l.t >= a.t), q AS (SELECT p.*, b.t AS t1, b.v AS v1 FROM p ASOF LEFT JOIN r b ON p.user_id = b.user_id AND p.t <= b.t)
    SELECT event_id, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS power FROM q"""
)
def interp_linear(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value", "event_type")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("power"))
    return rounded(series.interpolated(left, right, ["user_id"], "ts", "power").select("event_id", "power"), "power")


@query("SELECT user_id, round(10 * log10(avg(10 ** (value / 100))), 6) AS average, round(10 * log10(sum(10 ** (value / 100))), 6) AS total FROM events GROUP BY 1")
def time_average_db(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "value").withColumn("level", F.col("value") / 10)
    return rounded(e.groupBy("user_id").agg(series.average_db("level").alias("average"), series.total_db("level").alias("total")), "average", "total")


@query("SELECT o_orderkey, round(o_totalprice * 2 + o_custkey * 3, 4) AS dc, round(abs(o_totalprice * 2 + o_custkey * 3) * 0.9 * sqrt(3), 4) AS ac FROM orders")
def electrical_power(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    pairs = [(F.col("o_totalprice"), F.lit(2)), (F.col("o_custkey"), F.lit(3))]
    return o.select("o_orderkey", F.round(devices.dc_power(pairs), 4).alias("dc"), F.round(devices.ac_power_three_phase(pairs, 0.9, True), 4).alias("ac"))


from thalassa.plans import doppler_queries, flow_queries, instrument_queries, sound_queries, source_queries, time_queries, wave_queries  # noqa: E402, F401
