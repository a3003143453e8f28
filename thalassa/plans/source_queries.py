"""Tables that come together: gages, stations, buoys, grids, frames of reference."""

from __future__ import annotations


from pyspark.sql import functions as F

from thalassa.functions import angles
from thalassa.operators import doppler, grids, scattered
from thalassa.sources import text
from thalassa.sources.tables import table

from .registry import query


@query(
    """SELECT user_id, arg_min(value, ts) FILTER (event_type = 'click') AS click, arg_min(value, ts) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"""
)
def combine_first(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value", "ts").where("event_type IN ('click', 'view')")
    return text.combine_first(e, "user_id", "event_type", "value", "ts")


@query(
    """SELECT coalesce(c.c_custkey, s.s_suppkey) AS id, coalesce(c.a, s.s_acctbal) AS balance, c.c_name, s.s_name FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS a FROM customer WHERE c_custkey % 3 > 0) c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey"""
)
def coalesced_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal").where("c_custkey % 3 > 0")
    c = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"), "c_name")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name")
    return text.coalesced(c, s, "id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def without_repeats(spark, sf_dir):
    return text.without_repeats(table(spark, sf_dir, "events", "user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate AS d FROM orders) SELECT o_orderkey, epoch_us(date_trunc('day', d)) AS us, (date_diff('day', d::DATE, d::DATE + 95) + 29) // 30 AS parts, (d::DATE + 90)::DATE AS last FROM o"""
)
def dates_and_ranges(spark, sf_dir):
    d = F.col("o_orderdate")
    at = text.dates(F.date_format(d, "yy"), F.month(d), F.day(d), F.lit(0))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    parts = text.date_ranges(F.to_date(d), F.date_add(F.to_date(d), 95))
    return o.select("o_orderkey", F.unix_micros(at).alias("us"), F.size(parts).cast("long").alias("parts"), F.element_at(parts, -1)["begin"].alias("last"))


@query(
    """SELECT (SELECT o_orderkey FROM orders ORDER BY abs(o_totalprice - 123456.7), o_orderkey LIMIT 1) AS nearest, (SELECT count(*) FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 200000) AS within, (SELECT round(sum(0.3 * (o_totalprice + 2)), 2) FROM orders) AS depth"""
)
def grid_lookups(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    one = grids.nearest(o, "o_orderkey", "o_totalprice", 123456.7).select(F.col("o_orderkey").alias("nearest"))
    n = grids.within(o, o_totalprice=(1000, 200000)).agg(F.count(F.lit(1)).alias("within"))
    d = o.agg(F.round(F.sum(grids.layer_depth(F.lit(-0.3), F.col("o_totalprice"), F.lit(2))), 2).alias("depth"))
    return one.crossJoin(n).crossJoin(d)


@query("SELECT x::DOUBLE AS x, y::DOUBLE AS y, waterdepth::DOUBLE AS waterdepth FROM (VALUES (1, 4), (2, 5), (3, 6)) p(x, y), (VALUES (7), (8)) d(waterdepth)")
def create_points(spark, sf_dir):
    return grids.points(spark, [1, 2, 3], [4, 5, 6], [7, 8])


@query(
    """WITH d AS (SELECT p_partkey AS k, (p_partkey * 37 % 1000) / 10.0::DOUBLE AS x, (p_partkey * 91 % 1000) / 10.0::DOUBLE AS y FROM part), w AS (SELECT c_custkey AS c, (c_custkey * 53 % 1000) / 10.0::DOUBLE + 0.03 AS x, (c_custkey * 17 % 1000) / 10.0::DOUBLE + 0.04 AS y FROM customer),
    j AS (SELECT c, k, row_number() OVER (PARTITION BY c ORDER BY (w.x - d.x) ** 2 + (w.y - d.y) ** 2, d.x, d.y) AS n FROM w JOIN d ON abs(w.x - d.x) <= 5 AND abs(w.y - d.y) <= 5) SELECT w.c, (SELECT min(k) FROM d e WHERE e.x = d.x AND e.y = d.y) AS k FROM w LEFT JOIN j ON w.c = j.c AND n = 1 LEFT JOIN d ON j.k = d.k"""
)
def nearest_points(spark, sf_dir):
    p, c = F.col("p_partkey"), F.col("c_custkey")
    d = table(spark, sf_dir, "part", "p_partkey").select(p.alias("k"), ((p * 37 % 1000) / 10.0).alias("x"), ((p * 91 % 1000) / 10.0).alias("y")).groupBy("x", "y").agg(F.min("k").alias("k"))
    w = table(spark, sf_dir, "customer", "c_custkey").select(c.alias("c"), ((c * 53 % 1000) / 10.0 + 0.03).alias("x"), ((c * 17 % 1000) / 10.0 + 0.04).alias("y"))
    return grids.to_nearest_points(d, w, ["x", "y"], 5.0).select("c", "k")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, unnest(['discount', 'quantity', 'tax']) AS variable, unnest([l_discount, l_quantity, l_tax]) AS value FROM lineitem"""
)
def long_form(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_tax")
    return grids.long_form(line.withColumnsRenamed({"l_discount": "discount", "l_quantity": "quantity", "l_tax": "tax"}), ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    """SELECT o_orderkey AS time, f AS frequency, o_totalprice * f AS swden, (o_custkey % 360)::DOUBLE AS swdir, (o_custkey % 180)::DOUBLE AS swdir2, f AS swr1, f / 2 AS swr2 FROM orders, (VALUES (0.02::DOUBLE), (0.0325::DOUBLE)) v(f)"""
)
def directional_data(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    wide = lambda of: o.select(F.col("o_orderkey").alias("time"), *[of(f).alias(str(f)) for f in (0.02, 0.0325)])
    k = F.col("o_custkey")
    out = grids.directional(wide(lambda f: F.col("o_totalprice") * f), wide(lambda f: k % 360), wide(lambda f: k % 180), wide(lambda f: F.lit(f * 100)), wide(lambda f: F.lit(f * 50)))
    return out.withColumns({"swr1": F.round("swr1", 9), "swr2": F.round("swr2", 9)})


_TILT = "radians((p_partkey % 11 - 5)::DOUBLE)"


@query(
    f"""WITH b AS (SELECT p_partkey AS k, p_size + 2.0::DOUBLE AS b0, p_partkey % 9 + 1.0::DOUBLE AS b1, p_partkey % 13 + 1.0::DOUBLE AS b2, p_partkey % 4 + 1.0::DOUBLE AS b3, p_partkey % 6 + 1.0::DOUBLE AS b4, radians(p_partkey % 7 - 3) AS p, {_TILT} AS r, sin(radians(25)) AS s, cos(radians(25)) AS c, 0.3::DOUBLE AS uv FROM part),
    d AS (SELECT *, -4 * s ** 6 * c * c AS d FROM b)
    SELECT k, round((-2 * s ** 4 * c * c * (b1 + b0 - 2 * c * c * b4) + 2 * s ** 5 * c * r * (b1 - b0)) / d, 6) AS upup,
      round((-2 * s ** 4 * c * c * (b3 + b0 - 2 * c * c * b4) - 2 * s ** 4 * c * c * r * (b1 - b0) + 2 * s ** 3 * c ** 3 * r * (b1 - b0) - 2 * s ** 5 * c * p * (b3 - b2)) / d, 6) AS vpvp,
      round(-2 * s ** 5 * c * (b1 - b0 + 2 * s ** 5 * c * p * (b3 - b2) - 4 * s ** 6 * c * c * b4) / d, 6) AS wpwp,
      round((s ** 5 * c * (b1 - b0) + 4 * s ** 4 * c * r * (b1 + b0) - 8 * s ** 4 * c * r * b4 - 8 * s ** 6 * c * p * uv) / d, 6) AS upwp, round((s ** 5 * c * (b3 - b2) - 4 * s ** 4 * c * p * (b3 + b2) + 8 * s ** 4 * c * p * b4 + 8 * s ** 6 * c * r * uv) / d, 6) AS vpwp FROM d"""
)
def stresses_5beam(spark, sf_dir):
    k = F.col("p_partkey")
    beams = [F.col("p_size") + 2.0, k % 9 + 1.0, k % 13 + 1.0, k % 4 + 1.0, k % 6 + 1.0]
    s = doppler.stresses_5beam(beams, 25, F.radians(k % 7 - 3), F.radians((k % 11 - 5).cast("double")), F.lit(0.3))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(k.alias("k"), *[F.round(v, 6).alias(n) for n, v in s.items() if n != "upvp"])


@query(
    """WITH v AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, (p_partkey % 9)::DOUBLE AS y, (p_partkey % 5)::DOUBLE AS z, radians(p_partkey % 360) AS h FROM part)
    SELECT k, round(cos(h) * x + sin(h) * y, 7) AS east, round(-sin(h) * x + cos(h) * y, 7) AS north, z AS up, round(x, 6) AS x_again, round((z + 1) / 2 * 0 + cos(h) * x + sin(h) * y, 7) AS east4, z AS up4, round(cos(radians(60)) * (cos(h) * x + sin(h) * y) + sin(radians(60)) * (-sin(h) * x + cos(h) * y), 7) + 0.0 AS along FROM v"""
)
def frames_of_reference(spark, sf_dir):
    k = F.col("p_partkey")
    v = (F.col("p_size").cast("double"), (k % 9).cast("double"), (k % 5).cast("double"))
    m = angles.orientation((k % 360).cast("double"), F.lit(0.0), F.lit(0.0))
    earth = doppler.rotated(v, "inst", "earth", orient=m)
    beam = ((1.0, -1.0, 0.0), (0.0, 1.0, -1.0), (1.0, 1.0, 1.0))
    again = doppler.rotated(doppler.rotated(doppler.rotated(earth, "earth", "beam", beam=beam, orient=m), "beam", "inst", beam=beam), "inst", "inst")
    four = doppler.four_components_to_earth((*v, F.lit(1.0)), m)
    along = doppler.rotated(v, "inst", "principal", orient=m, heading=F.lit(30.0))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        k.alias("k"), F.round(earth[0], 7).alias("east"), F.round(earth[1], 7).alias("north"), F.round(earth[2], 9).alias("up"), F.round(again[0], 6).alias("x_again"), F.round(four[0], 7).alias("east4"), F.round(four[2], 9).alias("up4"), (F.round(along[0], 7) + 0.0).alias("along")
    )


@query()
def fill_cubic(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    gaps = F.transform("embedding", lambda x, i: F.when(i % 9 < 6, x.cast("double")))
    return e.select("vec_id", doppler.fill_cubic(gaps).alias("filled"))


# Points lie about the nodes of a lattice, so no ball around a place within it reaches further than 250.
@query(
    """WITH p AS (SELECT p_partkey % 20 * 100 + p_partkey * 37 % 50 AS x, p_partkey // 20 * 100 + p_partkey * 91 % 50 AS y, min(p_retailprice) AS v FROM part GROUP BY ALL),
    q AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 10 = 0 THEN -900 ELSE 200 + c_custkey * 53 % 1500 END + 0.1234567::DOUBLE AS qx, 200 + c_custkey * 17 % 500 + 0.7654321::DOUBLE AS qy FROM customer),
    n AS (SELECT c, qx, qy, x, y, v FROM q JOIN p ON abs(x - qx) < 250 AND abs(y - qy) < 250),
    t AS (SELECT a.c, a.qx, a.qy, a.x AS x1, a.y AS y1, a.v AS v1, b.x AS x2, b.y AS y2, b.v AS v2, d.x AS x3, d.y AS y3, d.v AS v3, (b.x - a.x) * (d.y - a.y) - (d.x - a.x) * (b.y - a.y) AS area
      FROM n a JOIN n b ON a.c = b.c AND (a.x < b.x OR a.x = b.x AND a.y < b.y) JOIN n d ON b.c = d.c AND (b.x < d.x OR b.x = d.x AND b.y < d.y)),
    w AS (SELECT *, ((qx - x1) * (y3 - y1) - (x3 - x1) * (qy - y1)) / area AS w2, ((x2 - x1) * (qy - y1) - (qx - x1) * (y2 - y1)) / area AS w3 FROM t WHERE area <> 0),
    h AS (SELECT * FROM w WHERE w2 >= 0 AND w3 >= 0 AND w2 + w3 <= 1),
    e AS (SELECT h.c, v1 + w2 * (v2 - v1) + w3 * (v3 - v1) AS price FROM h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c = h.c AND sign(area) * (((x1 - x) ** 2 + (y1 - y) ** 2) * ((x2 - x) * (y3 - y) - (x3 - x) * (y2 - y))
      - ((x2 - x) ** 2 + (y2 - y) ** 2) * ((x1 - x) * (y3 - y) - (x3 - x) * (y1 - y)) + ((x3 - x) ** 2 + (y3 - y) ** 2) * ((x1 - x) * (y2 - y) - (x2 - x) * (y1 - y))) > 0))
    SELECT q.c, qx, qy, (SELECT round(min(price), 5) FROM e WHERE e.c = q.c) AS price FROM q"""
)
def scattered_interpolation(spark, sf_dir):
    p, c = F.col("p_partkey"), F.col("c_custkey")
    points = table(spark, sf_dir, "part", "p_partkey", "p_retailprice").select((p % 20 * 100 + p * 37 % 50).alias("qx"), (F.floor(p / 20) * 100 + p * 91 % 50).alias("qy"), F.col("p_retailprice").alias("price"))
    places = table(spark, sf_dir, "customer", "c_custkey").select(c.alias("c"), (F.when(c % 10 == 0, -900).otherwise(200 + c * 53 % 1500) + 0.1234567).alias("qx"), (200 + c * 17 % 500 + 0.7654321).alias("qy"))
    return scattered.interpolated(places, points, ["qx", "qy"], ["price"]).withColumn("price", F.round("price", 5))
