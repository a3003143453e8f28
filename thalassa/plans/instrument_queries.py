"""Instrument files, written from the tables and read back by byte range."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thalassa.sources import files, netcdf, pulse, tagged
from thalassa.sources.tables import shared_folder, table

from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/thalassa-{name}-{uuid.uuid4().hex}"


def _pulse_ensembles(batches):
    """An ensemble of 2 to 4 cells per event; every fiftieth has a wrong checksum."""
    for b in batches:
        events, users, us = (b.column(c).to_numpy() for c in ("event_id", "user_id", "us"))
        for n in (2, 3, 4):
            own = events % 3 + 2 == n
            k, u, t = events[own], users[own], us[own]
            if not len(k):
                continue
            days, clock = np.divmod(t // 10_000, 8_640_000)
            date = days.astype("datetime64[D]")
            year, month = date.astype("datetime64[Y]").astype(int) + 1970, date.astype("datetime64[M]").astype(int) % 12 + 1
            day = (date - date.astype("datetime64[M]")).astype(int) + 1
            rtc = np.stack([year % 100, month, day, clock // 360_000, clock // 6000 % 60, clock // 100 % 60, clock % 100], 1)
            cell, beam = np.arange(n)[None, :, None], np.arange(4)[None, None, :]
            vel = (k[:, None, None] * 7 + cell * 11 + beam * 13) % 4001 - 2000
            vel[(k[:, None, None] + cell + beam) % 17 == 0] = pulse.LOST
            zeros, one = (lambda w: np.zeros((len(k), w), np.uint8)), np.ones((len(k), 1), np.uint8)
            fixed = np.concatenate([one * 50, one * 40, zeros(4), one * 4, one * n, pulse.bytes_of("<u2", np.repeat([[45, 100, 44]], len(k), 0)), zeros(16), pulse.bytes_of("<u2", np.repeat([[152]], len(k), 0)), zeros(8)], 1)
            leader = np.concatenate([pulse.bytes_of("<u2", k % 65536), rtc.astype(np.uint8), (k // 65536 % 256).astype(np.uint8)[:, None], zeros(6), pulse.bytes_of("<u2", u % 360 * 100), zeros(22)], 1)
            counts = [((k[:, None, None] + cell * beam + i) % 101 * np.ones((1, n, 4), int)).reshape(len(k), -1).astype(np.uint8) for i in range(3)]
            rows = pulse.ensemble_rows([(pulse.FIXED, fixed), (pulse.VARIABLE, leader), (pulse.VELOCITY, pulse.bytes_of("<i2", vel)), *zip((pulse.CORRELATION, pulse.AMPLITUDE, pulse.GOOD), counts, strict=True)])
            rows[k % 50 == 7, -1] ^= 1
            yield pa.record_batch({"content": pa.array([r.tobytes() for r in rows], pa.binary())})


@query(
    """WITH c AS (SELECT *, unnest(range(event_id % 3 + 2)) AS cell FROM events WHERE event_id % 50 <> 7),
    v AS (SELECT *, [CASE WHEN (event_id + cell + b) % 17 = 0 THEN NULL ELSE ((event_id * 7 + cell * 11 + b * 13) % 4001 - 2000) / 1000::DOUBLE END for b in [0, 1, 2, 3]] AS v FROM c)
    SELECT event_id % 65536 + 65535 * (event_id // 65536 % 256) AS number, epoch_us(ts) // 10000 * 10000 AS us, (user_id % 360)::DOUBLE AS heading, cell::INTEGER AS cell, round(1.52::DOUBLE + cell, 9) AS range, v[1] AS v1, v[2] AS v2, v[3] AS v3, v[4] AS v4, (event_id % 101)::INTEGER AS corr0 FROM v"""
)
def pulse_profiles(spark, sf_dir):
    folder = _folder(spark, "pulse")
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    files.write_binary(events.mapInArrow(_pulse_ensembles, "content binary"), "content", folder, ".pd0")
    spark.dataSource.register(pulse.PulseProfiles)
    read = spark.read.format("pd0").option("splitBytes", 1 << 20).load(folder)
    each = pulse.by_cell(read, "number", F.unix_micros("time").alias("us"), "heading")
    return each.select("number", "us", "heading", "cell", F.round("range", 9).alias("range"), *[F.col("vel")[i].alias(f"v{i + 1}") for i in range(4)], F.col("corr")[0].alias("corr0"))


def _tagged_records(batches):
    """A burst, average or echogram per order; every fortieth has a wrong checksum."""
    for b in batches:
        key, us = b.column("o_orderkey").to_numpy(), b.column("us").to_numpy()
        for kind, bits, shape in ((21, 0b11100000, 3 | 2 << 10 | 4 << 12), (22, 0b11100000, 2 | 0 << 10 | 3 << 12), (28, 1 << 11, 5)):
            own = key % 3 == (21, 22, 28).index(kind)
            k, t = key[own], us[own]
            if not len(k):
                continue
            days, clock = np.divmod(t // 100, 864_000_000)
            date = days.astype("datetime64[D]")
            month = date.astype("datetime64[M]")
            when = np.stack([date.astype("datetime64[Y]").astype(int) + 70, month.astype(int) % 12, (date - month).astype(int) + 1, clock // 36_000_000, clock // 600_000 % 60, clock // 10_000 % 60], 1).astype(np.uint8)
            same = lambda kind_, *v: np.repeat(pulse.bytes_of(kind_, np.array([v])), len(k), 0)  # noqa: E731, B023
            head = [same("u1", 3, 76), same("<u2", bits), same("<u4", 7), when, pulse.bytes_of("<u2", clock % 10_000), same("<u2", 15_000), pulse.bytes_of("<i2", k % 3000), pulse.bytes_of("<u4", k), pulse.bytes_of("<u2", k * 7 % 36_000), same("<i2", -321, 45)]
            head += [same("<u2", shape, 500, 60), same("u1", 70, 30), same("<u2", 152), same("<i2", *[0] * 6), same("<i2", 2500), same("<u2", 0x4321, 7), same("i1", -3, -2), same("<i2", 5, 2500), same("<u2", 0, 0), same("<u4", 1 << 25), pulse.bytes_of("<u4", k)]
            if kind == 28:
                body = [pulse.bytes_of("<u2", (k[:, None] + np.arange(5)) % 5000)]
            else:
                beams, cells = shape >> 12, shape & 1023
                at = np.arange(beams * cells)
                body = [pulse.bytes_of("<i2", (k[:, None] * 13 + at) % 3001 - 1500), ((k[:, None] + at) % 200).astype(np.uint8), ((k[:, None] * 3 + at) % 100).astype(np.uint8)]
            rows = tagged.record_rows(kind, np.concatenate([*head, *body], 1))
            rows[k % 40 == 11, -1] ^= 1
            yield pa.record_batch({"content": pa.array([r.tobytes() for r in rows], pa.binary())})


def _tagged(spark, sf_dir):
    folder = _folder(spark, "tagged")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    files.write_binary(orders.mapInArrow(_tagged_records, "content binary"), "content", folder, ".ad2cp")
    spark.dataSource.register(tagged.TaggedRecords)
    return spark.read.format("ad2cp").option("splitBytes", 1 << 20), folder


@query(
    """SELECT o_orderkey AS ensemble, CASE o_orderkey % 3 WHEN 0 THEN 'burst' WHEN 1 THEN 'average' ELSE 'echo' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'beam' WHEN 1 THEN 'ENU' END AS coord_sys, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS n_beams,
    CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 5 END AS n_cells, epoch_us(o_orderdate) // 100 * 100 AS us FROM orders WHERE o_orderkey % 40 <> 11"""
)
def record_index(spark, sf_dir):
    reader, folder = _tagged(spark, sf_dir)
    whole = reader.schema(tagged.INDEX).load(folder).where("NOT damaged")
    return whole.select("ensemble", "kind", "coord_sys", "n_beams", "n_cells", F.unix_micros("time").alias("us"))


@query(
    """WITH o AS (SELECT *, o_orderkey % 3 AS m, CASE o_orderkey % 3 WHEN 0 THEN 3 ELSE 2 END AS nc FROM orders WHERE o_orderkey % 40 <> 11 AND o_orderkey % 3 < 2), c AS (SELECT *, unnest(range(nc)) AS cell FROM o)
    SELECT CASE m WHEN 0 THEN 'burst' ELSE 'average' END AS profile, o_orderkey AS ensemble, cell::INTEGER AS cell, (cell + 1) * 0.5::DOUBLE + 0.6::DOUBLE AS range, o_orderkey / 1000::DOUBLE AS pressure, (o_orderkey % 3000) / 100::DOUBLE AS temp,
      round(((o_orderkey * 13 + cell) % 3001 - 1500) / 1000::DOUBLE, 9) AS v1, round(((o_orderkey * 13 + 2 * nc + cell) % 3001 - 1500) / 1000::DOUBLE, 9) AS v3, (o_orderkey + nc + cell) % 200 / 2::DOUBLE AS amp2, ((o_orderkey * 3 + cell) % 100)::INTEGER AS corr1 FROM c"""
)
def profiles_apart(spark, sf_dir):
    reader, folder = _tagged(spark, sf_dir)
    parts = []
    for name, one in zip(("burst", "average"), tagged.profiles(reader.load(folder)), strict=True):
        cells = one.where(F.col("vel").isNotNull()).select(F.lit(name).alias("profile"), "ensemble", "cell_size", "blank", "pressure", "temp", F.posexplode(F.arrays_zip("vel", "amp", "corr")).alias("cell", "c"))
        far = tagged.cell_range(F.col("cell"), F.col("cell_size"), F.col("blank"))
        parts.append(cells.select("profile", "ensemble", "cell", far.alias("range"), "pressure", "temp", F.round(F.col("c.vel")[0], 9).alias("v1"), F.round(F.col("c.vel")[2], 9).alias("v3"), F.col("c.amp")[1].alias("amp2"), F.col("c.corr")[0].alias("corr1")))
    return parts[0].unionByName(parts[1])


@query(
    """SELECT vec_id::INTEGER AS vec_id, label, embedding[1] AS first, embedding[64] AS last, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings"""
)
def netcdf_records(spark, sf_dir):
    """Vectors as records of netCDF files, a file per task, read back by slices."""
    folder = _folder(spark, "netcdf")
    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    netcdf.write(e.select(F.col("vec_id").cast("int").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding"), folder, "record")
    spark.dataSource.register(netcdf.Classic)
    read = spark.read.format("netcdf3").option("splitBytes", 1 << 20).load(folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select("vec_id", "label", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(63)).alias("last"), F.round(total, 6).alias("total"))
