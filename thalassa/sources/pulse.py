"""Files of pulse-averaged profilers (`pd0`): ensembles of tagged blocks behind a header, with a checksum of all bytes.

    spark.dataSource.register(pulse.PulseProfiles)
    spark.read.format("pd0").option("splitBytes", 64 << 20).load(path)

One row per ensemble and profile (0, and 1 where an instrument keeps a second one in blocks of its own), and per damaged
ensemble one with damaged = true and no data. Cells stand in the order of range, four beams each; `vel` of -32768 is null.
A published oddity is kept: the upper byte of the ensemble number counts 65535.
Blocks of no listed kind are left out. Layouts differ from ensemble to ensemble; those of one layout are decoded together.

Cases: an empty file has no rows; a time that no calendar has is null, with the other columns kept; blocks that reach
beyond their ensemble are left out of it; bytes between ensembles are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Framing, FrameSource, field, gathered, nested

# Fixed values of the format.
MODELS = {
    4: "Broadband", 5: "Broadband", 6: "Navigator", 8: "Workhorse", 9: "Navigator", 10: "Rio Grande", 11: "H-ADCP", 14: "Ocean Surveyor",
    16: "Workhorse", 19: "Navigator", 23: "Ocean Surveyor", 28: "ChannelMaster", 31: "StreamPro", 34: "Explorer", 37: "Navigator", 41: "DVS",
    43: "Workhorse", 44: "RiverRay", 47: "SentinelV", 50: "Workhorse", 51: "Workhorse", 52: "Workhorse", 53: "Navigator", 55: "DVS",
    56: "RiverPro", 59: "Meridian", 61: "Pinnacle", 66: "SentinelV", 67: "Pathfinder", 73: "Pioneer", 74: "Tasman", 76: "WayFinder",
    77: "Workhorse", 78: "Workhorse",
}
CARRIERS = (75, 150, 300, 600, 1200, 2400, 38)
CARRIERS_V = (38.4, 76.8, 153.6, 307.2, 491.52, 983.04, 2457.6)
FRAMES_OF_REFERENCE = ("beam", "inst", "ship", "earth")
FIXED, VARIABLE, VELOCITY, CORRELATION, AMPLITUDE, GOOD, STATUS = 0x0000, 0x0080, 0x0100, 0x0200, 0x0300, 0x0400, 0x0500
BOTTOM, NAVIGATION, ALTIMETER = 0x0600, 0x2000, 0x4100
BEAM5, BEAM5_VELOCITY, BEAM5_CORRELATION, BEAM5_AMPLITUDE, BEAM5_GOOD = 0x0F01, 0x0A00, 0x0B00, 0x0C00, 0x0D00
LOST = -32768
CENTURY = 2000

_CONFIG = (
    "firmware double, model string, beam_angle int, carrier double, beam_pattern string, orientation string, n_beams int, n_cells int, pings int, cell_size double, blank double, "
    "mode int, min_correlation int, code_repeats int, min_good int, max_error_velocity double, ping_interval double, coord_sys string, use_tilt boolean, use_3_beams boolean, "
    "bin_mapping boolean, misalignment double, declination double, sensors string, sensors_available string, bin1 double, transmit_pulse double, transmit_lag double"
)
_CELLS = "array<array<{}>>"
SCHEMA = (
    f"file string, pos long, damaged boolean, profile int, number long, time timestamp, c_sound double, depth double, heading double, pitch double, roll double, salinity double, temp double, "
    f"preping_wait double, heading_std double, pitch_std double, roll_std double, built_in_test int, error_status long, pressure double, pressure_std double, config struct<{_CONFIG.replace(' ', ':').replace(',:', ',')}>, "
    f"vel {_CELLS.format('double')}, corr {_CELLS.format('int')}, amp {_CELLS.format('int')}, good {_CELLS.format('int')}, status {_CELLS.format('int')}, "
    "dist_bt array<double>, vel_bt array<double>, corr_bt array<int>, amp_bt array<int>, good_bt array<int>, alt_dist double, alt_rssi int, alt_eval int, alt_status int, "
    "time_gps timestamp, clock_offset double, latitude double, longitude double, speed_over_ground double, direction_over_ground double, speed_made_good double, direction_made_good double, "
    "pitch_gps double, roll_gps double, heading_gps double, time_b5 timestamp, cell_size_b5 double, bin1_b5 double, vel_b5 array<double>, corr_b5 array<int>, amp_b5 array<int>, good_b5 array<int>"
)


class Ensembles(Framing):
    """0x7F7F, the bytes up to the checksum, a spare byte, the number of blocks, their offsets; at the end the sum of all bytes."""

    longest = 0xFFFF + 2

    def headers(self, data):
        at = np.flatnonzero((data[:-1] == 0x7F) & (data[1:] == 0x7F)) if len(data) else np.zeros(0, np.int64)
        # a header that the end of the data cuts off has a size beyond it
        known = at + 6 <= len(data)
        size = np.full(len(at), self.longest + 1)
        a = at[known]
        size[known] = data[a + 2].astype(np.int64) + 256 * data[a + 3].astype(np.int64) + 2
        return at, size

    def whole(self, data, at, size):
        total = np.append(0, np.cumsum(data, dtype=np.int64))
        end = at + size - 2
        blocks = data[np.minimum(at + 5, len(data) - 1)].astype(np.int64)
        fits = size >= 8 + 2 * blocks
        return fits & (blocks > 0) & ((total[end] - total[at]) % 65536 == data[end].astype(np.int64) + 256 * data[end + 1].astype(np.int64))


def _times(year, month, day, hour, minute, second, micros) -> pa.Array:
    """Timestamps (UTC), null where the calendar has no such time."""
    year, month, day = (np.asarray(v, np.int64) for v in (year, month, day))
    ok = (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (micros < 1_000_000) & (micros >= 0)
    months = (year - 1970) * 12 + np.where(ok, month, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    ok &= day <= length
    us = (((first + day - 1) * 24 + hour) * 60 + minute) * 60 + second
    return pa.array(us * 1_000_000 + micros, pa.int64(), mask=~ok).cast(pa.timestamp("us", "UTC"))


def _clock(r: np.ndarray) -> pa.Array:
    """The time of a clock's seven bytes, a year below 100 in CENTURY."""
    r = r.astype(np.int64)
    return _times(np.where(r[:, 0] < 100, r[:, 0] + CENTURY, r[:, 0]), *(r[:, i] for i in range(1, 6)), r[:, 6] * 10_000)


def _hundredths(v: np.ndarray, places: int = 2) -> np.ndarray:
    """Counts of 10^-places as the nearest doubles to their decimals."""
    return v.astype(np.float64) / 10**places


def _choice(options, index: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(index, pa.int32()), pa.array(options)).dictionary_decode()


def _bits(v: np.ndarray) -> pa.Array:
    return pa.array([f"{int(i):08b}" for i in v])


def _config(b: np.ndarray) -> dict[str, pa.Array]:
    """The fixed leader, after its two bytes of kind."""
    u8, u16 = (lambda i: b[:, i].astype(np.int32)), (lambda i: field(b, i, "<u2"))
    major, low, high = u8(0), u8(2), u8(3)
    angle = np.choose(high & 3, [15, 20, 30, np.where(np.isin(major, (11, 47, 66)), 25, 0)])
    at = np.minimum(low & 7, 6)
    carrier = np.select([np.isin(major, (47, 66)), major == 31, major == 61], [np.array(CARRIERS_V)[at], 2000.0, 44.0], np.array(CARRIERS, float)[at])
    firmware = major + _hundredths(u8(1))
    if b.shape[1] >= 57:
        angle = np.where((firmware >= 9.68) & (angle == 0), u8(56), angle)
    system = u8(23)
    flag = lambda bit: pa.array((system & bit) == bit)
    return {
        "firmware": pa.array(firmware), "model": pa.array([MODELS.get(int(m), "unrecognized instrument") for m in major]), "beam_angle": pa.array(angle.astype(np.int32)), "carrier": pa.array(carrier),
        "beam_pattern": _choice(["concave", "convex"], low >> 3 & 1), "orientation": _choice(["down", "up"], low >> 7 & 1),
        "n_beams": pa.array(u8(6) + (high >> 4 & 1)), "n_cells": pa.array(u8(7)), "pings": pa.array(u16(8).astype(np.int32)), "cell_size": pa.array(_hundredths(u16(10))), "blank": pa.array(_hundredths(u16(12))),
        "mode": pa.array(u8(14)), "min_correlation": pa.array(u8(15)), "code_repeats": pa.array(u8(16)), "min_good": pa.array(u8(17)), "max_error_velocity": pa.array(_hundredths(u16(18), 3)),
        "ping_interval": pa.array(_hundredths(u8(20) * 6000 + u8(21) * 100 + u8(22))), "coord_sys": _choice(FRAMES_OF_REFERENCE, system >> 3 & 3), "use_tilt": flag(4), "use_3_beams": flag(2), "bin_mapping": flag(1),
        "misalignment": pa.array(_hundredths(field(b, 24, "<i2"))), "declination": pa.array(_hundredths(field(b, 26, "<i2"))), "sensors": _bits(u8(28)), "sensors_available": _bits(u8(29)),
        "bin1": pa.array(_hundredths(u16(30))), "transmit_pulse": pa.array(_hundredths(u16(32))), "transmit_lag": pa.array(_hundredths(u16(38))),
    }


def _state(b: np.ndarray, firmware: float, model: str) -> dict[str, pa.Array]:
    """The variable leader, after its two bytes of kind."""
    u8, u16, i16 = (lambda i: b[:, i].astype(np.int64)), (lambda i: field(b, i, "<u2")), (lambda i: field(b, i, "<i2"))
    clock, whole = b[:, 2:9], np.zeros(len(b), np.int64)
    out = {
        "number": pa.array(u16(0).astype(np.int64) + 65535 * u8(9)), "built_in_test": pa.array(u16(10).astype(np.int32)), "c_sound": pa.array(u16(12).astype(float)), "depth": pa.array(_hundredths(u16(14), 1)),
        "heading": pa.array(_hundredths(u16(16))), "pitch": pa.array(_hundredths(i16(18))), "roll": pa.array(_hundredths(i16(20))), "salinity": pa.array(i16(22).astype(float)), "temp": pa.array(_hundredths(i16(24))),
        "preping_wait": pa.array(_hundredths(u8(26) * 6000 + u8(27) * 100 + u8(28))), "heading_std": pa.array(u8(29).astype(float)), "pitch_std": pa.array(_hundredths(u8(30), 1)), "roll_std": pa.array(_hundredths(u8(31), 1)),
    }
    width = b.shape[1]
    if model == "Broadband":
        if firmware >= 5.55 and width >= 63:
            clock, whole = b[:, 56:63], u8(55)
    elif model != "Ocean Surveyor":
        if width >= 44:
            out["error_status"] = pa.array(field(b, 40, "<u4").astype(np.int64))
        if firmware >= 8.13 and width >= 54:
            out["pressure"], out["pressure_std"] = (pa.array(_hundredths(field(b, i, "<u4"), 3)) for i in (46, 50))
        if firmware >= 16.05 and width >= 63:
            clock, whole = b[:, 56:63], u8(55)
    full = clock.astype(np.int64)
    full[:, 0] += 100 * whole
    return {**out, "time": _clock(full)}


def _bottom(b: np.ndarray, firmware: float) -> dict[str, pa.Array]:
    near = _hundredths(field(b, 14, "<u2", 4))
    if firmware >= 5.3 and b.shape[1] >= 79:
        near = (field(b, 14, "<u2", 4).astype(np.int64) + 65536 * field(b, 75, "u1", 4).astype(np.int64)) / 100
    ints = lambda i: nested(field(b, i, "u1", 4).astype(np.int32))
    return {"dist_bt": nested(near), "vel_bt": nested(_hundredths(field(b, 22, "<i2", 4), 3)), "corr_bt": ints(30), "amp_bt": ints(34), "good_bt": ints(38)}


def _navigation(b: np.ndarray) -> dict[str, pa.Array]:
    """The last fix before the ensemble, and what was averaged over it."""
    u16 = lambda i: field(b, i, "<u2").astype(np.int64)
    degrees32, degrees16 = (lambda i: field(b, i, "<i4") * (180 / 2**31)), (lambda i: u16(i) * (180 / 2**15))
    clock = field(b, 20, "<u4").astype(np.int64) // 10
    day = _times(u16(2), b[:, 1].astype(np.int64), b[:, 0].astype(np.int64), *[np.zeros(len(b), np.int64)] * 4).cast(pa.int64())
    time = pa.compute.add(day, pa.array(clock * 1000)).cast(pa.timestamp("us", "UTC"))
    return {
        "time_gps": time, "clock_offset": pa.array(_hundredths(field(b, 8, "<i4"), 3)), "latitude": pa.array(degrees32(24)), "longitude": pa.array(degrees32(28)),
        "speed_over_ground": pa.array(_hundredths(u16(32), 3)), "direction_over_ground": pa.array(degrees16(34)), "speed_made_good": pa.array(_hundredths(u16(38), 3)), "direction_made_good": pa.array(degrees16(40)),
        "pitch_gps": pa.array(degrees16(60)), "roll_gps": pa.array(degrees16(62)), "heading_gps": pa.array(degrees16(64)),
    }


def _beam5(blocks: dict[int, np.ndarray], time: pa.Array) -> dict[str, pa.Array]:
    b = blocks[BEAM5]
    n = int(field(b[:1], 0, "<u2")[0])
    offset = pa.array(field(b, 28, "<u2").astype(np.int64) * 1000)
    out = {"cell_size_b5": pa.array(_hundredths(field(b, 4, "<u2"))), "bin1_b5": pa.array(_hundredths(field(b, 6, "<u2"))), "time_b5": pa.compute.add(time.cast(pa.int64()), offset).cast(pa.timestamp("us", "UTC"))}
    if (v := blocks.get(BEAM5_VELOCITY)) is not None and v.shape[1] >= 2 * n:
        out["vel_b5"] = nested(_hundredths(field(v, 0, "<i2", n).reshape(len(v), n), 3))
    for kind, name in ((BEAM5_CORRELATION, "corr_b5"), (BEAM5_AMPLITUDE, "amp_b5"), (BEAM5_GOOD, "good_b5")):
        if (v := blocks.get(kind)) is not None and v.shape[1] >= n:
            out[name] = nested(v[:, :n].astype(np.int32))
    return out


def _cells(blocks: dict[int, np.ndarray], profile: int, n: int) -> dict[str, pa.Array]:
    out = {}
    if (v := blocks.get(VELOCITY + profile)) is not None and v.shape[1] >= 8 * n:
        counts = field(v, 0, "<i2", 4 * n).reshape(len(v), n, 4)
        speed = _hundredths(counts, 3)
        speed[counts == LOST] = np.nan
        out["vel"] = nested(speed)
    for kind, name in ((CORRELATION, "corr"), (AMPLITUDE, "amp"), (GOOD, "good"), (STATUS, "status")):
        if (v := blocks.get(kind + profile)) is not None and v.shape[1] >= 4 * n:
            out[name] = nested(v[:, : 4 * n].reshape(len(v), n, 4).astype(np.int32))
    return out


class PulseProfiles(FrameSource):
    framing = Ensembles()

    @classmethod
    def name(cls) -> str:
        return "pd0"

    def schema(self) -> str:
        return SCHEMA

    def decoded(self, data: bytes, begin: int, at: np.ndarray, size: np.ndarray, bad: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        if len(bad):
            yield {"pos": pa.array(bad), "damaged": pa.array(np.ones(len(bad), bool))}
        # ensembles of equal header, and then of equal kinds, cells and firmware, have one layout
        heads: dict[bytes, list[int]] = {}
        for i, p in enumerate(at):
            heads.setdefault(data[p : p + 6 + 2 * data[p + 5]], []).append(i)
        for head, members in heads.items():
            places = at[members]
            rows = gathered(data, places, int(size[members[0]]))
            offsets = np.frombuffer(head, "<u2", offset=6).astype(np.int64)
            offsets = offsets[offsets + 2 <= rows.shape[1] - 2]
            kinds = np.stack([field(rows, o, "<u2") for o in offsets], 1) if len(offsets) else np.zeros((len(rows), 0), np.uint16)
            fixed = [(kinds == FIXED + p).argmax(1) for p in (0, 1)]
            traits = [np.take_along_axis(rows, (offsets[f] + i).clip(0, rows.shape[1] - 1)[:, None], 1) for f in fixed for i in (2, 3, 9)] if len(offsets) else []
            beam5 = [np.take_along_axis(rows, (offsets[(kinds == BEAM5).argmax(1)] + i).clip(0, rows.shape[1] - 1)[:, None], 1) for i in (2, 3)] if len(offsets) else []
            _, which = np.unique(np.concatenate([kinds, *traits, *beam5], 1), axis=0, return_inverse=True)
            for g in range(int(which.max()) + 1):
                own = which.reshape(-1) == g
                yield from self._layout(rows[own], places[own] + begin, offsets, kinds[own][0])

    def _layout(self, rows: np.ndarray, pos: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        ends = [min((o for o in offsets if o > p), default=rows.shape[1] - 2) for p in offsets]
        blocks: dict[int, np.ndarray] = {}
        for k, o, e in zip(kinds, offsets, ends, strict=True):
            blocks.setdefault(int(k), rows[:, o + 2 : e])
        n = len(rows)
        shared = {"pos": pa.array(pos), "damaged": pa.array(np.zeros(n, bool))}
        profiles = [p for p in (0, 1) if blocks.get(FIXED + p, np.zeros((0, 0))).shape[1] >= 40]
        for p in profiles or [None]:
            out = dict(shared)
            if p is not None:
                fixed = blocks[FIXED + p]
                config = _config(fixed)
                firmware, model = config["firmware"][0].as_py(), config["model"][0].as_py()
                out |= {"profile": pa.array([p] * n, pa.int32()), "config": pa.StructArray.from_arrays(list(config.values()), list(config))}
                out |= _cells(blocks, p, int(fixed[0, 7]))
                leader = blocks.get(VARIABLE + p, blocks.get(VARIABLE))
                if leader is not None and leader.shape[1] >= 40:
                    out |= _state(leader, firmware, model)
                if p == 0:
                    if (b := blocks.get(BOTTOM)) is not None and b.shape[1] >= 42:
                        out |= _bottom(b, firmware)
                    if (b := blocks.get(NAVIGATION)) is not None and b.shape[1] >= 66:
                        out |= _navigation(b)
                    if (b := blocks.get(ALTIMETER)) is not None and b.shape[1] >= 7:
                        out |= {"alt_eval": pa.array(b[:, 0].astype(np.int32)), "alt_rssi": pa.array(b[:, 1].astype(np.int32)), "alt_dist": pa.array(_hundredths(field(b, 2, "<u4"), 3)), "alt_status": pa.array(b[:, 6].astype(np.int32))}
                    if (b := blocks.get(BEAM5)) is not None and b.shape[1] >= 30 and "time" in out:
                        out |= _beam5(blocks, out["time"])
            yield out


def by_cell(ensembles: DataFrame, *keep: str | Column) -> DataFrame:
    """keep, cell (from 0), range, and vel, corr, amp and good by beam: one row per cell of each whole ensemble."""
    names = ("vel", "corr", "amp", "good")
    far = F.transform("vel", lambda _, i: F.col("config.bin1") + i * F.col("config.cell_size"))
    each = ensembles.where(~F.col("damaged") & F.col("vel").isNotNull()).select(*keep, F.posexplode(F.arrays_zip(far.alias("range"), *names)).alias("cell", "_c"))
    return each.select("*", *[F.col(f"_c.{n}").alias(n) for n in ("range", *names)]).drop("_c")


def sample_rate(config: Column) -> Column:
    """Ensembles a second of an instrument that averages its pings; null where it states no time between pings."""
    return 1 / F.nullif(config["ping_interval"] * config["pings"], F.lit(0.0))


def _block(kind: int, body: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full((len(body), 1), kind & 255, np.uint8), np.full((len(body), 1), kind >> 8, np.uint8), body], 1)


def bytes_of(kind: str, values: np.ndarray) -> np.ndarray:
    """Numbers as rows of bytes."""
    values = np.ascontiguousarray(values.reshape(len(values), -1).astype(kind))
    return values.view(np.uint8).reshape(len(values), -1)


def ensemble_rows(blocks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Whole ensembles, one a row, from the bodies of their blocks."""
    parts = [_block(k, b) for k, b in blocks]
    head = 6 + 2 * len(parts)
    offsets = head + np.cumsum([0, *(p.shape[1] for p in parts)])
    start = np.concatenate([[0x7F, 0x7F], bytes_of("<u2", offsets[None, -1:])[0], [0, len(parts)], bytes_of("<u2", offsets[None, :-1])[0]]).astype(np.uint8)
    body = np.concatenate([np.repeat(start[None], len(parts[0]), 0), *parts], 1)
    return np.concatenate([body, bytes_of("<u2", (body.astype(np.int64).sum(1) % 65536)[:, None])], 1)
