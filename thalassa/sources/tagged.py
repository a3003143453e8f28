"""Files of tagged records (`ad2cp`) of profilers that mix bursts, averages, bottom tracks, altimeters and echograms.

    spark.dataSource.register(tagged.TaggedRecords)
    spark.read.format("ad2cp").option("splitBytes", 64 << 20).load(path)
    spark.read.format("ad2cp").schema(tagged.INDEX).load(path)

One row per record with its kind (`burst`, `average`, `bottom_track`, `beam5`, `burst_raw_altimeter`, `echo`,
`average_raw_altimeter`, `text`, `other`), and per damaged record one with damaged = true and no data. INDEX holds where
records stand and what they are, and reads no further into them. Two profiles of one file are its bursts and its averages:
profiles() takes them apart. Cells stand in the order of range, with one number per beam.

What a record's bits say it holds is decoded; records of one kind, size and layout are decoded together. A header whose own
checksum holds but not that of its data is a damaged record, as is one that the end of the file cuts off.
A published oddity is kept: the temperature of the pressure sensor is a fifth of its count less 20.

Cases: an empty file has no rows; a time that no calendar has, or that is zero, is null; records longer than LONGEST count
as damaged; fields that reach beyond their record are null; bytes between records are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Framing, FrameSource, field, gathered, nested
from .pulse import _hundredths, _times

# Fixed values of the format.
SYNC, FAMILY, CHECK_START = 0xA5, 0x10, 0xB58C
KINDS = {21: "burst", 22: "average", 23: "bottom_track", 24: "beam5", 26: "burst_raw_altimeter", 28: "echo", 31: "average_raw_altimeter", 160: "text"}
FRAMES_OF_REFERENCE = ("ENU", "XYZ", "beam", None)
GRAVITY = 9.81
#: The most bytes of a record that is read.
LONGEST = 1 << 20

INDEX = "file string, pos long, damaged boolean, id int, kind string, bytes long, ensemble long, time timestamp, config int, coord_sys string, n_beams int, n_cells int"
SCHEMA = (
    f"{INDEX}, serial long, c_sound double, temp double, pressure double, heading double, pitch double, roll double, cell_size double, blank double, nominal_corr int, temp_pressure double, "
    "battery double, mag array<double>, accel array<double>, ambiguity_velocity double, beams array<int>, transmit_energy int, power double, temp_clock double, error long, status long, "
    "vel array<array<double>>, amp array<array<double>>, corr array<array<int>>, good array<int>, alt_dist double, alt_quality double, alt_status int, ast_dist double, ast_quality double, "
    "ast_offset double, ast_pressure double, alt_samples array<double>, alt_spacing double, echo array<double>, dist_bt array<double>, vel_bt array<double>, fom_bt array<int>, "
    "orientation_matrix array<double>, quaternions array<double>, angular_rate array<double>, pitch_std double, roll_std double, heading_std double, pressure_std double, text_id int, text string"
)


class Tagged(Framing):
    """0xA5, bytes of the header (10 or 12), kind, family, bytes of the data (2 or 4 of them), two checksums of 16-bit words."""

    longest = LONGEST

    def headers(self, data):
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.append(data, np.zeros(12, np.uint8))
        at = np.flatnonzero((data == SYNC) & np.isin(padded[1 : len(data) + 1], (10, 12)) & (padded[3 : len(data) + 3] == FAMILY))
        head = padded[at + 1].astype(np.int64)
        known = at + head <= len(data)
        at, head, known = at[known | (at + 12 > len(data))], head[known | (at + 12 > len(data))], known[known | (at + 12 > len(data))]
        size = np.full(len(at), self.longest + 1)
        b = lambda i: padded[at + i].astype(np.int64)
        n = b(4) + 256 * b(5) + np.where(head == 12, (b(6) << 16) + (b(7) << 24), 0)
        size[known] = np.minimum((head + n)[known], self.longest + 1)
        # a header of its own checksum stands even where its data don't
        rows = padded[at[:, None] + np.arange(12)].astype(np.int64)
        words = rows[:, 0::2] + 256 * rows[:, 1::2]
        total = CHECK_START + np.where(head == 12, words[:, :5].sum(1), words[:, :4].sum(1))
        good = ~known | (total % 65536 == np.where(head == 12, words[:, 5], words[:, 4]))
        return at[good], size[good]

    def whole(self, data, at, size):
        # sums count modulo 2^16 only, so words and their sums stay of 16 bits
        pairs = lambda lo: np.frombuffer(np.ascontiguousarray(data[lo:]), "<u2", (len(data) - lo) // 2)
        sums = [np.append(np.uint16(0), np.cumsum(pairs(lo), dtype=np.uint16)) for lo in (0, 1)]
        head = data[at + 1].astype(np.int64)
        start, n = at + head, size - head
        even = start % 2 == 0
        of = lambda s, lo: s[np.clip((start - lo) // 2 + n // 2, 0, len(s) - 1)] - s[np.clip((start - lo) // 2, 0, len(s) - 1)]
        total = CHECK_START + np.where(even, of(sums[0], 0), of(sums[1], 1)).astype(np.int64)
        total += np.where(n % 2 == 1, data[np.maximum(at + size - 1, 0)].astype(np.int64) * 256, 0)
        want = np.where(head == 12, data[at + 8] + 256 * data[at + 9].astype(np.int64), data[at + 6] + 256 * data[at + 7].astype(np.int64))
        return (size <= self.longest) & (total % 65536 == want)


class _Fields:
    """Reads fields one after the other from rows; those that reach beyond the rows are left out, and all after them."""

    def __init__(self, rows: np.ndarray, at: int):
        self.rows, self.at, self.out = rows, at, {}

    def take(self, name: str | None, kind: str, n: int = 1, of=None) -> np.ndarray | None:
        width = np.dtype(kind).itemsize * n
        self.at, at = self.at + width, self.at
        if self.at > self.rows.shape[1]:
            return None
        v = field(self.rows, at, kind, n)
        if name:
            v = of(v) if of else v
            self.out[name] = nested(v) if v.ndim > 1 else pa.array(v)
        return v


def _cells(v: np.ndarray, beams: int, cells: int) -> np.ndarray:
    """Numbers by beam and cell as rows of cells of beams."""
    return v.reshape(len(v), beams, cells).transpose(0, 2, 1)


def _wide(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int32)


def _ahrs(f: _Fields) -> None:
    f.take("orientation_matrix", "<f4", 9, lambda v: v.astype(float))
    f.take("quaternions", "<f4", 4, lambda v: v.astype(float))
    f.take("angular_rate", "<f4", 3, lambda v: v.astype(float) * (np.pi / 180))


def _common(b: np.ndarray, bottom: bool) -> dict[str, pa.Array]:
    """What all records of measurements begin with; bottom tracks hold a longer ambiguity velocity and error."""
    u8, u16, i16 = (lambda i: b[:, i].astype(np.int64)), (lambda i: field(b, i, "<u2")), (lambda i: field(b, i, "<i2"))
    zero = (b[:, 9:14] == 0).all(1) & (u16(14) == 0)
    after = 56 if bottom else 54
    described = u16(after).astype(np.int32)
    scale = 1.0 if bottom else 0.1
    out = {
        "time": _times(u8(8) + 1900, np.where(zero, 0, u8(9) + 1), *(u8(i) for i in range(10, 14)), u16(14).astype(np.int64) * 100),
        "serial": pa.array(field(b, 4, "<u4").astype(np.int64)), "c_sound": pa.array(_hundredths(u16(16), 1)), "temp": pa.array(_hundredths(i16(18))), "pressure": pa.array(_hundredths(field(b, 20, "<u4"), 3)),
        "heading": pa.array(_hundredths(u16(24))), "pitch": pa.array(_hundredths(i16(26))), "roll": pa.array(_hundredths(i16(28))), "cell_size": pa.array(_hundredths(u16(32), 3)), "nominal_corr": pa.array(_wide(b[:, 36])),
        "battery": pa.array(_hundredths(u16(38), 1)), "mag": nested(field(b, 40, "<i2", 3) * scale), "accel": nested(field(b, 46, "<i2", 3) * (GRAVITY / 16384)),
        "beams": nested(np.stack([described >> (4 * i) & 15 for i in range(4)], 1)), "transmit_energy": pa.array(u16(after + 2).astype(np.int32)), "power": pa.array(field(b, after + 5, "i1").astype(float)), "temp_clock": pa.array(_hundredths(i16(after + 8))),
    }
    if bottom:
        return out | {"ambiguity_velocity": pa.array(_hundredths(field(b, 52, "<u4"), 3)), "error": pa.array(field(b, 66, "<u4").astype(np.int64)), "status": pa.array(field(b, 70, "<u4").astype(np.int64))}
    return out | {
        "temp_pressure": pa.array((field(b, 37, "i1").astype(float) - 20) * 0.2), "ambiguity_velocity": pa.array(_hundredths(i16(52), 3)), "error": pa.array(u16(64).astype(np.int64)), "status": pa.array(field(b, 68, "<u4").astype(np.int64)),
    }


class TaggedRecords(FrameSource):
    framing = Tagged()

    @classmethod
    def name(cls) -> str:
        return "ad2cp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        self.wanted = set(schema.fieldNames())
        return super().reader(schema)

    def decoded(self, data: bytes, begin: int, at: np.ndarray, size: np.ndarray, bad: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        if len(bad):
            yield {"pos": pa.array(bad), "damaged": pa.array(np.ones(len(bad), bool))}
        if not len(at):
            return
        raw = np.frombuffer(data, np.uint8)
        byte = lambda i: raw[np.minimum(at + head + i, len(raw) - 1)].astype(np.int64)
        head = raw[at + 1].astype(np.int64)
        # records of equal size, kind, bits and cells have one layout
        traits = np.stack([size, head, raw[at + 2].astype(np.int64), *(byte(i) for i in (1, 2, 3, 30, 31))], 1)
        _, which = np.unique(traits, axis=0, return_inverse=True)
        for g in range(int(which.max()) + 1):
            own = which.reshape(-1) == g
            yield from self._layout(gathered(data, at[own], int(size[own][0])), at[own] + begin)

    def _layout(self, rows: np.ndarray, pos: np.ndarray) -> Iterator[dict[str, pa.Array]]:
        n, kind, head = len(rows), int(rows[0, 2]), int(rows[0, 1])
        out = {"pos": pa.array(pos), "damaged": pa.array(np.zeros(n, bool)), "id": pa.array([kind] * n, pa.int32()), "kind": pa.array([KINDS.get(kind, "other")] * n), "bytes": pa.array([rows.shape[1]] * n, pa.int64())}
        b, bottom = rows[:, head:], kind == 23
        if KINDS.get(kind) == "text" and b.shape[1]:
            out |= {"text_id": pa.array(_wide(b[:, 0])), "text": pa.array([r[1:-1].tobytes().decode("utf-8", "replace") for r in b])}
        elif kind in KINDS and b.shape[1] >= (78 if bottom else 76):
            bits, set_ = int(field(b[:1], 2, "<u2")[0]), int(field(b[:1], 30, "<u2")[0])
            cells, system, beams = (set_, None, 1) if kind == 28 else (set_ & 1023, "beam", 1) if kind in (26, 31) else (set_ & 1023, FRAMES_OF_REFERENCE[set_ >> 10 & 3], set_ >> 12)
            same = lambda v, t: pa.array([v] * n, t)
            out |= {"config": same(bits, pa.int32()), "coord_sys": same(system, pa.string()), "n_beams": same(beams, pa.int32()), "n_cells": same(cells, pa.int32()), "ensemble": pa.array(field(b, 74 if bottom else 72, "<u4").astype(np.int64))}
            common = _common(b, bottom)
            out["time"] = common["time"]
            if self.wanted - set(out) - {"file"}:
                # echograms hold their blanking distance in finer units
                out |= common | {"blank": pa.array(_hundredths(field(b, 34, "<u2"), 3 if kind == 28 else 2))}
                out |= self._bottom(b, bits, beams) if bottom else self._measured(b, kind, bits, beams, cells)
        yield out

    def _bottom(self, b: np.ndarray, bits: int, beams: int) -> dict[str, pa.Array]:
        scale = 10.0 ** field(b, 60, "i1").astype(float)[:, None]
        f = _Fields(b, max(int(b[0, 1]), 78))
        if bits >> 5 & 1:
            f.take("vel_bt", "<i4", beams, lambda v: v.reshape(len(b), beams) * scale)
        if bits >> 8 & 1:
            f.take("dist_bt", "<i4", beams, lambda v: _hundredths(v.reshape(len(b), beams), 3))
        if bits >> 9 & 1:
            f.take("fom_bt", "<u2", beams, lambda v: _wide(v.reshape(len(b), beams)))
        if bits >> 10 & 1:
            _ahrs(f)
        return f.out

    def _measured(self, b: np.ndarray, kind: int, bits: int, beams: int, cells: int) -> dict[str, pa.Array]:
        has = lambda bit: bits >> bit & 1
        f, n = _Fields(b, max(int(b[0, 1]), 76)), beams * cells
        scale = 10.0 ** field(b, 58, "i1").astype(float)[:, None, None]
        if has(5):
            f.take("vel", "<i2", n, lambda v: _cells(v, beams, cells) * scale)
        if has(6):
            f.take("amp", "u1", n, lambda v: _cells(v, beams, cells) * 0.5)
        if has(7):
            f.take("corr", "u1", n, lambda v: _wide(_cells(v, beams, cells)))
        if has(8):
            f.take("alt_dist", "<f4", of=lambda v: v.astype(float))
            f.take("alt_quality", "<u2", of=_hundredths)
            f.take("alt_status", "<u2", of=_wide)
        if has(10):
            f.take("ast_dist", "<f4", of=lambda v: v.astype(float))
            f.take("ast_quality", "<u2", of=_hundredths)
            f.take("ast_offset", "<i2", of=lambda v: _hundredths(v, 4))
            f.take("ast_pressure", "<f4", of=lambda v: v.astype(float))
            f.at += 8
        if has(9):
            counts = f.take(None, "<u4")
            f.take("alt_spacing", "<u2", of=lambda v: _hundredths(v, 4))
            if counts is not None and (counts == counts[0]).all():
                # signed fractions of 8 bits
                f.take("alt_samples", "<i2", int(counts[0]), lambda v: v.reshape(len(b), -1) / 256)
        if has(11):
            f.take("echo", "<u2", cells, lambda v: _hundredths(v.reshape(len(b), cells)))
        if has(12):
            _ahrs(f)
        if has(13):
            f.take("good", "u1", cells, lambda v: _wide(v.reshape(len(b), cells)))
        if has(14):
            for name, places in (("pitch_std", 2), ("roll_std", 2), ("heading_std", 2), ("pressure_std", 1)):
                f.take(name, "<i2", of=lambda v, p=places: _hundredths(v, p))
        return f.out


def profiles(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole records of the two profiles of a file apart: bursts with what goes with them, and averages."""
    whole = records.where(~F.col("damaged"))
    return whole.where(F.col("kind").isin("burst", "beam5", "burst_raw_altimeter", "echo", "bottom_track")), whole.where(F.col("kind").isin("average", "average_raw_altimeter"))


def cell_range(cell: Column, cell_size: Column, blank: Column) -> Column:
    """The range of a cell, counted from 0."""
    return (cell + 1) * cell_size + blank


def status_bits(status: Column) -> dict[str, Column]:
    """What the status of a burst or average says."""
    bits = lambda lo, n: F.shiftright(status, lo).bitwiseAND(F.lit((1 << n) - 1))
    return {
        "wakeup_state": bits(28, 4), "orientation": bits(25, 3), "auto_orientation": bits(22, 3), "previous_wakeup_state": bits(18, 4), "low_volt_skip": bits(17, 1) == 1, "active_config": bits(16, 1),
        "echo_index": bits(12, 4), "telemetry_data": bits(11, 1) == 1, "boost_running": bits(10, 1) == 1, "echo_freq_bin": bits(5, 5), "blank_in_cm": bits(1, 1) == 1,
    }


def altimeter_bits(status: Column) -> dict[str, Column]:
    """What the status of an altimeter says."""
    bits = lambda lo, n: F.shiftright(status, lo).bitwiseAND(F.lit((1 << n) - 1))
    power = F.element_at(F.array(*map(F.lit, ("high", "med-high", "med-low", "low"))), (bits(7, 2) + 1).cast("int"))
    return {"tilt_over_5deg": bits(0, 1) == 1, "tilt_over_10deg": bits(1, 1) == 1, "multibeam": bits(2, 1) == 1, "n_beams": bits(3, 4), "power_level": power}


def record_rows(kind: int, body: np.ndarray) -> np.ndarray:
    """Whole records of one kind, one a row, from their bodies."""
    n = body.shape[1]
    words = np.concatenate([body, np.zeros((len(body), n % 2), np.uint8)], 1).astype(np.int64)
    # the last byte of an odd number counts as an upper one
    odd = words[:, -2] * 256 - words[:, -2] if n % 2 else 0
    check = (CHECK_START + words[:, 0::2].sum(1) + 256 * words[:, 1::2].sum(1) + odd) % 65536
    head = np.zeros((len(body), 10), np.uint8)
    head[:, :6] = [SYNC, 10, kind, FAMILY, n & 255, n >> 8]
    head[:, 6], head[:, 7] = check & 255, check >> 8
    own = (CHECK_START + head[:, 0:8:2].astype(np.int64).sum(1) + 256 * head[:, 1:8:2].astype(np.int64).sum(1)) % 65536
    head[:, 8], head[:, 9] = own & 255, own >> 8
    return np.concatenate([head, body], 1)
