"""Instrument files by byte range against a plain sequential decode."""

import datetime as dt
import struct

import numpy as np
import pytest

from thalassa.sources import frames, pulse


def fixed(rng, n_cells, firmware=(50, 40), config=0b10001001, high=0b01000001):
    head = struct.pack("<BBBBBBBB", *firmware, config, high, 0, 5, 4, n_cells)
    body = struct.pack("<HHHBBBBHBBBBhhBB", 45, 100, 44, 1, 64, 9, 0, 2000, 0, 1, 50, 0b00011111, -150, 275, 0x7D, 0x3D)
    tail = struct.pack("<HHBBBBH", 152, 108, 1, 5, 50, 0, 25)
    return head + body + tail + bytes(8) + struct.pack("<HBBIB", 1, 255, 0, 12345, 20)


def variable(rng, number, clock, msb=0, century=20, short=False):
    y = struct.pack("<H7BB", number % 65536, *clock, msb)
    y += struct.pack("<HHHHhhhh", 3, 1500 + number % 7, 123, number * 37 % 36000, -1234, 567, 35, 1520) + bytes([0, 1, 50, 2, 13, 14]) + rng.bytes(8)
    return y if short else y + struct.pack("<I", 7) + bytes(2) + struct.pack("<II", 10_000 + number, 11) + bytes([0, century, *clock])


def ensemble(blocks):
    head = 6 + 2 * len(blocks)
    at, body, offsets = head, b"", []
    for kind, data in blocks:
        offsets.append(at)
        body += struct.pack("<H", kind) + data
        at += 2 + len(data)
    out = b"\x7f\x7f" + struct.pack("<HBB", at, 0, len(blocks)) + struct.pack(f"<{len(blocks)}H", *offsets) + body
    return out + struct.pack("<H", sum(out) % 65536)


def cells(rng, n):
    v = rng.integers(-3000, 3000, (n, 4)).astype("<i2")
    v[rng.random((n, 4)) < 0.1] = -32768
    return v


def file(rng, n=60):
    """(bytes, ensembles as (place, number, time, velocities of both profiles)), with damage of all kinds between."""
    out, want = rng.bytes(11).replace(b"\x7f", b"\x00"), []
    for i in range(n):
        n_cells = int(rng.choice([1, 5, 30]))
        # velocities and counts that look like headers
        a, b = cells(rng, n_cells), cells(rng, 3)
        if i % 4 == 0:
            a[0, :2] = 0x7F7F
        clock = (24, 1 + i % 12, 1 + i % 28, i % 24, i % 60, (7 * i) % 60, i % 100)
        blocks = [(0, fixed(rng, n_cells)), (0x80, variable(rng, i, clock, i % 2)), (0x100, a.tobytes())]
        blocks += [(k, rng.integers(0, 256, 4 * n_cells).astype(np.uint8).tobytes()) for k in (0x200, 0x300, 0x400)]
        if i % 3 == 0:
            blocks += [(1, fixed(rng, 3)), (0x101, b.tobytes())]
        if i % 5 == 0:
            blocks += [(0x7777, b"\x7f\x7f\x08\x00\x00\x00" + rng.bytes(9)), (0x0B, bytes(51))]
        record = ensemble(blocks)
        if i % 11 == 10:
            record = record[:-1] + bytes([record[-1] ^ 1])
        elif i % 13 == 12:
            record = record[: len(record) // 2]
        else:
            want.append((len(out), i + 65535 * (i % 2), dt.datetime(2024, *clock[1:6], clock[6] * 10_000), a, b if i % 3 == 0 else None))
        out += record
        if i % 7 == 6:
            out += rng.bytes(int(rng.integers(1, 300))).replace(b"\x7f", b"\x01")
    # an ensemble around a whole one, and the file ends within one
    inner = ensemble([(0x7777, bytes(20))])
    outer = ensemble([(0, fixed(rng, 2)), (0x80, variable(rng, 900, (24, 1, 1, 0, 0, 0, 0))), (0x7778, inner)])
    want.append((len(out), 900, dt.datetime(2024, 1, 1), None, None))
    return out + outer + outer[:40], want


def sequential(data, framing):
    """Places of the records that reading from the start finds."""
    raw, at, out = np.frombuffer(data, np.uint8), 0, []
    places, sizes = framing.headers(raw)
    known = dict(zip(places.tolist(), sizes.tolist()))
    while at < len(data):
        n = known.get(at)
        if n and at + n <= len(data) and framing.whole(raw, np.array([at]), np.array([n]))[0]:
            out.append((at, n))
            at += n
        else:
            at += 1
    return out


@pytest.mark.parametrize("step", [1000, 4096, 70_000, 1 << 30])
def test_islands_do_not_depend_on_ranges(step):
    rng = np.random.default_rng(0)
    data, want = file(rng)
    got, bad = [], []
    for lo in range(0, len(data), step):
        part, begin, at, size, damaged = frames.records(pulse.Ensembles(), lambda a, n: data[a : a + n], len(data), lo, min(len(data), lo + step))
        got += [(int(a) + begin, int(s)) for a, s in zip(at, size)]
        bad += damaged.tolist()
    assert got == sequential(data, pulse.Ensembles()) and [p for p, _ in got] == [w[0] for w in want]
    assert bad == sorted(set(bad)) and all(not any(p <= b < p + s for p, s in got) for b in bad) and len(bad) >= 60 // 11 + 60 // 13 + 1


class Overlaps(frames.Framing):
    """Records of two bytes, 1 and a length, that all hold: every run of ones and twos is one island."""

    longest = 40

    def headers(self, data):
        at = np.flatnonzero(data == 1)
        at = at[at + 1 < len(data)]
        return at, np.maximum(data[at + 1].astype(np.int64), 2)

    def whole(self, data, at, size):
        return np.ones(len(at), bool)


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_overlapping_records(step):
    rng = np.random.default_rng(1)
    for share in (0.02, 0.2):
        data = np.where(rng.random(3000) < share, 1, rng.integers(2, 40, 3000)).astype(np.uint8).tobytes()
        got = []
        for lo in range(0, len(data), step):
            _, begin, at, size, _ = frames.records(Overlaps(), lambda a, n: data[a : a + n], len(data), lo, min(len(data), lo + step))
            got += [(int(a) + begin, int(s)) for a, s in zip(at, size)]
        assert got == [(a, s) for a, s in sequential(data, Overlaps())]


@pytest.mark.parametrize("split", [2000, 1 << 26])
def test_pulse_files(spark, tmp_path, split):
    rng = np.random.default_rng(3)
    both = [file(rng), file(rng, 20)]
    for i, (data, _) in enumerate(both):
        (tmp_path / f"f{i}.pd0").write_bytes(data)
    (tmp_path / "empty.pd0").write_bytes(b"")
    spark.dataSource.register(pulse.PulseProfiles)
    table = spark.read.format("pd0").option("splitBytes", split).load(f"file://{tmp_path}/*.pd0")
    rows = sorted(table.selectExpr("*", "cast(cast(time as timestamp_ntz) as string) as at").collect(), key=lambda r: (r.file, r.pos, r.profile or 0))
    for i, (data, want) in enumerate(both):
        got = [r for r in rows if r.file.endswith(f"f{i}.pd0") and not r.damaged]
        flat = [(w, p) for w in want for p in ((0, 1) if w[4] is not None else (0,))]
        assert [(r.pos, r.profile) for r in got] == [(w[0], p) for w, p in flat]
        for r, (w, p) in zip(got, flat):
            n = w[1] % 65535 % 65536
            assert r.number == w[1] and dt.datetime.fromisoformat(r.at) == w[2]
            assert (r.config.model, r.config.firmware, r.config.carrier, r.config.orientation, r.config.beam_pattern, r.config.beam_angle) == ("Workhorse", 50.4, 150.0, "up", "convex", 20)
            assert (r.config.pings, r.config.cell_size, r.config.blank, r.config.bin1, r.config.coord_sys, r.config.misalignment, r.config.ping_interval) == (45, 1.0, 0.44, 1.52, "earth", -1.5, 1.5)
            assert (r.heading, r.pitch, r.roll, r.depth, r.temp, r.pressure, r.error_status) == (n * 37 % 36000 / 100, -12.34, 5.67, 12.3, 15.2, (10_000 + n) / 1000, 7)
            v = w[3 + p]
            if v is None:
                assert r.vel is None
                continue
            assert r.vel == [[None if x == -32768 else x / 1000 for x in c] for c in v.tolist()]
            assert p == 1 or (len(r.corr) == len(r.amp) == len(r.good) == len(v) and r.status is None)
        assert sum(r.damaged for r in rows if r.file.endswith(f"f{i}.pd0")) >= 2
    some = spark.read.format("pd0").schema("number long, vel array<array<double>>").option("splitBytes", split).load(str(tmp_path / "f1.pd0"))
    assert sorted(r.number for r in some.collect() if r.number is not None) == sorted(w[1] for w in both[1][1] for _ in range(2 if w[4] is not None else 1))
    cell = pulse.by_cell(table, "file", "pos", "profile").where("profile = 0")
    assert cell.count() == sum(len(w[3]) for _, want in both for w in want if w[3] is not None)


def test_other_blocks(spark, tmp_path):
    rng = np.random.default_rng(4)
    bottom = bytes(14) + struct.pack("<4H4h", 1000, 2000, 3000, 4000, -5, 6, 7, 8) + bytes(range(12)) + bytes(33) + bytes([1, 0, 0, 2]) + bytes(8)
    nav = bytes([15, 6]) + struct.pack("<HIiiiIii", 2023, 0, -250, 0, 0, 36_000_125 * 10, 2**29, -(2**30)) + struct.pack("<HHHHH", 1500, 2**14, 0, 250, 2**13) + bytes(18) + struct.pack("<HHH", 2**12, 2**11, 2**15) + bytes(10)
    five = [(0x0F01, struct.pack("<HHHH", 2, 1, 25, 60) + bytes(20) + struct.pack("<H", 125) + bytes(8)), (0x0A00, struct.pack("<2h", -7, 9)), (0x0B00, b"\x01\x02"), (0x0C00, b"\x03\x04"), (0x0D00, b"\x05\x06")]
    base = lambda clock: [(0, fixed(rng, 1)), (0x80, variable(rng, 1, clock))]
    data = ensemble([*base((24, 2, 29, 1, 2, 3, 4)), (0x600, bottom), (0x2000, nav), (0x4100, struct.pack("<BBIB", 9, 8, 7654, 3)), *five]) + ensemble(base((23, 2, 29, 0, 0, 0, 0)))
    (tmp_path / "x.pd0").write_bytes(data)
    spark.dataSource.register(pulse.PulseProfiles)
    r, bad_time = spark.read.format("pd0").load(str(tmp_path)).selectExpr("*", "cast(cast(time_gps as timestamp_ntz) as string) as gps", "unix_micros(time_b5) - unix_micros(time) as later").orderBy("pos").collect()
    assert r.dist_bt == [10.0 + 655.36, 20.0, 30.0, 40.0 + 2 * 655.36] and r.vel_bt == [-0.005, 0.006, 0.007, 0.008] and r.good_bt == [8, 9, 10, 11]
    assert r.gps == "2023-06-15 10:00:00.125" and (r.clock_offset, r.latitude, r.longitude) == (-0.25, 45.0, -90.0)
    assert (r.speed_over_ground, r.direction_over_ground, r.speed_made_good, r.direction_made_good, r.pitch_gps, r.roll_gps, r.heading_gps) == (1.5, 90.0, 0.25, 45.0, 22.5, 11.25, 180.0)
    assert (r.alt_eval, r.alt_rssi, r.alt_dist, r.alt_status) == (9, 8, 7.654, 3)
    assert (r.vel_b5, r.corr_b5, r.amp_b5, r.good_b5, r.cell_size_b5, r.bin1_b5, r.later) == ([-0.007, 0.009], [1, 2], [3, 4], [5, 6], 0.25, 0.6, 125_000)
    assert bad_time.time is None and bad_time.number == 1
