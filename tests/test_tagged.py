"""Files of tagged records against a plain sequential decode."""

import datetime as dt
import struct

import numpy as np
import pytest

from test_frames import sequential

from thalassa.sources import frames, tagged


def check(b):
    words = struct.unpack(f"<{len(b) // 2}H", b[: len(b) // 2 * 2])
    return (0xB58C + sum(words) + (b[-1] * 256 if len(b) % 2 else 0)) % 65536


def record(kind, body, long=False):
    head = struct.pack("<BBBBIH", 0xA5, 12, kind, 0x10, len(body), check(body)) if long else struct.pack("<BBBBHH", 0xA5, 10, kind, 0x10, len(body), check(body))
    return head + struct.pack("<H", check(head)) + body


def common(rng, number, bits, beams_cells, bottom=False):
    t = dt.datetime(2022, 1 + number % 12, 1 + number % 28, number % 24, number % 60, number % 59, (number * 37 % 10_000) * 100)
    b = struct.pack("<BBHI6BH", 3, 78 if bottom else 76, bits, 4321, t.year - 1900, t.month - 1, t.day, t.hour, t.minute, t.second, t.microsecond // 100)
    b += struct.pack("<HhIHhhHHHBb", 15_000, 1234, 10_500 + number, number * 91 % 36_000, -321, 45, beams_cells, 500, 60, 70, 30)
    b += struct.pack("<H3h3h", 152, 10, -20, 30, 16384, 0, -8192)
    described = 1 | 2 << 4 | 3 << 8 | 4 << 12
    if bottom:
        return b + struct.pack("<IHHbbhhIII", 2500, described, 7, -3, -2, 5, 2500, 9, 11, number), t
    return b + struct.pack("<hHHbbhhHHII", 2500, described, 7, -3, -2, 5, 2500, 9, 0, 1 << 25 | 3, number), t


def file(rng, n):
    """(bytes, records as (place, id, number, time, values))."""
    out, want = rng.bytes(9).replace(b"\xa5", b"\x00"), []
    for i in range(n):
        kind = (21, 22, 24, 23, 28, 26, 160, 99)[i % 8]
        beams, cells = (1, 7) if kind == 24 else (4, 3 + i % 2)
        if kind == 160:
            body, t, v = b"\x10GETINST" + b"," * (i % 3) + b"\x00", None, None
        elif kind == 99:
            body, t, v = rng.bytes(30 + i % 2), None, None
        elif kind == 23:
            head, t = common(rng, i, 1 << 5 | 1 << 8 | 1 << 9 | 1 << 10, 4 << 12, True)
            v = rng.integers(-9999, 9999, 8)
            body = head + v.astype("<i4").tobytes() + np.arange(4).astype("<u2").tobytes() + np.arange(16).astype("<f4").tobytes()
        elif kind == 28:
            head, t = common(rng, i, 1 << 11, 11)
            v = rng.integers(0, 9999, 11)
            body = head + v.astype("<u2").tobytes()
        elif kind == 26:
            head, t = common(rng, i, 1 << 8 | 1 << 9 | 1 << 10, 0)
            v = rng.integers(-9999, 9999, 5)
            body = head + struct.pack("<fHH", 12.5, 345, 0b1010001101) + struct.pack("<fHhf8x", 13.5, 456, -25, 9.75) + struct.pack("<IH", 5, 240) + v.astype("<i2").tobytes()
        else:
            head, t = common(rng, i, 1 << 5 | 1 << 6 | 1 << 7 | 1 << 12 | 1 << 13 | 1 << 14, cells | (2 << 10) | beams << 12)
            v = rng.integers(-9999, 9999, (beams, cells))
            amp, corr = rng.integers(0, 200, (2, beams, cells)).astype(np.uint8)
            body = head + v.astype("<i2").tobytes() + amp.tobytes() + corr.tobytes() + np.arange(16).astype("<f4").tobytes() + bytes(range(cells)) + struct.pack("<4h22x", 1, 2, 3, 4)
            v = (v, amp, corr)
        r = record(kind, body, i % 5 == 0)
        if i % 17 == 16:
            r = r[:-1] + bytes([r[-1] ^ 1])
        elif i % 19 == 18:
            r = r[:-7]
        else:
            want.append((len(out), kind, i, t, v))
        out += r
        if i % 6 == 5:
            out += rng.bytes(int(rng.integers(1, 90))).replace(b"\xa5", b"\x01")
    return out + record(22, b"x" * 50)[:20], want


@pytest.mark.parametrize("step", [200, 5000, 1 << 30])
def test_records_do_not_depend_on_ranges(step):
    data, want = file(np.random.default_rng(0), 120)
    got, bad = [], []
    for lo in range(0, len(data), step):
        _, begin, at, size, damaged = frames.records(tagged.Tagged(), lambda a, n: data[a : a + n], len(data), lo, min(len(data), lo + step))
        got += [(int(a) + begin, int(s)) for a, s in zip(at, size)]
        bad += damaged.tolist()
    assert got == sequential(data, tagged.Tagged()) and [p for p, _ in got] == [w[0] for w in want]
    assert len(bad) == 120 - len(want) + 1


@pytest.mark.parametrize("split", [3000, 1 << 26])
def test_tagged_files(spark, tmp_path, split):
    data, want = file(np.random.default_rng(1), 160)
    (tmp_path / "a.ad2cp").write_bytes(data)
    (tmp_path / "b.ad2cp").write_bytes(b"")
    spark.dataSource.register(tagged.TaggedRecords)
    table = spark.read.format("ad2cp").option("splitBytes", split).load(f"{tmp_path}/*.ad2cp")
    rows = table.selectExpr("*", "cast(cast(time as timestamp_ntz) as string) as at").orderBy("pos").collect()
    good = [r for r in rows if not r.damaged]
    assert [(r.pos, r.id) for r in good] == [(w[0], w[1]) for w in want] and sum(r.damaged for r in rows) == 160 - len(want) + 1
    for r, (_, kind, i, t, v) in zip(good, want):
        assert r.kind == tagged.KINDS.get(kind, "other")
        if kind == 160:
            assert (r.text_id, r.text.rstrip(",")) == (16, "GETINST")
        if t is None:
            assert r.time is None
            continue
        assert r.ensemble == i and dt.datetime.fromisoformat(r.at) == t
        assert (r.serial, r.c_sound, r.temp, r.pressure, r.heading, r.pitch, r.roll) == (4321, 1500.0, 12.34, (10_500 + i) / 1000, i * 91 % 36_000 / 100, -3.21, 0.45)
        assert (r.cell_size, r.blank, r.battery, r.ambiguity_velocity, r.beams, r.power, r.temp_clock, r.error) == (0.5, 0.06 if kind == 28 else 0.6, 15.2, 2.5, [1, 2, 3, 4], -2.0, 25.0, 9)
        assert r.accel == pytest.approx([9.81, 0, -4.905]) and r.mag == pytest.approx([10, -20, 30] if kind == 23 else [1, -2, 3])
        if kind in (21, 22, 24):
            vel, amp, corr = v
            assert np.allclose(r.vel, vel.T / 1000) and np.array_equal(r.amp, amp.T / 2) and np.array_equal(r.corr, corr.T)
            assert r.good == list(range(vel.shape[1])) and (r.pitch_std, r.roll_std, r.heading_std, r.pressure_std) == (0.01, 0.02, 0.03, 0.4)
            assert r.quaternions == [9.0, 10.0, 11.0, 12.0] and r.angular_rate == pytest.approx(np.radians([13, 14, 15])) and r.coord_sys == "beam" and r.temp_pressure == pytest.approx(2)
        elif kind == 23:
            assert np.allclose(r.vel_bt, v[:4] / 1000) and r.dist_bt == [x / 1000 for x in v[4:].tolist()] and r.fom_bt == [0, 1, 2, 3] and r.orientation_matrix == [float(x) for x in range(9)]
        elif kind == 28:
            assert r.echo == [x / 100 for x in v.tolist()] and r.n_cells == 11
        else:
            assert (r.alt_dist, r.alt_quality, r.ast_dist, r.ast_quality, r.ast_offset, r.ast_pressure, r.alt_spacing) == (12.5, 3.45, 13.5, 4.56, -0.0025, 9.75, 0.024) and r.alt_samples == [x / 256 for x in v.tolist()]
    burst, average = tagged.profiles(table)
    assert {r.kind for r in average.select("kind").distinct().collect()} == {"average"} and burst.count() == sum(w[1] in (21, 23, 24, 26, 28) for w in want)
    index = spark.read.format("ad2cp").schema(tagged.INDEX).option("splitBytes", split).load(str(tmp_path / "a.ad2cp")).where("NOT damaged").orderBy("pos").collect()
    assert [(r.pos, r.id, r.ensemble) for r in index] == [(w[0], w[1], w[2] if w[3] else None) for w in want]
    bits = tagged.status_bits(table["status"])
    assert table.where("kind = 'burst' AND NOT damaged").select(bits["orientation"], bits["blank_in_cm"], bits["low_volt_skip"]).distinct().collect() == [(1, True, False)]
    alt = tagged.altimeter_bits(table["alt_status"])
    assert table.where("kind = 'burst_raw_altimeter' AND NOT damaged").select(*[alt[k] for k in ("tilt_over_5deg", "tilt_over_10deg", "multibeam", "n_beams", "power_level")]).distinct().collect() == [(True, False, True, 1, "med-high" if 0b1010001101 >> 7 & 3 == 1 else "high")]


def test_rows_are_records():
    rng = np.random.default_rng(2)
    for n in (20, 21):
        body = rng.integers(0, 256, (5, n)).astype(np.uint8)
        assert [r.tobytes() for r in tagged.record_rows(21, body)] == [record(21, b.tobytes()) for b in body]


def test_checksums_of_a_block_take_little_memory():
    """Words and their running sums have 16 bits; sums are right where they wrap and at odd places."""
    import tracemalloc

    import numpy as np

    data = np.random.default_rng(3).integers(0, 256, 4 << 20, dtype=np.uint8)
    at, size = np.array([0, 1001, 4000]), np.array([810, 1300, 4_000_000])
    data[at + 1] = 10
    for a, n in zip(at, size, strict=True):
        d = data[a + 10 : a + n].astype(np.int64)
        total = 0xB58C + d[0 : len(d) // 2 * 2 : 2].sum() + 256 * d[1::2].sum() + (256 * d[-1] if len(d) % 2 else 0)
        data[a + 6], data[a + 7] = total % 256, total // 256 % 256
    framing = tagged.Tagged()
    framing.longest = 4 << 20
    tracemalloc.start()
    good = framing.whole(data, at, size)
    assert tracemalloc.get_traced_memory()[1] < 24e6
    tracemalloc.stop()
    # the last record holds the others' checksum places within; its own sum was set last
    assert good.tolist() == [True, True, True]
