import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalassa.sources import audio, text


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_buoy_tables(spark, tmp_path):
    p = put(tmp_path / "46022w2020.txt", "#YY  MM DD hh mm   .0200   .0325 WTMP\n#yr  mo dy hr mn  m2/Hz m2/Hz degC\n2020 01 02 03 40   1.50   999.0  MM\n2020 01 02 04 40   0.25   2.00  11.5\n")
    d, units = text.read_buoy(spark, p)
    assert units == {".0200": "m2/Hz", ".0325": "m2/Hz", "WTMP": "degC"}
    rows = d.orderBy("time").collect()
    assert [tuple(r) for r in rows] == [(datetime(2020, 1, 2, 3, 40), 1.5, None, None), (datetime(2020, 1, 2, 4, 40), 0.25, 2.0, 11.5)]
    s = text.spectra_of(d).orderBy("time").collect()
    assert s[1].f == [0.02, 0.0325] and s[1].s == [0.25, 2.0]
    q = put(tmp_path / "old.txt", "YY MM DD hh WVHT\n98 12 31 23 1.0\n05 1 2 3 99.0\n")
    d, units = text.read_buoy(spark, q)
    assert units is None and sorted((r.time, r.WVHT) for r in d.collect()) == [(datetime(1998, 12, 31, 23), 1.0), (datetime(2005, 1, 2, 3), None)]


def test_moored_lines(spark, tmp_path):
    p = put(tmp_path / "line.out", "Time Node0x Node0y Node0z Node1x Node1y Node1z Node2x Node2y Node2z\n (s) (m) (m) (m) (m) (m) (m) (m) (m) (m)\n0.0 0 0 -50 3 4 -49.9 9 9 -20\n0.1 0 0 -50 6 8 -49.9 9 9 -21\n")
    d = text.read_moored(spark, p)
    assert {r.Time: r.length for r in text.lay_length(d, "Time", -50).collect()} == {0.0: 5.0, 0.1: 10.0}


def test_wave_model_files(spark, tmp_path):
    head = "%\n%\n% Run:30 Table:T1 SWAN version:41\n%\n% Xp Yp Hsig\n% [m] [m] [m]\n"
    d, meta = text.read_wave_table(spark, put(tmp_path / "t.tab", head + "1.0 2.0 0.5\n3.0 4.0 *\n"))
    assert meta["header"] == ["Xp", "Yp", "Hsig"] and meta["units"] == ["m", "m", "m"] and meta["Run"] == "30"
    assert sorted(map(tuple, d.collect())) == [(1.0, 2.0, 0.5), (3.0, 4.0, None)]
    block = "% Run:1 Frame:F ** Significant height, Unit: .1000E+01 m\n%\n%\n%\n%\n%     0  1  2\n   0  5. 6. ****\n   1  7. 8. 9.\n"
    b = text.read_wave_blocks(spark, put(tmp_path / "b.txt", block))
    assert {(r.y, r.x): r.value for r in b.collect()} == {(0, 0): 0.5 * 10, (0, 1): 6.0, (0, 2): None, (1, 0): 7.0, (1, 1): 8.0, (1, 2): 9.0}
    assert text.blocks_to_table(b).count() == 6


def test_gages(spark, tmp_path):
    series = lambda name, values: {"variable": {"variableDescription": name}, "values": [{"value": [{"value": v, "dateTime": t, "qualifiers": ["P"]} for t, v in values]}]}
    p = put(tmp_path / "g.json", json.dumps({"value": {"timeSeries": [series("Q", [("2019-01-01T00:00:00.000Z", "1.5"), ("2019-01-02T00:00:00.000Z", "x")]), series("h", [("2019-01-01T00:00:00.000Z", "7")])]}}))
    d = text.read_gage(spark, p)
    assert sorted((r.time.day, r.variable, r.value) for r in d.collect() if r.value is not None) == [(1, "Q", 1.5), (1, "h", 7.0)]
    wide = text.combine_first(d, "time", "variable", "value").collect()
    assert [(r.Q, r.h) for r in wide] == [(1.5, 7.0)]


def test_tide_stations(spark, tmp_path):
    xml = '<data><metadata id="9"/><observations><wl t="2020-01-01 00:06" v="0.5" s="x"/><wl t="2020-01-01 00:06" v="0.5" s="x"/><wl t="1577837160000" v="0.7" s=""/></observations></data>'
    d = text.read_station_xml(spark, put(tmp_path / "a.xml", xml))
    got = sorted((r.time, r.value) for r in d.where("name = 'v'").collect())
    assert got == [(datetime(2020, 1, 1, 0, 6), 0.5), (datetime(2020, 1, 1, 0, 6), 0.7)]
    by_column = text.read_station_json(spark, put(tmp_path / "c.json", json.dumps({"metadata": {"id": 9}, "v": {"1577836800000": 1.5}})))
    by_row = text.read_station_json(spark, put(tmp_path / "r.json", json.dumps({"columns": ["v"], "index": ["2020-01-01 00:00"], "data": [[1.5]]})))
    assert [tuple(r) for r in by_column.collect()] == [tuple(r) for r in by_row.collect()] == [(datetime(2020, 1, 1), "v", 1.5)]


def test_date_ranges(spark):
    r = spark.range(1).select(text.date_ranges(F.lit("2020-01-01").cast("date"), F.lit("2020-03-05").cast("date")).alias("d")).first().d
    assert [(str(x.begin), str(x.end)) for x in r] == [("2020-01-01", "2020-01-31"), ("2020-01-31", "2020-03-01"), ("2020-03-01", "2020-03-05")]


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav(spark, tmp_path, bits):
    x = np.array([0, 1000, -1000, 2 ** (bits - 1) - 1, -(2 ** (bits - 1))])
    size = bits // 8
    body = b"".join(int(v).to_bytes(size, "little", signed=True) for v in x)
    import struct

    wav = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 48000, 48000 * size, size, bits) + b"data" + struct.pack("<I", len(body)) + body
    p = put(tmp_path / "6247.230204150508.wav", wav)
    d = audio.read_hydrophone(spark, p, 2.5)
    rows = d.orderBy("i").collect()
    scale = 2**8 if bits == 24 else 1
    assert np.allclose([r.volt for r in rows], x * scale / audio.full_scale(bits) * 2.5) and rows[0].rate == 48000
    t = d.select(audio.sample_time(audio.start_in_name(F.col("path"))).alias("t"), "i").orderBy("i").collect()
    assert t[0].t == datetime(2023, 2, 4, 15, 5, 8) and (t[4].t - t[0].t).microseconds == round(4e6 / 48000)


def test_raw_recorder_and_wav_round_trip(spark, tmp_path):
    head = b"% WISPR 2.0\r\ntime = '02:04:23:15:05:08';\nsample_size = 2;\nsampling_rate = 100;\nadc_vref = 5;\n"
    d = audio.read_raw(spark, put(tmp_path / "w.dat", head.ljust(512, b"\0") + np.array([0, 16384, -16384], "<i2").tobytes()))
    assert [r.volt for r in d.orderBy("i").collect()] == [0, 2.5, -2.5]
    f = audio.wav_files(d, ["path"], "i", "volt", 100, peak=5).first().content
    rate, bits, counts = audio.decode_wav(bytes(f))
    assert (rate, bits) == (100, 16) and np.allclose(counts / 32767, [0, 0.5, -0.5], atol=1e-4)


def test_coalesced_and_without_repeats(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0)], "k int, x double, y double")
    b = spark.createDataFrame([(2, 9.0, "q"), (3, 8.0, "r")], "k int, x double, z string")
    got = sorted(map(tuple, text.coalesced(a, b, "k").collect()))
    assert got == [(1, 1.0, None, None), (2, 9.0, 5.0, "q"), (3, 8.0, None, "r")]
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, text.without_repeats(d, ["k"], ["v"]).collect())) == [(1, "a"), (2, "c")]
