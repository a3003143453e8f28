"""Classic netCDF files written by hand and by write(), in slices of any size."""

import struct

import numpy as np
import pytest

from thalassa.sources import netcdf


def name(t):
    return struct.pack(">I", len(t)) + t.encode().ljust(-(-len(t) // 4) * 4, b"\0")


def attr(key, kind, values):
    raw = values.encode() if kind == 2 else np.array(values, netcdf.KINDS[kind]).tobytes()
    return name(key) + struct.pack(">II", kind, len(values)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")


def by_hand(version, records, fixed, streaming=False):
    """A file of dims time (records), x = 3, len = 5 with variables t, v (scaled shorts over x), flag (bytes), label (text), depth over x, one."""
    dims = [("time", 0), ("x", 3), ("len", 5)]
    v = [("t", [0], [], 6), ("v", [0, 1], [attr("_FillValue", 3, [-9]), attr("scale_factor", 6, [0.5]), attr("add_offset", 5, [10.0])], 3), ("flag", [0], [attr("missing_value", 1, [7])], 1), ("label", [0, 2], [attr("units", 2, "name")], 2), ("depth", [1], [], 5), ("one", [], [], 4)]
    sizes = {"t": 8, "v": 8, "flag": 4, "label": 8, "depth": 12, "one": 4}
    begin = lambda n: struct.pack(">I" if version == 1 else ">Q", n)

    def head(at):
        out = b"CDF" + bytes([version]) + struct.pack(">I", 0xFFFFFFFF if streaming else len(records))
        out += struct.pack(">II", 10, 3) + b"".join(name(d) + struct.pack(">I", n) for d, n in dims)
        out += struct.pack(">II", 12, 1) + attr("title", 2, "by hand")
        out += struct.pack(">II", 11, len(v))
        for key, ids, marks, kind in v:
            out += name(key) + struct.pack(">I", len(ids)) + b"".join(struct.pack(">I", i) for i in ids)
            out += (struct.pack(">II", 12, len(marks)) if marks else struct.pack(">II", 0, 0)) + b"".join(marks)
            out += struct.pack(">II", kind, sizes[key]) + begin(at.get(key, 0))
        return out

    n = len(head({}))
    at = {"depth": n, "one": n + 12, "t": n + 16, "v": n + 24, "flag": n + 32, "label": n + 36}
    body = np.array(fixed, ">f4").tobytes() + struct.pack(">i", 42)
    for t, x, flag, label in records:
        body += struct.pack(">d", t) + np.array(x, ">i2").tobytes().ljust(8, b"\0") + struct.pack(">bxxx", flag) + label.encode().ljust(8, b"\0")
    return head(at) + body


@pytest.mark.parametrize("version, streaming, split", [(1, False, 1), (2, False, 100), (2, True, 1 << 20)])
def test_records_and_fixed(spark, tmp_path, version, streaming, split):
    rng = np.random.default_rng(0)
    records = [(i / 4 if i % 5 else float("nan"), rng.integers(-10, 0, 3).tolist(), i % 9, "é" * (i % 3)) for i in range(40)]
    (tmp_path / "a.nc").write_bytes(by_hand(version, records, [1.0, 2.0, 3.5], streaming))
    (tmp_path / "b.nc").write_bytes(by_hand(version, [], [0, 0, 0]))
    spark.dataSource.register(netcdf.Classic)
    rows = spark.read.format("netcdf3").option("splitBytes", split).load(f"file://{tmp_path}/*.nc").orderBy("time_index").collect()
    assert [(r.time_index, r.t, r.flag, r.label) for r in rows] == [(i, None if np.isnan(t) else t, None if f == 7 else f, x) for i, (t, _, f, x) in enumerate(records)]
    assert [r.v for r in rows] == [[None if n == -9 else n * 0.5 + 10 for n in x] for _, x, _, _ in records]
    raw = spark.read.format("netcdf3").option("raw", "true").load(str(tmp_path / "a.nc")).select("v").limit(1).first()
    assert raw.v == [None if n == -9 else n for n in records[0][1]]
    depth = spark.read.format("netcdf3").option("dimension", "x").load(str(tmp_path / "a.nc")).orderBy("x_index").collect()
    assert [(r.x_index, r.depth) for r in depth] == [(0, 1.0), (1, 2.0), (2, 3.5)]
    h = netcdf.header(str(tmp_path / "a.nc"))
    assert h.attributes == {"title": "by hand"} and h.records == 40 and h.variables[3].attributes == {"units": "name"}
    some = spark.read.format("netcdf3").schema("t double, nothing int").load(str(tmp_path / "a.nc"))
    assert some.count() == 40 and some.where("nothing IS NULL").count() == 40


def test_one_variable_of_records_is_not_padded(spark, tmp_path):
    for kind, values in (("tinyint", range(-3, 10)), ("smallint", range(5))):
        folder = f"{tmp_path}/{kind}"
        netcdf.write(spark.createDataFrame([(v,) for v in values], f"b {kind}").coalesce(1), folder, "n")
        spark.dataSource.register(netcdf.Classic)
        assert [r.b for r in spark.read.format("netcdf3").option("splitBytes", 3).load(folder).orderBy("n_index").collect()] == list(values)


def test_round_trip(spark, tmp_path):
    rows = [(i, None if i % 4 == 0 else i / 8, [[float(i + j + k) if (i + j + k) % 5 else None for k in range(3)] for j in range(2)], i % 100) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, d double, a array<array<float>>, b tinyint").repartition(4)
    folder = f"file://{tmp_path}/out"
    names = netcdf.write(df, folder, "time", {"d": {"units": "m"}})
    assert len(names) == 4
    spark.dataSource.register(netcdf.Classic)
    got = spark.read.format("netcdf3").option("splitBytes", 1000).load(folder)
    assert sorted((r.i, r.d, r.a, r.b) for r in got.collect()) == sorted(rows)
    assert [r.n for r in got.groupBy("file").agg({"time_index": "max", "i": "count"}).selectExpr("`max(time_index)` + 1 - `count(i)` AS n").collect()] == [0] * 4
    assert netcdf.header(names[0]).variables[1].attributes["units"] == "m"
    with pytest.raises(Exception, match="unequal"):
        netcdf.write(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "a array<double>").coalesce(1), f"{tmp_path}/bad", "n")
    with pytest.raises(ValueError, match="not written"):
        netcdf.write(spark.createDataFrame([("x",)], "a string"), f"{tmp_path}/bad2", "n")
    assert netcdf.write(df.limit(0), f"{tmp_path}/none", "n") == []
