from datetime import datetime, timedelta

import pytest

from thalassa import streaming

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A folder of three files of rows, one a minute, with a gap, a NaN and a corrupt value."""
    folder = tmp_path_factory.mktemp("stream")
    for f in range(3):
        rows = [(T0 + timedelta(minutes=20 * f + i), "a" if i % 2 else "b", float("nan") if i == 7 else -999.0 if i == 9 else float(i)) for i in range(20)]
        spark.createDataFrame(rows, "ts timestamp, k string, x double").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return folder


def run(spark, files, of, name):
    source = spark.readStream.schema("ts timestamp, k string, x double").option("maxFilesPerTrigger", 1).parquet(str(files / "in"))
    q = of(source).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(files / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def key(r):
    return r.begin, r.k


def test_statistics_equal_those_of_the_stored_table(spark, files):
    of = lambda d: streaming.block_statistics(d, ["k"], "ts", "x")
    got = run(spark, files, of, "statistics").collect()
    want = of(spark.read.parquet(str(files / "in"))).collect()
    assert len(got) == 12 and sorted(got, key=key) == sorted(want, key=key)


def test_quality_and_levels(spark, files):
    q = run(spark, files, lambda d: streaming.quality(d, ["k"], "ts", "x", 0, 10, [-999.0]), "quality").collect()
    assert sum(r.n for r in q) == 60 and sum(r.missing for r in q) == 3 and sum(r.corrupt for r in q) == 3 and sum(r.outside for r in q) == 27
    v = run(spark, files, lambda d: streaming.levels(d.where("x > 0"), ["k"], "ts", "x", "1 hour"), "levels").collect()
    assert len(v) == 2 and all(r.total > r.average for r in v)
