"""Model grids and labelled tables in long form: time steps, layers, points, directional buoy data, unpivoting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(table: DataFrame, key: str, value: str, wanted: float) -> DataFrame:
    """The row of least distance of value to `wanted`, ties to the smaller key: one row, by one aggregation."""
    row = F.struct(F.abs(F.col(value) - wanted).alias("_d"), F.col(key).alias(key), *[F.col(c) for c in table.columns if c != key])
    return table.where(F.col(value).isNotNull()).agg(F.min(row).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in table.columns])


def layer_depth(sigma: Column, bottom: Column, level: Column) -> Column:
    """Depth below the surface of a layer at a share sigma (0 at the surface, -1 at the bed) of the water column."""
    return -sigma * (bottom + level)


def points(spark, x: list[float], y: list[float], depth: list[float]) -> DataFrame:
    """x, y, waterdepth: if all three are lists of several values, x and y go together at every depth; else all combine."""
    of = lambda v, n: spark.createDataFrame([(float(a),) for a in v], f"{n} double")
    if min(len(v) for v in (x, y, depth)) > 1:
        flat = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    else:
        flat = of(x, "x").crossJoin(of(y, "y"))
    return flat.crossJoin(of(depth, "waterdepth"))


def within(df: DataFrame, **limits: tuple[float | None, float | None]) -> DataFrame:
    """Rows whose columns lie strictly within limits."""
    for c, (low, high) in limits.items():
        if low is not None:
            df = df.where(F.col(c) > low)
        if high is not None:
            df = df.where(F.col(c) < high)
    return df


#: The most rows of data that are put into one list.
LIST = 1 << 8


def to_nearest_points(data: DataFrame, wanted: DataFrame, axes: list[str], reach: float) -> DataFrame:
    """wanted with the columns of the nearest row of data within `reach` on every axis, null if there is none.

    Both sides meet by cells of width reach, data in its neighbours' cells too, as lists of about LIST rows: a row of wanted
    looks through a list where it meets it and keeps the nearest of it, so that no pairs are sorted or shuffled.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    others, at, own = [c for c in data.columns if c not in axes], [f"_c{i}" for i in range(len(axes))], [f"_k{i}" for i in range(len(axes))]
    row = F.struct(*[F.col(c).alias(f"a{i}") for i, c in enumerate(axes)], F.struct(*others).alias("v")).alias("_row")
    d = data.select(row, *[cell(c).alias(k) for c, k in zip(axes, at, strict=True)])
    for k in at:
        d = d.withColumn(k, F.explode(F.array(*[F.col(k) + n for n in (-1, 0, 1)])))
    counts = d.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("_parts"))
    d = d.withColumn("_part", F.monotonically_increasing_id()).join(counts, at).withColumn("_part", F.col("_part") % F.col("_parts"))
    d = d.groupBy(*at, "_part").agg(F.collect_list("_row").alias("_rows")).drop("_part")
    w = wanted.withColumn("_id", F.monotonically_increasing_id()).withColumns({k: cell(c) for c, k in zip(axes, own, strict=True)})
    both = w.join(d, reduce(lambda a, b: a & b, [F.col(a) == F.col(b) for a, b in zip(own, at, strict=True)]), "left")

    def place(p: Column) -> Column:
        far = reduce(lambda a, b: a + b, [(F.col(c) - p[f"a{i}"]) ** 2 for i, c in enumerate(axes)])
        near = reduce(lambda a, b: a & b, [F.abs(F.col(c) - p[f"a{i}"]) <= reach for i, c in enumerate(axes)])
        return F.when(near, F.struct(far.alias("far"), *[p[f"a{i}"].alias(f"a{i}") for i in range(len(axes))]))

    places = F.transform("_rows", lambda p, i: F.struct(place(p).alias("o"), i.alias("i")))
    nearest_ = both.select("_id", *wanted.columns, "_rows", F.array_min(F.filter(places, lambda q: q["o"].isNotNull())).alias("_n"))
    listed = nearest_.select("_id", *wanted.columns, F.col("_n.o").alias("_o"), F.get("_rows", F.col("_n.i"))["v"].alias("_v"))
    best = listed.groupBy("_id", *wanted.columns).agg(F.min_by("_v", "_o").alias("_b"))
    return best.select(*wanted.columns, *[F.col(f"_b.{c}").alias(c) for c in others])


def long_form(df: DataFrame, keys: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """keys, variable, value: a row per key and other column."""
    others = [c for c in df.columns if c not in keys]
    return df.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`").cast("double").alias(c) for c in others], variable, value) if others else df


def directional(density: DataFrame, alpha1: DataFrame, alpha2: DataFrame, r1: DataFrame, r2: DataFrame, time: str = "time") -> DataFrame:
    """time, frequency, swden, swdir, swdir2, swr1, swr2: five wide tables of a buoy, one column per frequency, by time
    and frequency; r1 and r2 come in hundredths."""
    parts = []
    for name, table in zip(("swden", "swdir", "swdir2", "swr1", "swr2"), (density, alpha1, alpha2, r1, r2)):
        t = long_form(table, [time], "frequency", name).withColumn("frequency", F.col("frequency").cast("double"))
        parts.append(t.withColumn(name, F.col(name) / 100) if name in ("swr1", "swr2") else t)
    return reduce(lambda a, b: a.join(b, [time, "frequency"]), parts)
