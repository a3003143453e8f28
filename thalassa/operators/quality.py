"""Quality control of time series: each test adds a boolean column, true where the row passes.

Rows are of one series (`by`) each. What the tests of the reference packages leave open is set here: duplicates keep the
first by value, a stagnant window fails at its last row, and outliers are told by deviations from a moving mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalassa.functions.times import micros

from .series import known


def check_timestamp(df: DataFrame, by: list[str], ts: str, seconds: float) -> DataFrame:
    """df in time order without repeated times, with `ok`: the row before is `seconds` earlier (the first row passes)."""
    first = Window.partitionBy(*by, ts).orderBy(*[c for c in df.columns if c not in (*by, ts)] or [ts])
    d = df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    gap = micros(ts) - F.lag(micros(ts)).over(Window.partitionBy(*by).orderBy(ts))
    return d.withColumn("ok", F.coalesce(F.abs(gap - seconds * 1e6) < 500, F.lit(True)))


def missing_timestamps(df: DataFrame, by: list[str], ts: str, seconds: int) -> DataFrame:
    """by, ts of the times of an even grid from a series' first to its last time that it lacks."""
    span = df.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = span.select(*by, F.explode(F.sequence("_a", "_b", F.make_dt_interval(secs=F.lit(seconds)))).alias(ts))
    return grid.join(df.select(*by, ts).distinct(), [*by, ts], "left_anti")


def check_missing(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("ok", known(x).isNotNull())


def check_corrupt(df: DataFrame, x: str, values: list[float]) -> DataFrame:
    return df.withColumn("ok", ~F.coalesce(F.col(x).isin(*values), F.lit(False)))


def check_range(df: DataFrame, x: str, low: float | None, high: float | None) -> DataFrame:
    """Missing values pass: they are the business of check_missing."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (known(x) < low)
    if high is not None:
        bad = bad | (known(x) > high)
    return df.withColumn("ok", ~F.coalesce(bad, F.lit(False)))


def check_delta(df: DataFrame, by: list[str], ts: str, x: str, low: float | None, high: float | None, seconds: int) -> DataFrame:
    """Fails where the highest less the lowest value of the last `seconds` is below low or above high."""
    w = Window.partitionBy(*by).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    d = F.max(known(x)).over(w) - F.min(known(x)).over(w)
    bad = F.lit(False)
    if low is not None:
        whole = micros(ts) - F.min(micros(ts)).over(Window.partitionBy(*by)) >= seconds * 1_000_000
        bad = bad | (whole & (d < low))
    if high is not None:
        bad = bad | (d > high)
    return df.withColumn("ok", ~F.coalesce(bad, F.lit(False)))


def check_outlier(df: DataFrame, by: list[str], ts: str, x: str, most: float, seconds: int | None = None) -> DataFrame:
    """Fails where a value is more than `most` deviations off the mean of the last `seconds`, or of the whole series."""
    w = Window.partitionBy(*by) if seconds is None else Window.partitionBy(*by).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    off = F.abs(known(x) - F.avg(known(x)).over(w)) / F.nullif(F.stddev_pop(known(x)).over(w), F.lit(0.0))
    return df.withColumn("ok", F.coalesce(off <= most, F.lit(True)))


def cleaned(df: DataFrame, x: str, ok: str = "ok") -> DataFrame:
    """df with x null where it fails."""
    return df.withColumn(x, F.when(F.col(ok), F.col(x)))
