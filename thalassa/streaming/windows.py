"""Tumbling windows over event time with a watermark: statistics, sound levels and quality counts of streams.

Each is one stateful aggregation by window and series; state is dropped when the watermark passes a window's end. Missing
values are null or NaN and take no part. Rows later than `late` are left out, as Structured Streaming does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalassa.operators.series import known


def _windowed(df: DataFrame, by: list[str], ts: str, length: str, late: str):
    return df.withWatermark(ts, late).groupBy(F.window(ts, length), *by)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), *[c for c in df.columns if c != "window"])


def block_statistics(df: DataFrame, by: list[str], ts: str, x: str, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """begin, end, by, n, mean, least, most, std (sample) per window and series."""
    v = known(x)
    return _flat(_windowed(df, by, ts, length, late).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("std")))


def levels(df: DataFrame, by: list[str], ts: str, level: str, length: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """begin, end, by, average, total: levels (dB) of the mean and of the sum of the powers of a window."""
    power = F.pow(F.lit(10.0), known(level) / 10)
    return _flat(_windowed(df, by, ts, length, late).agg((10 * F.log10(F.avg(power))).alias("average"), (10 * F.log10(F.sum(power))).alias("total")))


def quality(df: DataFrame, by: list[str], ts: str, x: str, low: float, high: float, corrupt: list[float], length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """begin, end, by, n, missing, corrupt, outside: how many rows of a window fail which test."""
    v: Column = known(x)
    bad = v.isin(*corrupt)
    out = _windowed(df, by, ts, length, late).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(bad).alias("corrupt"), F.count_if(~bad & ((v < low) | (v > high))).alias("outside")
    )
    return _flat(out)
