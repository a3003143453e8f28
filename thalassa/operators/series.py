"""Time series in long form: one row per series (`by`), time and value.

Rows of one series and equal times are ordered by value, so that results do not depend on the partitioning. A null or
NaN value is missing. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalassa.functions.times import micros


def known(x: str | Column) -> Column:
    """x with NaN as null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x), x)


def _in_time(by: list[str], ts: str, x: str):
    return Window.partitionBy(*by).orderBy(ts, x)


def numbered_blocks(df: DataFrame, by: list[str], ts: str, x: str, step: int) -> DataFrame:
    """df with `block`: the number, from 0, of its run of `step` rows of the series; rows of a last, shorter run are dropped."""
    w = Window.partitionBy(*by)
    at = df.withColumn("_i", F.row_number().over(w.orderBy(ts, x)) - 1).withColumn("_all", F.count(F.lit(1)).over(w))
    return at.where(F.col("_i") < F.floor(F.col("_all") / step) * step).withColumn("block", F.floor(F.col("_i") / step).cast("long")).drop("_i", "_all")


def block_statistics(df: DataFrame, by: list[str], ts: str, x: str, step: int, circular: bool = False) -> DataFrame:
    """by, block, begin, mean, least, most, std of each full run of `step` rows; runs with a missing value are left out.

    std is the sample deviation. circular: x is an angle in degrees, mean and std are those of vector_statistics().
    """
    d = numbered_blocks(df.withColumn("_x", known(x)), by, ts, x, step)
    s, c = F.avg(F.sin(F.radians("_x"))), F.avg(F.cos(F.radians("_x")))
    mean, std = _vector(s, c) if circular else (F.avg("_x"), F.stddev_samp("_x"))
    out = d.groupBy(*by, "block").agg(F.min(ts).alias("begin"), mean.alias("mean"), F.min("_x").alias("least"), F.max("_x").alias("most"), std.alias("std"), F.count("_x").alias("_n"))
    return out.where(F.col("_n") == step).drop("_n")


def _vector(s: Column, c: Column) -> tuple[Column, Column]:
    """Mean direction and Yamartino's deviation from mean sine and cosine."""
    e = F.sqrt(F.greatest(1 - F.round(s * s + c * c, 8), F.lit(0.0)))
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), F.degrees(F.asin(e) * (1 + 0.1547 * F.pow(e, F.lit(3.0))))


def vector_statistics(df: DataFrame, by: list[str], degrees: str) -> DataFrame:
    """Mean direction and its spread by Yamartino's estimate."""
    r = F.radians(degrees)
    sums = df.groupBy(*by).agg(F.avg(F.sin(r)).alias("s"), F.avg(F.cos(r)).alias("c"))
    mean, std = _vector(F.col("s"), F.col("c"))
    return sums.select(*by, mean.alias("direction"), std.alias("spread"))


def upcrossings(df: DataFrame, by: list[str], ts: str, x: str) -> DataFrame:
    """df with `up`: whether the next value's sign is higher by 1 or 2 and that step passes or touches zero.

    A value of exactly zero gives a crossing before and one after it.
    """
    step = F.signum(F.lead(x).over(_in_time(by, ts, x))) - F.signum(x)
    return df.withColumn("up", F.coalesce(step.isin(1.0, 2.0), F.lit(False)))


def waves(df: DataFrame, by: list[str], ts: str, x: str) -> DataFrame:
    """by, wave, begin, period (s), n, peak, trough, height between upcrossings: from one up to before the next.

    What comes before the first and from the last crossing on is left out.
    """
    w = _in_time(by, ts, x)
    d = upcrossings(df, by, ts, x).withColumn("wave", F.sum(F.col("up").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("wave > 0")
    out = d.groupBy(*by, "wave").agg(F.min(ts).alias("begin"), F.count(F.lit(1)).alias("n"), F.max(x).alias("peak"), F.min(x).alias("trough"))
    after = F.lead("begin").over(Window.partitionBy(*by).orderBy("wave"))
    out = out.withColumn("period", (micros(after) - micros("begin")) / 1_000_000).where("period IS NOT NULL")
    return out.withColumn("height", F.col("peak") - F.col("trough"))


def custom_waves(df: DataFrame, by: list[str], ts: str, x: str, of) -> DataFrame:
    """by, wave, value: `of`, an aggregate Column, over the rows of each wave."""
    w = _in_time(by, ts, x)
    d = upcrossings(df, by, ts, x).withColumn("wave", F.sum(F.col("up").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("wave > 0")
    last = d.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("wave").alias("_last"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return d.join(last, on or F.lit(True)).where("wave < _last").groupBy(*by, "wave").agg(of.alias("value"))


def global_peaks(df: DataFrame, by: list[str], ts: str, x: str) -> DataFrame:
    """by, wave, time, peak: time (the first) and value of the highest point from each upcrossing on.

    The last one goes up to, not including, the last row of the series.
    """
    w = _in_time(by, ts, x)
    d = upcrossings(df, by, ts, x).withColumn("wave", F.sum(F.col("up").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_next", F.lead(ts).over(w)).where("wave > 0 AND _next IS NOT NULL")
    return d.groupBy(*by, "wave").agg(F.min_by(ts, F.struct(-F.col(x), F.col(ts))).alias("time"), F.max(x).alias("peak"))


def block_maxima(df: DataFrame, by: list[str], t: str, x: str, seconds: float) -> DataFrame:
    """by, block, peak: the highest x per block of `seconds` of t (seconds from 0); the block that t ends in is left out."""
    last = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.floor(F.max(t) / seconds).alias("_last"))
    d = df.withColumn("block", F.floor(F.col(t) / seconds).cast("long"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return d.join(last, on or F.lit(True)).where("block >= 0 AND block < _last").groupBy(*by, "block").agg(F.max(x).alias("peak"))


def bin_of(x: Column, edges: list[float]) -> Column:
    """The number, from 0, of the cell [a, b) of ascending edges that holds x; the last cell holds its end too, others null."""
    at = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        at = F.when((x >= lo) & ((x <= hi) if i == len(edges) - 2 else (x < hi)), i).otherwise(at)
    return at


def bin_statistics(df: DataFrame, against: str, edges: list[float], signals: list[str]) -> DataFrame:
    """bin, signal, mean, std (population) for every cell of the edges; cells without values have null."""
    long = df.select(bin_of(F.col(against), edges).alias("bin"), F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])).alias("v"))
    found = long.where("bin IS NOT NULL").groupBy(F.col("bin").alias("_b"), F.col("v.signal").alias("_s")).agg(F.avg("v.value").alias("mean"), F.stddev_pop("v.value").alias("std"))
    cells = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal"))
    return cells.join(found, (F.col("bin") == F.col("_b")) & (F.col("signal") == F.col("_s")), "left").select("bin", "signal", "mean", "std")


def fill_gaps(df: DataFrame, by: list[str], ts: str, x: str, max_gap: int | None = None, by_time: bool = True, extrapolate: bool = False) -> DataFrame:
    """df with `filled`: x, or the line between its known neighbours over time (or over row numbers) in gaps of up to max_gap rows.

    With extrapolate the ends take the nearest known value, within max_gap rows.
    """
    w = Window.partitionBy(*by).orderBy(ts)
    back, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    d = df.withColumn("_x", known(x)).withColumn("_i", F.row_number().over(w))
    t = (micros(ts) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts)) if by_time else F.col("_i")
    at, row = F.when(F.col("_x").isNotNull(), t), F.when(F.col("_x").isNotNull(), F.col("_i"))
    t0, t1, i0, i1 = F.last(at, True).over(back), F.first(at, True).over(on), F.last(row, True).over(back), F.first(row, True).over(on)
    v0, v1 = F.last("_x", True).over(back), F.first("_x", True).over(on)
    line = v0 + (v1 - v0) * (t - t0) / F.nullif(t1 - t0, F.lit(0))
    near = F.lit(True) if max_gap is None else i1 - i0 <= max_gap + 1
    filled = F.coalesce(F.col("_x"), F.when(near, line))
    if extrapolate:
        start = F.lit(True) if max_gap is None else i1 - 1 <= max_gap
        end = F.lit(True) if max_gap is None else F.count(F.lit(1)).over(Window.partitionBy(*by)) - i0 <= max_gap
        filled = F.coalesce(filled, F.when(i0.isNull() & start, v1), F.when(i1.isNull() & end, v0))
    return d.withColumn("filled", filled).drop("_x", "_i")


def fill_with_mean(df: DataFrame, by: list[str], ts: str, x: str, rows: int) -> DataFrame:
    """df with `filled`: x, or the mean of the known values of its run of `rows` rows; the last run may be shorter."""
    d = df.withColumn("_b", F.floor((F.row_number().over(_in_time(by, ts, x)) - 1) / rows))
    return d.withColumn("filled", F.coalesce(known(x), F.avg(known(x)).over(Window.partitionBy(*by, "_b")))).drop("_b")


def spikes(df: DataFrame, by: list[str], ts: str, x: str, threshold: float) -> DataFrame:
    """df with `spike`: differs by more than threshold from the value before; the first value is compared with 0."""
    before = F.lag(x, 1, 0.0).over(_in_time(by, ts, x))
    return df.withColumn("spike", F.coalesce(F.abs(F.col(x) - before) > threshold, F.lit(False)))


def outside(x: Column, low: float, high: float) -> Column:
    return (x < low) | (x > high)


def segments(df: DataFrame, by: list[str], ts: str, flag: str, least: int = 0) -> DataFrame:
    """by, begin, end, n: the runs of rows where flag holds, of `least` rows or more."""
    w = Window.partitionBy(*by).orderBy(ts)
    d = df.withColumn("_n", F.row_number().over(w)).where(F.col(flag))
    d = d.withColumn("_g", F.col("_n") - F.row_number().over(w))
    return d.groupBy(*by, "_g").agg(F.min(ts).alias("begin"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_g")


def quality_mask(df: DataFrame, x: str, low: float, high: float, corrupt: list[float]) -> DataFrame:
    """df with `ok`: not missing, not a corrupt value, within [low, high]."""
    return df.withColumn("ok", F.coalesce(F.col(x).between(low, high) & ~F.col(x).isin(*corrupt) & ~F.isnan(x), F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, x: str) -> DataFrame:
    """left with the last x of right at or before each ts of the same series: a union and one window, no range join."""
    both = left.select(*by, ts, *[c for c in left.columns if c not in (*by, ts)], F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_x"))
    both = both.unionByName(right.select(*by, ts, F.lit(0).alias("_side"), F.col(x).cast("double").alias("_x")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(x, F.last("_x", True).over(w)).where("_side = 1").drop("_side", "_x")


def interpolated(left: DataFrame, right: DataFrame, by: list[str], ts: str, x: str) -> DataFrame:
    """left with x of right on the line between its neighbours in time, of the same series; null beyond the ends."""
    both = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_x"))
    both = both.unionByName(right.select(*by, ts, F.lit(0).alias("_side"), F.col(x).cast("double").alias("_x")), allowMissingColumns=True)
    both = both.withColumn("_at", F.when(F.col("_x").isNotNull(), micros(ts)))
    w = Window.partitionBy(*by)
    back, on = w.orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0), w.orderBy(ts, F.desc("_side")).rowsBetween(0, Window.unboundedFollowing)
    t0, v0, t1, v1 = F.last("_at", True).over(back), F.last("_x", True).over(back), F.first("_at", True).over(on), F.first("_x", True).over(on)
    line = F.when(t0 == t1, v0).otherwise(v0 + (v1 - v0) * (micros(ts) - t0) / (t1 - t0))
    return both.withColumn(x, line).where("_side = 1").drop("_side", "_x", "_at")


def average_db(level: str) -> Column:
    """The level of the mean power."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col(level) / 10)))


def total_db(level: str) -> Column:
    return 10 * F.log10(F.sum(F.pow(F.lit(10.0), F.col(level) / 10)))
