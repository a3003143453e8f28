"""River and tidal flow: exceedance, rating curves, power, directions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalassa.sources.tables import stored

G = 9.80665


def froude_number(v: Column, h: Column, g: float = G) -> Column:
    return v / F.sqrt(g * h)


def exceedance_probability(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """df with f: 100 (n - rank + 1) / (n + 1) among all rows or those of the same `by`; ties share their average rank.

    Ranks come from the counts of distinct values: summed per value, then over ranges of values, so no task sees all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = by or []
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    # written, not only planned, as two scans have to see the same ranges
    ranged = counts.repartitionByRange(parts, *by, x).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged)
    totals = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_t"))
    over = Window.partitionBy(*by)
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_p").alias("_q"), (F.sum("_t").over(over.orderBy("_p")) - F.col("_t")).alias("_before"), F.sum("_t").over(over).alias("_all"))
    within = ranged.withColumn("_c", F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy(x)))
    on = [F.col("_p") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    ranks = within.join(totals, on)
    rank = F.col("_before") + F.col("_c") - (F.col("_n") - 1) / 2
    ranks = ranks.select(F.col(x).alias("_x"), *[F.col(c).alias(f"__{c}") for c in by], (100 * (F.col("_all") - rank + 1) / (F.col("_all") + 1)).alias("f"))
    on = [F.col(x) == F.col("_x"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]]
    return df.join(ranks, on, "left").drop("_x", *[f"__{c}" for c in by])


def linear_fit(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def velocity_to_power(v: Column, coefficients: list[float], cut_in: float, cut_out: float) -> Column:
    return F.when((v < cut_in) | (v > cut_out), 0.0).otherwise(polynomial(v, coefficients))


def circular(d: Column) -> tuple[Column, Column]:
    return d, math.pi / 4 * d * d


def rectangular(h: Column, w: Column) -> tuple[Column, Column]:
    return F.sqrt(4 * h * w / math.pi), h * w


def tip_speed_ratio(omega: Column, diameter: Column, v: Column) -> Column:
    return omega * math.pi * diameter / v


def power_coefficient(power: Column, v: Column, area: Column, rho: float) -> Column:
    return power / (0.5 * rho * area * v * v * v)


def joint_probability(df: DataFrame, direction: str, speed: str, width_dir: float, width_speed: float) -> DataFrame:
    """dir_bin, speed_bin, percent of all rows."""
    cells = df.groupBy(F.floor(F.pmod(F.col(direction), F.lit(360.0)) / width_dir).cast("long").alias("dir_bin"), F.floor(F.col(speed) / width_speed).cast("long").alias("speed_bin")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).select("dir_bin", "speed_bin", (F.col("n") * 100.0 / F.col("_all")).alias("percent"))


def is_ebb(d: Column, flood: float, ebb: float) -> Column:
    """Whether d belongs to the ebb: the circle is split half way between the two directions, over north, and opposite."""
    low, high = min(flood, ebb), max(flood, ebb)
    split = (low + (360 - high + low) / 2) % 360
    inside = (d >= split) & (d < split + 180)
    return inside if split <= ebb < split + 180 else ~inside


def signed_speed(speed: Column, direction: Column, principal: float) -> Column:
    """Speed along the principal direction, less than 0 against it."""
    return speed * F.cos(F.radians(direction - principal))


def ducted(d: Column) -> tuple[Column, Column]:
    return circular(d)


def multiple_circular(diameters: Column) -> tuple[Column, Column]:
    """Equivalent diameter and capture area of an array of diameters."""
    squares = F.aggregate(diameters, F.lit(0.0), lambda s, d: s + d * d)
    return F.sqrt(squares), math.pi / 4 * squares


def grid_convergence_index(fine: Column, coarse: Column, ratio: float, safety: float = 1.25, order: int = 2) -> Column:
    return safety * F.abs((fine - coarse) / fine) / (ratio**order - 1)


def turbulent_intensity(k: Column, ux: Column, uy: Column, uz: Column) -> Column:
    """Percent, of turbulent energy and velocity; energies that differ from 0 by less than 1e-4 below it are 0, lower ones null."""
    kept = F.when(k >= 0, k).when(k > -1e-4, 0.0)
    return F.sqrt(kept * 2 / 3) / F.sqrt(ux * ux + uy * uy + uz * uz) * 100


def polynomial_fit(df: DataFrame, x: str, y: str, by: list[str], n: int) -> DataFrame:
    """by, c0 to cn (lowest power first) and r2 of the least-squares polynomial of degree n per group.

    One aggregation gives the sums; each group's normal equations, about the mean of x and scaled by its deviation, are
    solved from them by elimination in an Arrow function that gets one row per group. r2 is the squared correlation of y
    and the fit.
    """
    centre = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z, w = (F.col(x) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0), F.col(y).cast("double")
    key = [c for c in by]
    near = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    near = near.join(centre, key) if by else near.join(F.broadcast(centre))
    power = lambda i: F.lit(1.0) if i == 0 else F.pow(z, F.lit(float(i)))
    sums = near.groupBy(*by, "_m", "_s").agg(
        F.array(*[F.sum(power(i)) for i in range(2 * n + 1)]).alias("_x"), F.array(*[F.sum(power(i) * w) for i in range(n + 1)]).alias("_y"), F.sum(w * w).alias("_yy")
    )

    @F.pandas_udf("array<double>")
    def solve(xs: pd.Series, ys: pd.Series, yy: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for a, b, q, mu, sd in zip(xs, ys, yy, m, s):
            a, b = np.asarray(a, float), np.asarray(b, float)
            matrix = np.array([[a[i + j] for j in range(n + 1)] for i in range(n + 1)])
            c = np.linalg.lstsq(matrix, b, rcond=None)[0]
            count, fit, fits = a[0], c @ a[: n + 1], c @ matrix @ c
            cov, vf, vy = c @ b - fit * b[0] / count, fits - fit * fit / count, q - b[0] ** 2 / count
            plain = np.polynomial.Polynomial(c)(np.polynomial.Polynomial([-mu / (sd or 1), 1 / (sd or 1)]))
            out.append([*np.append(plain.coef, np.zeros(n + 1))[: n + 1], cov * cov / (vf * vy) if vf > 0 and vy > 0 else np.nan])
        return pd.Series(out)

    fit = sums.withColumn("_c", solve("_x", "_y", "_yy", "_m", "_s"))
    return fit.select(*by, *[F.col("_c")[i].alias(f"c{i}") for i in range(n + 1)], F.col("_c")[n + 1].alias("r2"))


def energy_produced(df: DataFrame, power: str, seconds: float, bins: int = 100, points: int = 1000) -> DataFrame:
    """energy: seconds times the expected power of the histogram of `bins` cells, integrated by trapezoids over `points`.

    One aggregation for the range, one for the cells; the rest has as many rows as points.
    """
    p = df.where(F.col(power).isNotNull()).select(F.col(power).cast("double").alias("p"))
    span = p.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    cell = F.least(F.floor((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    cells = p.join(F.broadcast(span)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("all"))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("x", at)
    # a point on an edge belongs to the cell above it, the last point has no density
    grid = grid.withColumn("cell_", F.when(F.col("i") == points - 1, bins).otherwise(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins + 1e-9)).cast("int"))
    g = grid.join(F.broadcast(cells), F.col("cell_") == F.col("cell"), "left").join(F.broadcast(total))
    y = F.col("x") * F.coalesce("n", F.lit(0)) / F.col("all") * bins / (F.col("hi") - F.col("lo"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    ends = F.when(F.col("i").isin(0, points - 1), 0.5).otherwise(1.0)
    return g.agg((seconds * F.sum(y * step * ends)).alias("energy"))


def principal_flow_directions(df: DataFrame, direction: str, width: float) -> DataFrame:
    """direction1, direction2: the centres of the fullest cells of the two half circles about the main axis.

    The histogram of all directions is folded to 180 degrees; its fullest cell (the first of ties) gives the axis, the
    normal of which splits the rows. Each half is counted again in cells of `width` from its least to its highest
    direction. The splitting normal is the number of the fullest cell plus 90, as published results have it: that is a
    direction only for a width of 1 degree.
    """
    n = int(360 / width)
    d = df.where(F.col(direction).isNotNull()).select(F.col(direction).cast("double").alias("d"))
    bin_ = F.least(F.floor(F.col("d") / (360 / n)), F.lit(n - 1)).cast("int")
    counts = d.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    half = n // 2
    if n % 2:
        # the middle cell goes half to the end of the first half and half to the start of the second
        parts = F.when(F.col("b") < half, F.array(F.struct(F.col("b").alias("b"), F.col("n").cast("double").alias("n")))).when(
            F.col("b") > half, F.array(F.struct((F.col("b") - half - 1).alias("b"), F.col("n").cast("double").alias("n")))
        ).otherwise(F.array(F.struct(F.lit(half - 1).alias("b"), (F.col("n") / 2).alias("n")), F.struct(F.lit(0).alias("b"), (F.col("n") / 2).alias("n"))))
        folded = counts.select(F.explode(parts).alias("p")).groupBy(F.col("p.b").alias("b")).agg(F.sum("p.n").alias("n"))
    else:
        folded = counts.groupBy((F.col("b") % half).alias("b")).agg(F.sum("n").cast("double").alias("n"))
    top = folded.agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    normal = top.select(F.least(F.pmod(F.col("b") + 90, F.lit(360)), F.pmod(F.col("b") + 270, F.lit(360))).alias("normal"))
    first = F.col("d").between(F.col("normal"), F.col("normal") + 180)
    sides = d.join(F.broadcast(normal)).select(first.alias("first"), F.when(first, F.col("d")).otherwise(F.pmod(F.col("d") - 180, F.lit(360.0))).alias("d"))
    m = int(180 / width)
    span = sides.groupBy(F.col("first").alias("_f")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    cell = F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * m), F.lit(m - 1)).cast("int")
    full = sides.join(F.broadcast(span), F.col("first") == F.col("_f")).groupBy("first", "lo", "hi", F.coalesce(cell, F.lit(0)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    best = full.groupBy("first", "lo", "hi").agg(F.max_by("cell", F.struct("n", -F.col("cell"))).alias("cell"))
    centre = F.col("lo") + (F.col("cell") + 0.5) * (F.col("hi") - F.col("lo")) / m
    return best.agg(F.max(F.when(F.col("first"), centre)).alias("direction1"), (F.max(F.when(~F.col("first"), centre)) + 180).alias("direction2"))


def phase_probability(df: DataFrame, direction: str, speed: str, flood: float, ebb: float, bins: int) -> DataFrame:
    """bin, centre, ebb, flood: the shares of both phases among the rows of each of `bins` equal cells of speed."""
    d = df.where(F.col(speed).isNotNull() & F.col(direction).isNotNull()).select(F.col(speed).alias("v"), is_ebb(F.col(direction), flood, ebb).alias("ebb"))
    span = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    c = d.join(F.broadcast(span)).groupBy("lo", "hi", cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("ebb"), 1)).alias("e"))
    return c.select("bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("centre"), (F.col("e") / F.col("n")).alias("ebb"), (1 - F.col("e") / F.col("n")).alias("flood"))


def circular_slices(diameter: float, hub: float, cell: float) -> list[tuple[float, float]]:
    """(height, area) of the slices of a circle about the hub: cells from its bottom on, the last may reach above its top."""
    r = diameter / 2
    n = math.ceil((diameter + cell) / cell - 1e-9)
    edges = [hub - r + i * cell for i in range(n)]
    middle = sum(edges) / len(edges)
    below = lambda y: math.pi * r * r / 2 + y * math.sqrt(max(r * r - y * y, 0)) + r * r * math.asin(max(-1.0, min(1.0, y / r)))
    areas = [below(max(-r, min(r, e - middle))) for e in edges]
    return [(lo + cell / 2, b - a) for lo, a, b in zip(edges, areas, areas[1:])]


def rectangular_slices(height: float, width: float, hub: float, cell: float) -> list[tuple[float, float]]:
    n = math.ceil((height + cell) / cell - 1e-9) - 1
    return [(hub - height / 2 + (i + 0.5) * cell, width * cell) for i in range(n)]


def speed_bin(v: Column, width: float) -> Column:
    """The number, from 1, of the cell (a, b] of `width` from 0 that holds v; 0 for v = 0."""
    return F.ceil(v / width).cast("long")


def power_curve(windows: DataFrame, hub: str, weighted: str, power: str, width: float = 0.1, exponent: float = -1 / 3) -> DataFrame:
    """bin, u_avg, u_weighted, p_avg, p_std, p_max, p_min per cell (a, b] of hub speed, of rows that are averaging windows.

    `weighted` is a window's mean of the cube of the area-weighted speed; it is taken to the power of -1/3 as published
    results have it (1/3 would be a speed).
    """
    d = windows.where(F.col(hub) > 0)
    u = F.pow(F.col(weighted), F.lit(float(exponent)))
    return d.groupBy(speed_bin(F.col(hub), width).alias("bin")).agg(
        F.avg(hub).alias("u_avg"), F.avg(u).alias("u_weighted"), F.avg(power).alias("p_avg"), F.stddev_pop(power).alias("p_std"), F.max(power).alias("p_max"), F.min(power).alias("p_min")
    )


def device_efficiency(windows: DataFrame, hub: str, power: str, density: Column, area: float, width: float = 0.1) -> DataFrame:
    """bin, u_avg, efficiency: mean power over half of density, area and mean hub speed cubed, per cell (a, b] of hub speed."""
    d = windows.where(F.col(hub) > 0).withColumn("_rho", density)
    s = d.groupBy(speed_bin(F.col(hub), width).alias("bin")).agg(F.avg(hub).alias("u_avg"), F.avg(power).alias("_p"), F.avg("_rho").alias("_r"))
    return s.select("bin", "u_avg", (F.col("_p") / (0.5 * F.col("_r") * area * F.pow("u_avg", F.lit(3.0)))).alias("efficiency"))


def velocity_profiles(windows: DataFrame, height: str, hub: str, value: str, depth: float, width: float = 0.5) -> DataFrame:
    """bin, height, value: the mean profile per cell (a, b] of hub speed, 0 at the bed, the highest value carried to the surface."""
    d = windows.where((F.col(hub) > 0) & F.col(value).isNotNull())
    p = d.groupBy(speed_bin(F.col(hub), width).alias("bin"), F.col(height).cast("double").alias("height")).agg(F.avg(value).alias("value"))
    ends = p.groupBy("bin").agg(F.max_by("value", "height").alias("top"))
    bed = ends.select("bin", F.lit(0.0).alias("height"), F.lit(0.0).alias("value"))
    return p.where(F.col("height") < depth).unionByName(bed).unionByName(ends.select("bin", F.lit(float(depth)).alias("height"), F.col("top").alias("value")))
