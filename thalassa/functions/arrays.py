"""Column functions over arrays: a spectrum or a profile is a row with arrays of equal length.

Null arrays give null. Points whose value is null or NaN are left out of sums and integrals (`finite`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(f, /, **values: Column) -> Column:
    """f of a struct of values that are computed once per row, not once per array element."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def points(x: Column, y: Column) -> Column:
    """array<struct<x, y>> without points that lack a finite y."""
    both = F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))
    return F.filter(both, lambda p: p["y"].isNotNull() & ~F.isnan(p["y"]))


def trapezoid(x: Column, y: Column) -> Column:
    """Integral of y over x by trapezoids; 0 for fewer than two points."""

    def of(b: Column) -> Column:
        p = b["p"]
        pairs = F.zip_with(F.slice(p, F.lit(2), F.size(p)), p, lambda q, r: F.coalesce((q["x"] - r["x"]) * (q["y"] + r["y"]) / 2, F.lit(0.0)))
        return total(pairs)

    return bind(of, p=points(x, y))


def between(x: Column, y: Column, low: Column | float, high: Column | float) -> tuple[Column, Column]:
    """The parts of x and y with low <= x <= high."""
    p = F.filter(points(x, y), lambda q: (q["x"] >= low) & (q["x"] <= high))
    return F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """The value at x on the line through the points (xs ascending, ys); null outside of them."""

    def of(b: Column) -> Column:
        p, at = b["p"], b["x"]
        low = F.array_max(F.filter(p, lambda q: q["x"] <= at))
        high = F.get(F.filter(p, lambda q: q["x"] >= at), F.lit(0))
        return F.when(low["x"] == high["x"], low["y"]).otherwise(low["y"] + (high["y"] - low["y"]) * (at - low["x"]) / (high["x"] - low["x"]))

    return F.when(F.size(xs) > 0, bind(of, p=points(xs, ys), x=x))


def argmax(keys: Column, values: Column) -> Column:
    """The key of the highest value; ties to the first."""
    return F.get(keys, F.array_position(values, F.array_max(values)).cast("int") - 1)


def slope(x: Column, y: Column) -> Column:
    """The slope of the least-squares line through the points."""

    def of(b: Column) -> Column:
        p, n = b["p"], F.size(b["p"])
        sums = F.aggregate(
            p,
            F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "xy")]),
            lambda s, q: F.struct((s["x"] + q["x"]).alias("x"), (s["y"] + q["y"]).alias("y"), (s["xx"] + q["x"] * q["x"]).alias("xx"), (s["xy"] + q["x"] * q["y"]).alias("xy")),
        )
        return bind(lambda c: (c["n"] * c["s"]["xy"] - c["s"]["x"] * c["s"]["y"]) / (c["n"] * c["s"]["xx"] - c["s"]["x"] * c["s"]["x"]), s=sums, n=n)

    return bind(of, p=points(x, y))
