"""Angles, magnitudes and orientation matrices as Column functions. Null components give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = tuple[Vector, Vector, Vector]


def normalised(degrees: Column) -> Column:
    """Modulo 360."""
    return F.pmod(degrees, F.lit(360.0))


def unwrapped(degrees: Column) -> Column:
    """Into [0, 360] by whole turns; 360 stays."""
    return F.when(degrees.between(0, 360), degrees).when(degrees > 360, F.when(F.pmod(degrees, F.lit(360.0)) == 0, 360.0).otherwise(F.pmod(degrees, F.lit(360.0)))).otherwise(F.pmod(degrees, F.lit(360.0)))


def converted(degrees: Column, tidal: bool = True) -> Column:
    """Counter-clockwise from east to clockwise from north or back: -180 to 180 if tidal, else 0 to 360."""
    turned = F.pmod(90 - degrees, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned) if tidal else turned


def magnitude_phase(x: Column, y: Column, z: Column | None = None) -> dict[str, Column]:
    if z is None:
        return {"magnitude": F.sqrt(x * x + y * y), "theta": F.atan2(y, x)}
    return {"magnitude": norm(x, y, z), "theta": F.atan2(y, x), "phi": F.atan2(F.sqrt(x * x + y * y), z)}


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def direction_to(u: Column, v: Column) -> Column:
    """Where a current of east u and north v goes, clockwise from north."""
    return F.pmod(90 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def dot(m: Matrix, v: Vector) -> Vector:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m)


def transposed(m: Matrix) -> Matrix:
    return tuple(zip(*m))


def constant(rows) -> Matrix:
    return tuple(tuple(F.lit(float(x)) for x in r) for r in rows)


def about(axis: int, angle: Column) -> Matrix:
    """The turn of coordinate axes by an angle (radians) about the axis of that index."""
    one, zero, s, c = F.lit(1.0), F.lit(0.0), F.sin(angle), F.cos(angle)
    i, j = [k for k in range(3) if k != axis]
    rows = [[one if r == k else zero for k in range(3)] for r in range(3)]
    rows[i][i], rows[j][j], rows[i][j], rows[j][i] = c, c, s, -s
    return tuple(tuple(r) for r in rows)


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)) for i in range(3))


def orientation(heading: Column, pitch: Column, roll: Column) -> Matrix:
    """From instrument to earth axes (east, north, up), of degrees: profilers, where the y axis points along the heading."""
    h, p, r = (F.radians(c) for c in (heading, pitch, roll))
    return product(about(2, h), product(about(0, -p), about(1, r)))


def gimbal(pitch: Column, roll: Column) -> Column:
    """The pitch (degrees) of an instrument whose pitch sensor turns with its roll."""
    return F.degrees(F.atan(F.tan(F.radians(pitch)) * F.cos(F.radians(roll))))


def euler(heading: Column, pitch: Column, roll: Column) -> Matrix:
    """From earth to instrument axes, of degrees; rows are instrument axes, where the x axis points along the heading."""
    h, p, r = (F.radians(c) for c in (90 - heading, pitch, roll))
    return product(about(0, r), product(about(1, p), about(2, h)))


def heading_pitch_roll(m: Matrix) -> dict[str, Column]:
    """Degrees of the angles of an orientation matrix whose rows are the instrument axes in earth axes."""
    return {
        "heading": F.pmod(F.degrees(F.atan2(m[0][0], m[0][1])), F.lit(360.0)),
        "pitch": F.degrees(F.asin(m[0][2])),
        "roll": F.degrees(F.atan2(m[1][2], m[2][2])),
    }


def of_quaternion(w: Column, x: Column, y: Column, z: Column) -> Matrix:
    """The matrix of a unit quaternion, rows the instrument axes in earth axes."""
    two = lambda a, b: 2 * (a * b)
    return (
        (w * w + x * x - y * y - z * z, two(x, y) - two(w, z), two(x, z) + two(w, y)),
        (two(x, y) + two(w, z), w * w - x * x + y * y - z * z, two(y, z) - two(w, x)),
        (two(x, z) - two(w, y), two(y, z) + two(w, x), w * w - x * x - y * y + z * z),
    )


def tilt(pitch: Column, roll: Column, twice: bool = True) -> Column:
    """Degrees off the vertical, of pitch and roll in degrees.

    With twice (the default, as published results have it) the angles are turned into radians two times over, which
    makes the tilt far too small; twice=False gives the plain formula.
    """
    of = lambda c: F.radians(F.radians(c)) if twice else F.radians(c)
    return F.degrees(F.atan(F.sqrt(F.tan(of(roll)) ** 2 + F.tan(of(pitch)) ** 2)))


def beam_matrix(theta: float = 20, convex: bool = True) -> tuple[tuple[float, ...], ...]:
    """From four beams at theta degrees off the axis to x, y, z and error."""
    import math

    t = math.radians(theta)
    a, b, c = 1 / (2 * math.sin(t)), 1 / (4 * math.cos(t)), 1 if convex else -1
    d = a / math.sqrt(2)
    return (c * a, -c * a, 0.0, 0.0), (0.0, 0.0, -c * a, c * a), (b, b, b, b), (d, d, -d, -d)


def determinant(m: Matrix) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
