"""Packed instrument fields, file names, regions and units as Column functions. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import bits, of_bcd, of_fields

#: First bit and width of the fields of the status words of acoustic current profilers.
STATUS0 = {"proc_idle_less_3pct": (0, 1), "proc_idle_less_6pct": (1, 1), "proc_idle_less_12pct": (2, 1)}
STATUS = {
    "wakeup_state": (28, 4), "orient_up": (25, 3), "auto_orientation": (22, 3), "previous_wakeup_state": (18, 4), "low_volt_skip": (17, 1), "active_config": (16, 1),
    "echo_index": (12, 4), "telemetry_data": (11, 1), "boost_running": (10, 1), "echo_freq_bin": (5, 5), "bd_scaling": (1, 1),
}
ALTIMETER = {"tilt_over_5deg": (0, 1), "tilt_over_10deg": (1, 1), "multibeam_alt": (2, 1), "n_beams_alt": (3, 4), "power_level_idx_alt": (7, 3)}


def fields(word: Column, layout: dict[str, tuple[int, int]]) -> Column:
    """struct of the fields of a status word."""
    return F.struct(*[bits(word, first, width).alias(name) for name, (first, width) in layout.items()])


def status0(word: Column) -> Column:
    """The idle flags, if bit 15 says that they are given."""
    return F.when(bits(word, 15) == 1, fields(word, STATUS0))


def beams(word: Column, echo: bool = False, single: bool = False) -> Column:
    """struct<n_cells, frame, n_beams> of the packed numbers of cells, coordinate system and beams."""
    if echo:
        return F.struct(word.cast("int").alias("n_cells"), F.lit(None).cast("string").alias("frame"), F.lit(None).cast("int").alias("n_beams"))
    frame = F.lit("beam") if single else F.element_at(F.array(F.lit("ENU"), F.lit("XYZ"), F.lit("beam"), F.lit(None).cast("string")), bits(word, 10, 2) + 1)
    return F.struct(bits(word, 0, 10).alias("n_cells"), frame.alias("frame"), (F.lit(1) if single else bits(word, 12, 20)).alias("n_beams"))


def mean_of_two(a: Column, b: Column) -> Column:
    """The mean of two readings, or the one there is."""
    return F.coalesce((a + b) / 2, a, b)


def mean_of_two_angles(a: Column, b: Column) -> Column:
    """The direction (degrees) between two, or the one there is."""
    x, y = F.cos(F.radians(a)) + F.cos(F.radians(b)), F.sin(F.radians(a)) + F.sin(F.radians(b))
    return F.coalesce(F.degrees(F.atan2(y, x)), a, b)


def bcd_time(minute: Column, second: Column, day: Column, hour: Column, year: Column, month: Column) -> Column:
    """A timestamp of six bytes of packed decimals; years of two digits from 1990 on."""
    m, s, d, h, y, mo = (of_bcd(c) for c in (minute, second, day, hour, year, month))
    return of_fields(y + F.when(y >= 90, 1900).otherwise(2000), mo, d, h, m, s, F.lit(0))


#: Latitude and longitude ranges of the hindcast and wind regions.
HINDCAST = {"Hawaii": ((15.0, 27.000002), (-164.0, -151.0)), "West_Coast": ((30.0906, 48.8641), (-130.072, -116.899)), "Atlantic": ((24.382, 44.8247), (-81.552, -65.721))}
WIND = {"CA_NWP_overlap": ((41.213, 42.642), (-129.090, -121.672)), "Offshore_CA": ((31.932, 42.642), (-129.090, -115.806)), "Hawaii": ((15.565, 26.221), (-164.451, -151.278)), "NW_Pacific": ((41.213, 49.579), (-130.831, -121.672)), "Mid_Atlantic": ((37.273, 42.211), (-76.427, -64.800))}


def region(lat: Column, lon: Column, regions: dict = HINDCAST, preferred: str | None = None) -> Column:
    """The first region that holds a place, null if none does; `preferred` stands for an overlap of two."""
    out = F.lit(None).cast("string")
    for name, ((a, b), (c, d)) in reversed(regions.items()):
        out = F.when(lat.between(a, b) & lon.between(c, d), preferred if preferred and "overlap" in name else name).otherwise(out)
    return out


def elevation_names(parameter: str, elevations: list[float]) -> list[str]:
    return [f"{parameter}_{e}m" for e in elevations]


#: The letter before the year in the file names of buoy archives, by parameter.
SEPARATORS = {"swden": "w", "swdir": "d", "swdir2": "i", "swr1": "j", "swr2": "k", "stdmet": "h", "cwind": "c"}


def buoy_file(name: Column, parameter: str) -> Column:
    """struct<id, year> of an archive's file name such as 46022w1996.txt.gz; null for other names."""
    shape = f"^([^.]{{5}}){SEPARATORS[parameter]}([^.]*)\\.txt\\.gz"
    at = lambda i: F.regexp_extract(name, shape, i)
    return F.when(name.rlike(shape), F.struct(at(1).alias("id"), at(2).alias("year")))


#: What stands for a missing value in buoy files.
MISSING = (9999.0, 999.0, 99.0)


def present(text: Column, missing: tuple = MISSING) -> Column:
    """The number in a field, null if it is not one or stands for a missing value."""
    x = text.try_cast("double") if hasattr(text, "try_cast") else text.cast("double")
    return F.when(~x.isin(*missing), x)


def clamped(start: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """A wished time range cut to the one there is."""
    return F.greatest(start, first), F.least(end, last)
