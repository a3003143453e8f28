"""Electrical power of devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dc_power(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(0.0)
    for v, i in pairs:
        out = out + v * i
    return out


def ac_power_three_phase(pairs: list[tuple[Column, Column]], power_factor: float, line_to_line: bool = False) -> Column:
    return F.abs(dc_power(pairs)) * power_factor * (3**0.5 if line_to_line else 1)
