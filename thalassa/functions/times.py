"""Day numbers, epochs, two-digit years and packed date fields as Column functions. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the zero of MATLAB and of spreadsheet day numbers to 1970-01-01.
MATLAB, EXCEL = 719529, 25569


def of_days(days: Column, zero: int) -> Column:
    """A timestamp of a day number, to the microsecond."""
    return F.timestamp_micros(F.round((days - zero) * 86_400_000_000).cast("long"))


def matlab_to_datetime(days: Column) -> Column:
    return of_days(days, MATLAB)


def excel_to_datetime(days: Column) -> Column:
    return of_days(days, EXCEL)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def matlab_parts(ts: Column) -> tuple[Column, Column]:
    """The whole day number and the microseconds of that day (long): a day number as double tells ten microseconds apart at best."""
    us, day = micros(ts), F.lit(86_400_000_000)
    past = F.pmod(us, day)
    return F.floor((us - past) / day) + MATLAB, past


def datetime_to_matlab(ts: Column) -> Column:
    return micros(ts) / 86_400_000_000 + MATLAB


def epoch_to_datetime(seconds: Column, offset_hours: float = 0) -> Column:
    return F.timestamp_micros(F.round((seconds + 3600 * offset_hours) * 1_000_000).cast("long"))


def datetime_to_epoch(ts: Column) -> Column:
    return micros(ts) / 1_000_000


def text(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss.SSSSSS") -> Column:
    return F.date_format(ts, pattern)


def full_year(year: Column) -> Column:
    """Years of up to 100 are of this century below 90 and of the last from 90 on."""
    return F.when(year > 100, year).otherwise(year + F.when(year < 90, 2000).otherwise(1900))


def of_fields(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, micro: Column) -> Column:
    """A timestamp of its fields; null if the date is zero or does not exist."""
    text_ = F.concat_ws("-", *[c.cast("int").cast("string") for c in (year, month, day)])
    day_ = F.try_to_timestamp(text_, F.lit("y-M-d"))
    past = ((hour * 60 + minute) * 60 + second) * 1_000_000 + micro
    return F.when(month > 0, F.timestamp_micros(F.unix_micros(day_) + past.cast("long")))


def of_bcd(byte: Column) -> Column:
    """The number of two decimal digits in the halves of a byte."""
    return F.shiftright(byte, 4).bitwiseAND(F.lit(15)) * 10 + byte.bitwiseAND(F.lit(15))


def bits(value: Column, first: int, width: int = 1) -> Column:
    """The number in `width` bits from bit `first` on."""
    return F.shiftright(value.cast("long"), first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def fill_gaps(df, by: list[str], order: str, seconds: str, rate: float):
    """df with missing `seconds` filled by line over `order`, ends carried on at the rate (samples a second)."""
    from pyspark.sql import Window

    back = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known, at = F.col(seconds).isNotNull(), F.when(F.col(seconds).isNotNull(), F.col(order))
    t0, t1, i0, i1 = F.last(seconds, True).over(back), F.first(seconds, True).over(on), F.last(at, True).over(back), F.first(at, True).over(on)
    line = t0 + (t1 - t0) * (F.col(order) - i0) / F.nullif(i1 - i0, F.lit(0))
    return df.withColumn(seconds, F.when(known, F.col(seconds)).otherwise(F.coalesce(line, t0 + (F.col(order) - i0) / rate, t1 - (i1 - F.col(order)) / rate)))
