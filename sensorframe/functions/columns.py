"""Small column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP = "yyyyMMddHHmmss"


def strip_blanks(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def first_number(c: Column) -> Column:
    """First run of digits as a number, NULL if there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("double")


def part(c: Column, sep: str, position: int) -> Column:
    """1-based part of a split string, NULL past the end."""
    return F.try_element_at(F.split(c, sep), F.lit(position))


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def parse_stamp(c: Column, pattern: str = STAMP) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


def format_stamp(c: Column, pattern: str = STAMP) -> Column:
    return F.date_format(c, pattern)


def feature_name(sensor: Column, feature: Column) -> Column:
    return F.concat_ws(" - ", sensor, feature)


def seconds_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(1_000_000))


def whole_hours(start: Column, end: Column) -> Column:
    return F.floor(seconds_between(start, end) / F.lit(3600)).cast("long")


def duration_text(start: Column, end: Column) -> Column:
    """``"D days, H hours"``."""
    seconds = seconds_between(start, end)
    days = F.floor(seconds / F.lit(86400)).cast("long")
    hours = F.floor((seconds - days * 86400) / F.lit(3600)).cast("long")
    return F.format_string("%d days, %d hours", days, hours)


def finite(c: Column) -> Column:
    """NaN becomes NULL: in Spark NaN compares greatest, in the data it means missing."""
    return F.when(~F.isnan(c), c)


def r6(c: Column | str) -> Column:
    """Six decimals for comparing results; the nudge keeps exact ties from rounding either way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6) + F.lit(0.0)


def array_quantile(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array without NULLs (NULL if empty)."""
    h = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(h).cast("int")
    a = F.get(sorted_values, low)
    b = F.get(sorted_values, F.least(low + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (h - low)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(a: Column) -> Column:
    return array_sum(a) / F.nullif(F.size(a), F.lit(0))


def array_std(a: Column) -> Column:
    """Sample standard deviation, from sums taken relative to the first element."""
    n, origin = F.size(a), F.get(a, F.lit(0))
    sums = F.aggregate(
        a,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda acc, x: F.struct(
            (acc["s"] + x - origin).alias("s"), (acc["q"] + (x - origin) * (x - origin)).alias("q")
        ),
        lambda acc: F.sqrt(
            F.greatest(acc["q"] - acc["s"] * acc["s"] / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
        ),
    )
    return sums


def grid_floor(c: Column, step_hours: int = 4) -> Column:
    """Start of the grid step (a divisor of 24 hours, counted from midnight) that holds ``c``."""
    hours = F.floor(F.hour(c) / F.lit(step_hours)) * step_hours
    return F.date_trunc("DAY", c) + F.make_dt_interval(hours=hours.cast("int"))
