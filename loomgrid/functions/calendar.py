"""Calendar expressions: daylight saving, seasons and cyclic features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.config import TIME_ZONE

SEQ_CALENDAR = ("hod_sin", "hod_cos", "dow_sin", "dow_cos", "is_holiday")
TARGET_CALENDAR = tuple(f"dow_{i}" for i in range(7)) + ("month_sin", "month_cos", "is_holiday")


def day_hours(day: Column, tz: str = TIME_ZONE) -> Column:
    """Length of a local day in hours, from the zone rules (session zone UTC)."""
    start = F.to_utc_timestamp(day.cast("timestamp"), tz)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), tz)
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600


def dst_kind(day: Column, tz: str = TIME_ZONE) -> Column:
    """``spring`` for a short day, ``fall`` for a long one, else ``normal``."""
    hours = day_hours(day, tz)
    return F.when(hours < 24, "spring").when(hours > 24, "fall").otherwise("normal")


def dst_days(spark, first_year: int, last_year: int, tz: str = TIME_ZONE) -> DataFrame:
    """Transition days of a span of years as ``(fecha, kind)``."""
    days = spark.range(1).select(
        F.explode(
            F.sequence(
                F.lit(f"{first_year}-01-01").cast("date"),
                F.lit(f"{last_year}-12-31").cast("date"),
            )
        ).alias("fecha")
    )
    return days.withColumn("kind", dst_kind(F.col("fecha"), tz)).where("kind <> 'normal'")


def season_of(day: Column) -> Column:
    """Meteorological season 0..3, December to February being 0."""
    return F.floor(F.pmod(F.month(day), F.lit(12)) / 3).cast("int")


def circular_doy_distance(a: Column, b: Column) -> Column:
    """Day-of-year distance on a 365-day circle."""
    distance = F.abs(a - b)
    return F.least(distance, F.lit(365) - distance)


def _cycle(value: Column, period: float) -> Column:
    return value * (2 * math.pi / period)


def sequence_calendar(ts: Column, is_holiday: Column) -> list[Column]:
    """Per-step inputs: hour and weekday on the circle, holiday flag."""
    hour = _cycle(F.hour(ts), 24.0)
    weekday = _cycle(F.weekday(ts), 7.0)
    return [
        F.sin(hour),
        F.cos(hour),
        F.sin(weekday),
        F.cos(weekday),
        is_holiday.cast("double"),
    ]


def target_calendar(day: Column, is_holiday: Column) -> Column:
    """Target-day inputs: weekday one-hot (Monday first), month, holiday flag."""
    month = _cycle(F.month(day) - 1, 12.0)
    weekday = [(F.weekday(day) == i).cast("double") for i in range(7)]
    return F.array(*weekday, F.sin(month), F.cos(month), is_holiday.cast("double"))


def flag_holidays(df: DataFrame, holidays: DataFrame | None, day: str, flag: str) -> DataFrame:
    """Add a boolean holiday flag from a holiday dimension ``(date)``.

    The dimension is joined without a hint: the optimizer broadcasts it below
    its size threshold and shuffles it otherwise.
    """
    if holidays is None:
        return df.withColumn(flag, F.lit(False))
    dates = holidays.select(F.col("date").cast("date").alias(day)).distinct()
    return df.join(dates.withColumn(flag, F.lit(True)), day, "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )
