"""Calendar columns and day arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(value: str | dt.date | Column) -> Column:
    """A date literal from text or a Python date; a Column passes through."""
    if isinstance(value, Column):
        return value
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def to_day(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def days(value: Column) -> Column:
    return value.cast("int")


def with_calendar(frame: DataFrame, day: str = "target_date") -> DataFrame:
    """P12. Calendar features of a date column; Monday is 0, weeks are ISO weeks."""
    date = F.col(day)
    return frame.withColumns(
        {
            "day_of_week": F.weekday(date),
            "day_of_month": F.dayofmonth(date),
            "week_of_year": F.weekofyear(date),
            "month": F.month(date),
            "quarter": F.quarter(date),
            "is_weekend": F.weekday(date) >= 5,
            "is_month_start": F.dayofmonth(date) == 1,
            "is_month_end": date == F.last_day(date),
        }
    )


def with_horizons(frame: DataFrame, start: str, horizon: int) -> DataFrame:
    """J1, P13. One row per horizon 1..``horizon`` with its target date, counted from column ``start``."""
    if not 1 <= horizon <= 56:
        raise ValueError("horizon must be in 1..56")
    return frame.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "target_date", F.date_add(F.col(start), F.col("horizon"))
    )
