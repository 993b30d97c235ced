"""Calendar encodings of a timestamp column (``feat_calendar``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR_COLS = ("hour_of_day", "day_of_week", "is_business_hours", "minutes_since_midnight",
                 "hour_sin", "hour_cos", "dow_sin", "dow_cos")

# Business hours are 9 <= hour < 18 on Monday..Friday.
BUSINESS_START, BUSINESS_END, WEEKDAYS = 9, 18, 5


def day_of_week(ts: Column) -> Column:
    """Monday = 0 … Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(ts)


def business_hours(ts: Column) -> Column:
    h = F.hour(ts)
    return ((h >= BUSINESS_START) & (h < BUSINESS_END) & (day_of_week(ts) < WEEKDAYS)).cast("int")


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column) -> list[Column]:
    h = F.hour(ts)
    dow = day_of_week(ts)
    hs, hc = cyclic(h, 24)
    ds, dc = cyclic(dow, 7)
    return [
        h.cast("int").alias("hour_of_day"),
        dow.cast("int").alias("day_of_week"),
        business_hours(ts).alias("is_business_hours"),
        (h * 60 + F.minute(ts)).cast("int").alias("minutes_since_midnight"),
        hs.alias("hour_sin"), hc.alias("hour_cos"),
        ds.alias("dow_sin"), dc.alias("dow_cos"),
    ]


#: Calendar inputs of the forecast frame.
FORECAST_CALENDAR = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_business_hours")


def forecast_calendar_columns(ts: Column) -> list[Column]:
    """The calendar inputs of the forecast frame, in their order."""
    circle = [*cyclic(F.hour(ts), 24), *cyclic(day_of_week(ts), 7)]
    return [c.alias(name) for c, name in zip([*circle, business_hours(ts)], FORECAST_CALENDAR)]
