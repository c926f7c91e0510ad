"""Calendar, seasonal and periodic column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def day_of_week(ts: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(col(ts))


def _wave(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * pi / period)
    return F.sin(angle), F.cos(angle)


def calendar_features(ts: Column | str) -> dict[str, Column]:
    """All calendar features by name; month and day waves count from 0."""
    t = col(ts)
    dow, month, day = day_of_week(t), F.month(t), F.dayofmonth(t)
    out = {"day_of_week": dow, "month": month, "day": day, "day_of_year": F.dayofyear(t)}
    for name, x, period in (("day_of_week", dow, 7), ("month", month - 1, 12), ("day", day - 1, 31)):
        out[f"{name}_sin"], out[f"{name}_cos"] = _wave(x, period)
    out["month_start"] = (day <= 3).cast("int")
    out["month_middle"] = day.between(14, 16).cast("int")
    out["month_end"] = (day + 2 >= F.dayofmonth(F.last_day(t))).cast("int")
    return out


def fourier(t: Column | str, period: float, order: int) -> dict[str, Column]:
    """sin and cos of 2 pi k t / period for k = 1..order."""
    out = {}
    for k in range(1, order + 1):
        angle = col(t) * (2 * pi * k / period)
        out[f"sin_{k}"], out[f"cos_{k}"] = F.sin(angle), F.cos(angle)
    return out


def elapsed_days(start: Column | str, ts: Column | str) -> Column:
    """Fractional days from start to ts (timestamps without zone)."""
    micros = lambda x: F.unix_micros(col(x).cast("timestamp"))
    return (micros(ts) - micros(start)) / 86_400_000_000.0


def event_active(ts: Column | str, event: Column | str, lower: int, upper: int) -> Column:
    """Whether ts lies lower..upper whole days after the event's day."""
    return F.datediff(col(ts), col(event)).between(lower, upper)


def _phase(x: Column, period: float) -> Column:
    return F.pmod(x, F.lit(float(period)))


def periodic_contains(x: Column | str, period: float, start: float, end: float) -> Column:
    """Whether x mod period lies in [start, end], which may wrap around."""
    v, a, b = _phase(col(x), period), start % period, end % period
    return v.between(a, b) if a <= b else (v >= a) | (v <= b)


def circular_distance(x: Column, point: float, period: float) -> Column:
    d = F.abs(_phase(x, period) - point % period)
    return F.least(d, F.lit(float(period)) - d)


def periodic_signed_distance(x: Column | str, period: float, start: float, end: float) -> Column:
    """The circular distance to the interval's nearer edge: negative inside, positive outside."""
    d = F.least(circular_distance(col(x), start, period), circular_distance(col(x), end, period))
    return F.when(periodic_contains(x, period, start, end), -d).otherwise(d)
