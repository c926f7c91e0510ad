"""Public holidays by rule, and their indicators.

A country's days are stated as fixed dates, days from Easter Sunday, and weekdays of a month, so a table for any years is
made from the rules; it has a few rows a year and country.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.  (name, "fixed", month, day) | (name, "easter", days) | (name, "weekday", month, Monday = 0, n-th, -1 the last).
RULES: dict[str, list[tuple]] = {
    "US": [
        ("New Year's Day", "fixed", 1, 1), ("Martin Luther King Jr. Day", "weekday", 1, 0, 3), ("Washington's Birthday", "weekday", 2, 0, 3), ("Memorial Day", "weekday", 5, 0, -1),
        ("Juneteenth", "fixed", 6, 19), ("Independence Day", "fixed", 7, 4), ("Labor Day", "weekday", 9, 0, 1), ("Columbus Day", "weekday", 10, 0, 2), ("Veterans Day", "fixed", 11, 11),
        ("Thanksgiving", "weekday", 11, 3, 4), ("Christmas Day", "fixed", 12, 25),
    ],
    "DE": [
        ("Neujahr", "fixed", 1, 1), ("Karfreitag", "easter", -2), ("Ostermontag", "easter", 1), ("Tag der Arbeit", "fixed", 5, 1), ("Christi Himmelfahrt", "easter", 39),
        ("Pfingstmontag", "easter", 50), ("Tag der Deutschen Einheit", "fixed", 10, 3), ("Erster Weihnachtstag", "fixed", 12, 25), ("Zweiter Weihnachtstag", "fixed", 12, 26),
    ],
    "FR": [
        ("Jour de l'an", "fixed", 1, 1), ("Lundi de Paques", "easter", 1), ("Fete du Travail", "fixed", 5, 1), ("Victoire 1945", "fixed", 5, 8), ("Ascension", "easter", 39),
        ("Lundi de Pentecote", "easter", 50), ("Fete nationale", "fixed", 7, 14), ("Assomption", "fixed", 8, 15), ("Toussaint", "fixed", 11, 1), ("Armistice", "fixed", 11, 11), ("Noel", "fixed", 12, 25),
    ],
    "GB": [
        ("New Year's Day", "fixed", 1, 1), ("Good Friday", "easter", -2), ("Easter Monday", "easter", 1), ("Early May Bank Holiday", "weekday", 5, 0, 1), ("Spring Bank Holiday", "weekday", 5, 0, -1),
        ("Summer Bank Holiday", "weekday", 8, 0, -1), ("Christmas Day", "fixed", 12, 25), ("Boxing Day", "fixed", 12, 26),
    ],
}


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar: the Sunday after the first full moon of spring, by the lunar calendar."""
    golden, century = year % 19, year // 100
    moon = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon -= (moon // 28) * (1 - (29 // (moon + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + moon + 2 - century + century // 4) % 7
    days = moon - weekday
    return date(year, 3, 1) + timedelta(days=days + 27)


def holidays_of(country: str, years: range) -> list[tuple[date, str]]:
    if country not in RULES:
        raise ValueError(f"no rules for {country}")
    out = []
    for y in years:
        for name, kind, *at in RULES[country]:
            if kind == "fixed":
                out.append((date(y, *at), name))
            elif kind == "easter":
                out.append((easter(y) + timedelta(days=at[0]), name))
            else:
                month, weekday, nth = at
                if nth > 0:
                    first = date(y, month, 1)
                    out.append((first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (nth - 1)), name))
                else:
                    last = date(y + month // 12, month % 12 + 1, 1) - timedelta(days=1)
                    out.append((last - timedelta(days=(last.weekday() - weekday) % 7), name))
    return sorted(out)


def holiday_table(spark: SparkSession, country: str, years: range) -> DataFrame:
    return spark.createDataFrame(holidays_of(country, years), "ds date, holiday string")


def with_holidays(df: DataFrame, ts: str, holidays: DataFrame, lower: int = 0, upper: int = 0) -> DataFrame:
    """``df`` with holiday: the name of the holiday lower..upper days from which the row's day lies (the first by name), or
    null; ``holidays`` is (ds, holiday).  Windows are spread over the table's rows, so the join is on the day."""
    days = holidays.select(F.explode(F.transform(F.sequence(F.lit(lower), F.lit(upper)), lambda d: F.date_add("ds", d))).alias("__day"), "holiday")
    days = days.groupBy("__day").agg(F.min("holiday").alias("holiday"))
    return df.join(days, F.to_date(ts) == F.col("__day"), "left").drop("__day")


def indicators(names: list[str]) -> dict[str, Column]:
    """One 0/1 column a holiday of ``with_holidays``'s rows."""
    return {f"holiday_{n}": F.when(F.col("holiday") == n, 1.0).otherwise(0.0) for n in names}
