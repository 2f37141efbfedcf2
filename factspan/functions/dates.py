"""Date and period expressions. All periods are half-open [start, end) dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sentinels of the yyyymmdd integer dates
NO_DATE = 0
OPEN_DATE = 99991231
# fixed values: months covered by one observation of each publishing frequency
FREQUENCY_MONTHS = {"MONTHLY": 1, "QUARTERLY": 3, "ANNUAL": 12}


def year_start(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def month_of(year: Column, month: Column) -> Column:
    """First day of a month; null when the year or month is out of range."""
    return F.when(
        year.between(1, 9999) & month.between(1, 12), F.make_date(year, month, F.lit(1))
    )


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def period(grain: str, day: Column, year: Column) -> tuple[Column, Column]:
    """Start and end of the bucket holding ``day``; a missing day falls back to its year."""
    if grain == "day":
        start, end = day, F.date_add(day, 1)
    elif grain == "month":
        start, end = month_start(day), F.add_months(month_start(day), 1).cast("date")
    elif grain == "year":
        start, end = year_start(year), year_start(year + 1)
    else:
        raise ValueError(f"unknown temporal grain {grain!r}")
    return (
        F.coalesce(start, year_start(year)),
        F.coalesce(end, year_start(year + 1)),
    )


def clip_end(end: Column, cutoff: date | Column, provisional: bool) -> Column:
    """Last bucket of a provisional release ends the day after its cutoff."""
    if not provisional:
        return end
    day = F.lit(cutoff) if isinstance(cutoff, date) else cutoff
    return F.least(end, F.date_add(day, 1))


def date_basis(day: Column, known: str, year_only: str) -> Column:
    return F.when(day.isNull(), year_only).otherwise(known)


def control_period(year: Column, month: Column) -> tuple[Column, Column, Column]:
    """Monthly period when a month is given, else the whole year, with its basis tag."""
    first = month_of(year.cast("int"), F.coalesce(month.cast("int"), F.lit(1)))
    end = F.when(month.isNull(), F.add_months(first, 12)).otherwise(F.add_months(first, 1))
    basis = F.when(month.isNull(), "birth_occurrence_year").otherwise("birth_occurrence_month")
    return first, end.cast("date"), basis


def frequency_end(day: Column, frequency: str) -> Column:
    """End of the calendar period that starts on ``day``; null when ``day`` does not start one."""
    if frequency == "DAILY":
        return F.date_add(day, 1)
    months = FREQUENCY_MONTHS[frequency]
    aligned = (F.dayofmonth(day) == 1) & ((F.month(day) - 1) % months == 0)
    return F.when(aligned, F.add_months(day, months).cast("date"))


def strict_dmy(col: Column) -> Column:
    """``DD-MM-YYYY`` only; anything else is null."""
    return F.when(col.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(col, "dd-MM-yyyy"))


def strict_iso(col: Column) -> Column:
    """``YYYY-MM-DD`` only; anything else is null."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def registration_time(col: Column) -> Column:
    """ISO-like registration text as a timestamp; null when it is not ISO-like."""
    return F.when(
        col.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ][0-9:.+-]+Z?)?$"),
        col.try_cast("timestamp_ntz"),
    )


def int_date(col: Column) -> Column:
    """Calendar date of a yyyymmdd integer; null for sentinels and impossible dates."""
    text = F.lpad(col.cast("string"), 8, "0")
    return F.when(
        col.between(10101, 99991230) & ~col.isin(NO_DATE, OPEN_DATE),
        F.try_to_date(text, "yyyyMMdd"),
    )


def int_date_ok(col: Column, *, zero: bool = False, open_end: bool = False) -> Column:
    allowed = F.lit(False)
    if zero:
        allowed = allowed | (col == NO_DATE)
    if open_end:
        allowed = allowed | (col == OPEN_DATE)
    day = F.try_to_date(F.lpad(col.cast("string"), 8, "0"), "yyyyMMdd")
    return F.coalesce(allowed | ((col >= 10101) & day.isNotNull()), F.lit(False))


def census_instant(year: int = 2024) -> tuple[date, date]:
    """Reference day of the census and the day after."""
    return date(year, 4, 16), date(year, 4, 17)


def population_instant(year: Column) -> tuple[Column, Column]:
    day = F.make_date(year.cast("int"), F.lit(6), F.lit(30))
    return day, F.date_add(day, 1)


def population_role(year: Column, historical_end_year: int) -> Column:
    return F.when(year <= historical_end_year, "observed_fact").otherwise("external_projection")


def age_at(birth: Column, when: Column) -> Column:
    """Difference in years + months/12 + days/365.25 between two yyyymmdd integers."""
    year = lambda c: F.floor(c / 10000)
    month = lambda c: F.floor(c / 100) % 100
    return (
        (year(when) - year(birth))
        + (month(when) - month(birth)) / F.lit(12.0)
        + (when % 100 - birth % 100) / F.lit(365.25)
    )


def round_half_up(col: Column) -> Column:
    return F.floor(col + F.lit(0.5))


def in_interval(day: Column, start: Column, end: Column) -> Column:
    """Half-open membership; a null end is open."""
    return (day >= start) & (end.isNull() | (day < end))
