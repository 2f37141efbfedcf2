"""Numeric expressions: ages, scaling, bands, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.contracts import RATE_QUOTE_TYPES

# fixed values: unit of each source age type
AGE_UNITS = {
    "1": "completed_years",
    "2": "completed_months",
    "3": "completed_days",
    "4": "completed_hours",
}
AGE_UNKNOWN = "source_age_unknown"


def known(col: Column) -> Column:
    """NaN and null are one missing value."""
    return F.nanvl(col, F.lit(None).cast("double"))


def with_known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with every missing value of the columns that are there as null: NaN does not stay apart in a key."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: known(F.col(c)) for c in columns if kinds.get(c) in ("double", "float")})


def finite(col: Column) -> Column:
    """True for a present, finite number."""
    value = col.cast("double")
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False)
    )


def integral(col: Column) -> Column:
    return finite(col) & (col == F.floor(col))


def death_age(grain: str, age_type: Column, age_count: Column) -> dict[str, Column]:
    """Age columns of a death at one of the grains source_reported, completed_year, all."""
    none = F.lit(None)
    if grain == "all":
        return {
            "age_lower": none.cast("double"),
            "age_upper": none.cast("double"),
            "age_measure_unit": none.cast("string"),
            "age_quantity": none.cast("double"),
        }
    if grain not in ("source_reported", "completed_year"):
        raise ValueError(f"unknown age grain {grain!r}")
    kind, text = F.trim(age_type), F.trim(age_count)
    count = text.try_cast("int")
    years = (kind == "1") & (text != "")
    below_one = kind.isin("2", "3", "4") & (text != "")
    lower = F.when(years, count.cast("double")).when(below_one, 0.0)
    upper = F.when(years, (count + 1).cast("double")).when(below_one, 1.0)
    if grain == "completed_year":
        unit = F.when(years | below_one, "completed_years").otherwise(AGE_UNKNOWN)
        quantity = lower
    else:
        unit = F.lit(AGE_UNKNOWN)
        for code, name in AGE_UNITS.items():
            unit = F.when(kind == code, name).otherwise(unit)
        quantity = F.when(years | below_one, count.cast("double"))
    return {
        "age_lower": lower,
        "age_upper": upper,
        "age_measure_unit": unit,
        "age_quantity": quantity,
    }


def quoted_value(value: Column, quote_type: Column) -> Column:
    """Yields and swap rates are published in percent; every other quote is kept as is."""
    return F.when(quote_type.isin(*RATE_QUOTE_TYPES), value / 100).otherwise(value)


def band_multiplier(
    age: Column, lower: float, upper: float, factor: float, *, reduction: bool = False
) -> Column:
    """``factor`` inside [lower, upper), one elsewhere. A reduction must not exceed one."""
    if lower < 0 or upper <= lower or factor <= 0 or (reduction and factor > 1):
        raise ValueError("invalid age band or factor")
    return F.when((age >= lower) & (age < upper), factor).otherwise(1.0)


def in_bin(age: Column, lower: Column, upper: Column) -> Column:
    """``lower <= age < upper``; a null upper is open, a missing or infinite age is outside."""
    inside = finite(age) & (age >= lower) & (upper.isNull() | (age < upper))
    return F.coalesce(inside, F.lit(False))


def close_bin(upper: Column, end: float) -> Column:
    return F.coalesce(upper, F.lit(float(end)))


def density(count: Column, lower: Column, upper: Column) -> Column:
    return count / (upper - lower)


def monthly_exposure(stock: Column) -> Column:
    return stock / 12


def choose(value: Column, edges: Sequence[tuple[float, float | None]]) -> Column:
    """Index of the single bin of a fixed list that holds ``value``, null when not exactly one."""
    hits = [
        F.when(in_bin(value, F.lit(float(lo)), F.lit(None if hi is None else float(hi))), F.lit(i))
        for i, (lo, hi) in enumerate(edges)
    ]
    matches = sum((F.when(h.isNotNull(), 1).otherwise(0) for h in hits), F.lit(0))
    return F.when(matches == 1, F.coalesce(*hits))
