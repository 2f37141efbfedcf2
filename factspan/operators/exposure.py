"""Exposure, rates and algebra on aligned tidy tables.

An aligned operation needs the same coordinates on both sides; a one-sided row fails the
query instead of disappearing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspan.contracts import UNIT_DIMENSION
from factspan.functions.numbers import finite, known
from factspan.operators import units
from factspan.operators.reconcile import key_difference, null_safe_join
from factspan.operators.rules import Rule, check_absent, check_constant, check_unique, enforce_each, report


def aligned(
    left: DataFrame,
    right: DataFrame,
    dims: Sequence[str],
    value: Mapping[str, Column],
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """Full outer null-safe join on all coordinates; ``value`` sees ``left`` and ``right``.

    Each input is (dims, value).
    """
    a = left.select(*dims, F.col("value").alias(names[0]), F.lit(True).alias("__in_left"))
    b = right.select(*dims, F.col("value").alias(names[1]), F.lit(True).alias("__in_right"))
    both = F.col("__in_left").isNotNull() & F.col("__in_right").isNotNull()
    joined = enforce_each(null_safe_join(a, b, dims, "full_outer"), both, "coordinates are not aligned")
    return joined.select(*dims, *[column.alias(name) for name, column in value.items()])


def central_rate(deaths: DataFrame, exposure: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Deaths over exposure on the same coordinates; null where either is missing."""
    ratio = F.col("deaths") / F.col("exposure")
    return aligned(
        deaths,
        exposure,
        dims,
        {"deaths": F.col("deaths"), "exposure": F.col("exposure"), "rate": ratio},
        ("deaths", "exposure"),
    )


def _typed(*surfaces: DataFrame) -> bool:
    """Whether surfaces carry ``unit`` and ``population_basis``: all of them or none."""
    held = {("unit" in s.columns, "population_basis" in s.columns) for s in surfaces}
    if held == {(True, True)}:
        return True
    if held == {(False, False)}:
        return False
    raise ValueError("either all surfaces carry unit and population_basis, or none does")


def _combined(
    left: DataFrame, right: DataFrame, dims: Sequence[str], value: Column, unit: Column, holds: Column, message: str
) -> DataFrame:
    """Aligned surfaces with units: ``holds`` over left_unit and right_unit is checked on every row."""
    pack = lambda s: s.select(*dims, F.struct("value", "unit", "population_basis").alias("value"))
    both = aligned(pack(left), pack(right), dims, {"__l": F.col("left"), "__r": F.col("right")})
    both = both.select(
        *dims, F.col("__l.value").alias("left"), F.col("__r.value").alias("right"),
        F.col("__l.unit").alias("left_unit"), F.col("__r.unit").alias("right_unit"),
        F.col("__l.population_basis").alias("population_basis"), F.col("__r.population_basis").alias("__basis"),
    )
    both = enforce_each(both, F.col("population_basis") == F.col("__basis"), "population bases differ")
    both = enforce_each(both, holds, message)
    return both.select(*dims, value.alias("value"), unit.alias("unit"), "population_basis")


def rate_times_exposure(rate: DataFrame, exposure: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Expected counts on aligned cells.

    Surfaces with ``unit`` and ``population_basis`` are checked row by row: the units' product must
    be a person, so a rate per month times person-years fails until it is ``units.converted``.
    """
    value = F.col("left") * F.col("right")
    if not _typed(rate, exposure):
        return aligned(rate, exposure, dims, {"value": value})
    made = units.product(units.vector(F.col("left_unit")), units.vector(F.col("right_unit")))
    count = made == units.vector(F.lit("person"))
    return _combined(
        units.declared(rate, "rate"), units.declared(exposure, "exposure"), dims, value, units.named(made), count,
        "rate times exposure is not a count of persons",
    )


def rate_sum(first: DataFrame, second: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Sum of aligned rates; with units, of the same unit and population basis only."""
    value = F.col("left") + F.col("right")
    if not _typed(first, second):
        return aligned(first, second, dims, {"value": value})
    same = F.col("left_unit") == F.col("right_unit")
    return _combined(
        units.declared(first, "rate"), units.declared(second, "rate"), dims, value, F.col("left_unit"), same,
        "rates of different units cannot be added",
    )


def counts_over_exposure(counts: DataFrame, exposure: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rates on aligned cells from counts and exposure with units: persons over person-years are 1 / year."""
    _typed(counts, exposure)
    made = units.quotient(units.vector(F.col("left_unit")), units.vector(F.col("right_unit")))
    rate = units.dimension(made) == units.dimension(units.vector(F.lit("1 / year")))
    return _combined(
        units.declared(counts, "count"), units.declared(exposure, "exposure"), dims,
        F.col("left") / F.col("right"), units.named(made), rate, "counts over exposure are not a rate",
    )


def scaled(surface: DataFrame, factor: float) -> DataFrame:
    return surface.withColumn("value", F.col("value") * F.lit(float(factor)))


def annual_exposure(
    stocks: DataFrame, dims: Sequence[str], year: str = "year", value: str = "value"
) -> DataFrame:
    """Mean of each year's stock and the next one's; the last year gives no row.

    A gap between years fails the query. One row per (dims, year), so the window holds
    the years of one cell.
    """
    w = Window.partitionBy(*dims).orderBy(year)
    following, next_year = F.lead(value).over(w), F.lead(year).over(w)
    gap = F.raise_error(F.lit("years are not consecutive"))
    mean = F.when(F.col("__next") - F.col(year) == 1, (F.col(value) + F.col("__following")) * 0.5)
    return (
        stocks.withColumns({"__following": following, "__next": next_year})
        .where(F.col("__next").isNotNull())
        .select(
            *dims,
            year,
            F.when(F.col("__next") - F.col(year) == 1, mean).otherwise(gap).alias("exposure"),
        )
    )


def requested_years(exposure: DataFrame, years: Sequence[int], year: str = "year") -> DataFrame:
    return exposure.where(F.col(year).isin(*years))


def exposed_by_age(
    spells: DataFrame,
    table: Sequence[str],
    lower: str = "lower_age",
    upper: str = "upper_age",
    support: tuple[int, int] = (0, 110),
    weight: str | None = None,
) -> DataFrame:
    """Persons present at every age, from inclusive age spells, by a sweep line.

    Spells are first counted by (table, lower, upper); each distinct spell opens at its
    lower age and closes after its upper one. A running sum over the age grid gives the
    exposure: persons are never written out per age.
    """
    lo, hi = support
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    clipped = spells.select(
        *table,
        F.greatest(F.col(lower), F.lit(lo)).cast("int").alias("__lo"),
        F.least(F.col(upper), F.lit(hi)).cast("int").alias("__hi"),
        *([] if weight is None else [weight]),
    ).where("__lo <= __hi")
    distinct = clipped.groupBy(*table, "__lo", "__hi").agg(number.alias("__n"))
    steps = F.array(
        F.struct(F.col("__lo").alias("age"), F.col("__n").alias("__d")),
        F.struct((F.col("__hi") + 1).alias("age"), (-F.col("__n")).alias("__d")),
    )
    changes = (
        distinct.select(*table, F.inline(steps)).groupBy(*table, "age").agg(F.sum("__d").alias("__d"))
    )
    tables = distinct.select(*table).distinct()
    grid = tables.withColumn("age", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    running = Window.partitionBy(*table).orderBy("age").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        null_safe_join(grid, changes, [*table, "age"], "left")
        .withColumn("exposed", F.sum(F.coalesce("__d", F.lit(0))).over(running).cast("bigint"))
        .select(*table, "age", "exposed")
    )


def deaths_by_age(
    spells: DataFrame,
    table: Sequence[str],
    age: str = "death_age",
    lower: str = "lower_age",
    upper: str = "upper_age",
    support: tuple[int, int] = (0, 110),
    weight: str | None = None,
) -> DataFrame:
    """Deaths whose age lies inside the spell and the age support."""
    inside = (
        F.col(age).isNotNull()
        & (F.col(age) >= F.greatest(F.col(lower), F.lit(support[0])))
        & (F.col(age) <= F.least(F.col(upper), F.lit(support[1])))
    )
    return (
        spells.where(inside)
        .groupBy(*table, F.col(age).cast("int").alias("age"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("deaths"))
    )


def stock_rules() -> list[Rule]:
    value = known(F.col("value"))
    return [Rule("stock_nonnegative", value.isNull() | (finite(value) & (value >= 0)))]


def death_rules() -> list[Rule]:
    value = known(F.col("value"))
    return [
        Rule(
            "deaths_whole_nonnegative",
            value.isNull() | (finite(value) & (value >= 0) & (value == F.floor(value))),
        )
    ]


def exposure_rules() -> list[Rule]:
    value = known(F.col("value"))
    return [Rule("exposure_positive", value.isNull() | (finite(value) & (value > 0)))]


def surface_report(
    surface: DataFrame, dims: Sequence[str], kind: str, unit: str, basis: str
) -> DataFrame:
    """One value per coordinate, and one declared kind, unit and population basis."""
    declared = surface.where(
        ~(
            F.col("semantic_kind").eqNullSafe(kind)
            & F.col("unit").eqNullSafe(unit)
            & F.col("population_basis").eqNullSafe(basis)
        )
    )
    return report(
        check_unique(surface, dims, "coordinate_unique"),
        check_absent(declared, "semantics_declared"),
        check_constant(surface, ("semantic_kind", "unit", "population_basis"), "one_semantics"),
    )


def same_dimension(left: str, right: str) -> bool:
    """Units of one physical dimension (1 / month and 1 / year are)."""
    return UNIT_DIMENSION[left] == UNIT_DIMENSION[right]


def require_unit(kind: str, unit: str, *, annual: bool = False) -> None:
    """Unit a surface must carry: rates per time, exposure in person-years, counts in persons."""
    wanted = {"rate": "1 / year", "exposure": "person * year", "count": "person"}[kind]
    if not same_dimension(unit, wanted) or (annual and unit != "1 / year"):
        raise ValueError(f"unit {unit!r} does not fit a {kind} surface")


def add_variable(
    cube: DataFrame, variable: DataFrame, dims: Sequence[str], name: str = "variable"
) -> DataFrame:
    """Add a variable's cells to a cube (one row per cell).

    Shared dimensions must hold the same coordinates and the name must be new; either
    breach fails the query.
    """
    checks = [
        key_difference(cube.select(d).distinct(), variable.select(d).distinct(), [d]).select(
            F.lit(d).alias("breach")
        )
        for d in dims
    ]
    taken = cube.select(name).distinct().join(variable.select(name).distinct(), name, "left_semi")
    checks.append(taken.select(F.lit("name taken").alias("breach")))
    breaches = reduce(DataFrame.unionAll, checks).groupBy("breach").count()
    first = breaches.limit(1).collect()
    if first:
        raise ValueError(f"variable does not fit the cube: {first[0]['breach']}")
    return cube.unionByName(variable)


def select_cells(cube: DataFrame, **labels: object) -> DataFrame:
    """Cells with the given labels."""
    for name, label in labels.items():
        cube = cube.where(F.col(name).eqNullSafe(F.lit(label)))
    return cube


def scenario_events(
    rates: DataFrame,
    scenarios: Sequence[tuple[str, Column, float]],
    rate: str = "rate",
    exposure: str = "exposure",
) -> DataFrame:
    """Expected events per scenario: rate x period scale x age multiplier x exposure.

    A scenario is (name, multiplier expression of the row, period scale); rows are
    repeated per scenario by a projection.
    """
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                (F.col(rate) * F.lit(float(scale)) * multiplier * F.col(exposure)).alias("expected"),
            )
            for name, multiplier, scale in scenarios
        ]
    )
    return rates.select("*", F.inline(lines))
