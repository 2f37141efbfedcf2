"""Units as exponent vectors: multiplied, compared and converted as columns.

A unit is a product of powers of base units. As a column it is an array with one exponent per base
unit, so the product of two units is the sum of their arrays, and units that only share their
physical dimension (1 / month and 1 / year) stay apart until they are converted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.contracts import SEMANTIC_TRIPLES, UNIT_DIMENSION
from factspan.operators.rules import enforce_each

# fixed values: base unit, its physical dimension, its size in the first unit of that dimension
BASES = (
    ("year", "time", 1.0),
    ("month", "time", 1.0 / 12),
    ("day", "time", 1.0 / 365.25),
    ("person", "person", 1.0),
    ("event", "event", 1.0),
    ("degree_Celsius", "temperature", 1.0),
    ("meter", "length", 1.0),
    ("millimeter", "length", 1e-3),
    ("microgram", "mass", 1.0),
    ("CLP", "currency CLP", 1.0),
    ("UF", "currency UF", 1.0),
    ("percent", "", 0.01),
    ("dimensionless", "", 1.0),
)
DIMENSIONS = tuple(dict.fromkeys(d for _, d, _ in BASES if d))
_PURE = ("dimensionless",)


def exponents(unit: str) -> tuple[int, ...]:
    """Exponent per base unit of a unit spelled with ``*``, ``/`` and ``**``."""
    found, sign = dict.fromkeys((b for b, _, _ in BASES), 0), 1
    words = unit.replace("**", "^").split()
    at = 0
    while at < len(words):
        word = words[at]
        if word in "*/":
            sign = 1 if word == "*" else -1
        elif word == "^":
            found[words[at - 1]] += sign * (int(words[at + 1]) - 1)
            at += 1
        elif word in found:
            found[word] += sign
        elif word != "1":
            raise ValueError(f"unknown unit {word!r} in {unit!r}")
        at += 1
    return tuple(0 if b in _PURE else n for b, n in found.items())


def _literal(unit: str) -> Column:
    return F.array(*map(F.lit, exponents(unit)))


def vector(unit: Column, units: Sequence[str] = tuple(UNIT_DIMENSION)) -> Column:
    """Exponents of a unit named in a column; null for a unit that is not among ``units``."""
    known = F.create_map(*(x for u in units for x in (F.lit(u), _literal(u))))
    return F.when(unit.isNotNull(), F.element_at(known, unit))


def product(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b)


def quotient(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a - b)


def dimension(exponent: Column) -> Column:
    """Exponent per physical dimension."""
    return F.array(
        *[sum((exponent[i] for i, (_, of, _) in enumerate(BASES) if of == d), F.lit(0)) for d in DIMENSIONS]
    )


def size(exponent: Column) -> Column:
    """How many units of the first unit of every dimension the unit makes."""
    powers = [F.pow(F.lit(one), exponent[i]) for i, (_, _, one) in enumerate(BASES) if one != 1.0]
    return reduce(lambda a, b: a * b, powers)


def named(exponent: Column, units: Sequence[str] = tuple(UNIT_DIMENSION)) -> Column:
    """The unit's name; null for a product that has none here."""
    spelled = {",".join(map(str, exponents(u))): u for u in units}
    known = F.create_map(*(F.lit(x) for pair in spelled.items() for x in pair))
    return F.element_at(known, F.array_join(exponent.cast("array<string>"), ","))


def declared(surface: DataFrame, kind: str) -> DataFrame:
    """``surface`` (value, unit, population_basis), failing on a row whose unit and basis do not fit ``kind``."""
    fits = reduce(
        lambda a, b: a | b,
        [(F.col("unit") == u) & (F.col("population_basis") == b) for k, u, b in SEMANTIC_TRIPLES if k == kind],
        F.lit(False),
    )
    return enforce_each(surface, fits, f"unit or population basis does not fit a {kind}")


def converted(surface: DataFrame, unit: str) -> DataFrame:
    """Values in ``unit``; a row of another physical dimension fails the query."""
    own, wanted = vector(F.col("unit")), _literal(unit)
    same = dimension(own) == dimension(wanted)
    checked = enforce_each(surface, same, f"a unit cannot be converted to {unit!r}")
    # a rate of 1 / month is twelve of 1 / year
    return checked.withColumns({"value": F.col("value") * (size(own) / size(wanted)), "unit": F.lit(unit)})
