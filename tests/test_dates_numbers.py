from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from factspan.functions import dates, numbers, structures

X = F.col("x")
DAY = F.lit(date(2024, 2, 3))


@pytest.mark.parametrize(
    ("grain", "start", "end"),
    [
        ("day", date(2024, 2, 3), date(2024, 2, 4)),
        ("month", date(2024, 2, 1), date(2024, 3, 1)),
        ("year", date(2024, 1, 1), date(2025, 1, 1)),
    ],
)
def test_period(one, grain, start, end):
    a, b = dates.period(grain, DAY, F.lit(2024))
    assert (one(a), one(b)) == (start, end)


def test_missing_day_is_the_whole_year_and_is_clipped(one):
    none = F.lit(None).cast("date")
    a, b = dates.period("day", none, F.lit(2024))
    assert (one(a), one(b)) == (date(2024, 1, 1), date(2025, 1, 1))
    assert one(dates.clip_end(b, date(2024, 7, 7), True)) == date(2024, 7, 8)
    assert one(dates.clip_end(b, date(2024, 7, 7), False)) == date(2025, 1, 1)


def test_control_period(one):
    a, b, c = dates.control_period(F.lit(2024), F.lit(12))
    assert (one(a), one(b), one(c)) == (
        date(2024, 12, 1), date(2025, 1, 1), "birth_occurrence_month",
    )
    a, b, c = dates.control_period(F.lit(2024), F.lit(None).cast("int"))
    assert (one(a), one(b), one(c)) == (
        date(2024, 1, 1), date(2025, 1, 1), "birth_occurrence_year",
    )


def test_frequency_end(one):
    assert one(dates.frequency_end(F.lit(date(2024, 4, 1)), "QUARTERLY")) == date(2024, 7, 1)
    assert one(dates.frequency_end(F.lit(date(2024, 5, 1)), "QUARTERLY")) is None
    assert one(dates.frequency_end(F.lit(date(2024, 5, 2)), "MONTHLY")) is None
    assert one(dates.frequency_end(F.lit(date(2024, 1, 1)), "ANNUAL")) == date(2025, 1, 1)


def test_strict_text_dates(one):
    assert one(dates.strict_dmy(X), x="01-02-2024") == date(2024, 2, 1)
    for bad in ("1-2-2024", "31-02-2024", "2024-02-01", ""):
        assert one(dates.strict_dmy(X), x=bad) is None
    assert one(dates.strict_iso(X), x="2024-02-30") is None
    assert one(dates.registration_time(X), x="2024-02-01T10:00:00") is not None
    assert one(dates.registration_time(X), x="yesterday") is None


@pytest.mark.parametrize(
    ("value", "ok"),
    [(20240229, True), (20230229, False), (0, False), (99991231, True), (20241301, False),
     (20240100, False)],
)
def test_int_date(one, value, ok):
    assert one(dates.int_date_ok(X), x=value) is ok


def test_sentinels(one):
    assert one(dates.int_date_ok(X, zero=True), x=0)
    assert one(dates.int_date(X), x=99991231) is None
    assert one(dates.int_date(X), x=20240229) == date(2024, 2, 29)


def test_rounding_is_half_up(one):
    assert one(dates.round_half_up(F.lit(2.5))) == 3
    assert one(dates.round_half_up(F.lit(-0.5))) == 0


def test_interval_membership(one):
    start, end = F.lit(date(2024, 1, 1)), F.lit(date(2024, 2, 3))
    assert not one(dates.in_interval(DAY, start, end))
    assert one(dates.in_interval(DAY, start, F.lit(None).cast("date")))


@pytest.mark.parametrize(
    ("grain", "kind", "count", "expected"),
    [
        ("source_reported", "2", "11", (0.0, 1.0, "completed_months", 11.0)),
        ("source_reported", "1", "99", (99.0, 100.0, "completed_years", 99.0)),
        ("source_reported", "1", "", (None, None, "completed_years", None)),
        ("source_reported", "", "5", (None, None, "source_age_unknown", None)),
        ("completed_year", "4", "3", (0.0, 1.0, "completed_years", 0.0)),
        ("completed_year", "0", "3", (None, None, "source_age_unknown", None)),
        ("all", "1", "3", (None, None, None, None)),
    ],
)
def test_death_age(spark, grain, kind, count, expected):
    columns = numbers.death_age(grain, F.lit(kind), F.lit(count))
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    assert tuple(row) == expected


def test_quoted_value(one):
    assert one(numbers.quoted_value(F.lit(5.0), F.lit("benchmark_yield"))) == 0.05
    assert one(numbers.quoted_value(F.lit(5.0), F.lit("published_change"))) == 5.0


def test_bin_membership(one):
    none = F.lit(None).cast("double")
    assert one(numbers.in_bin(F.lit(5.0), F.lit(5.0), F.lit(6.0)))
    assert not one(numbers.in_bin(F.lit(6.0), F.lit(5.0), F.lit(6.0)))
    assert one(numbers.in_bin(F.lit(600.0), F.lit(5.0), none))
    for bad in (float("nan"), float("inf")):
        assert one(numbers.in_bin(F.lit(bad), F.lit(5.0), none)) is False
    assert one(numbers.in_bin(none, F.lit(5.0), none)) is False


def test_choose_needs_exactly_one_bin(one):
    assert one(numbers.choose(F.lit(7.0), [(0, 5), (5, None)])) == 1
    assert one(numbers.choose(F.lit(7.0), [(0, 8), (5, None)])) is None
    assert one(numbers.choose(F.lit(-1.0), [(0, 8)])) is None


def test_multiplier_bounds(one):
    assert one(numbers.band_multiplier(F.lit(20), 15, 35, 1.2)) == 1.2
    assert one(numbers.band_multiplier(F.lit(35), 15, 35, 1.2)) == 1.0
    with pytest.raises(ValueError):
        numbers.band_multiplier(F.lit(1), 0, 5, 1.2, reduction=True)
    with pytest.raises(ValueError):
        numbers.band_multiplier(F.lit(1), 5, 5, 1.0)


def test_reasons_json(one):
    made = structures.reasons_json(
        {"b": "always", "a": F.when(X == "1", "given"), "c": None}
    )
    assert one(made, x="1") == '{"a":"given","b":"always"}'
    assert one(made, x="2") == '{"b":"always"}'


def test_display_json_keeps_nulls(one):
    made = structures.display_json({"b": F.lit(None).cast("string"), "a": F.lit("ñ")})
    assert one(made) == '{"a":"ñ","b":null}'


def test_exact_object(one):
    assert one(structures.exact_object(X, ["a", "b"]), x='{"b":1,"a":2}')
    for bad in ('{"a":1}', '{"a":1,"b":2,"a":3}', '{"a":1,"b":2,"c":3}', "[1]", "x"):
        assert not one(structures.exact_object(X, ["a", "b"]), x=bad)


def test_array_helpers(one):
    left, right = F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))
    assert one(structures.ordered_union(left, right)) == ["b", "a", "c"]
    assert one(structures.append_once(left, "a")) == ["b", "a"]
    assert one(structures.append_once(left, "z")) == ["b", "a", "z"]
