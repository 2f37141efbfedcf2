"""Unit algebra, composed text and united provenance: results and refusals."""

from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factspan.contracts import UNIT_DIMENSION
from factspan.functions import identity, text
from factspan.operators import exposure, units
from factspan.operators.rules import ContractViolation
from factspan.plans import batch

SURFACE = "age int, value double, unit string, population_basis string"


def surface(spark, unit, *values, basis="resident_estimate"):
    return spark.createDataFrame([(i, v, unit, basis) for i, v in enumerate(values)], SURFACE)


def test_exponents_follow_the_spelling():
    at = {b: i for i, (b, _, _) in enumerate(units.BASES)}
    got = units.exponents("microgram / meter ** 3")
    assert got[at["microgram"]] == 1 and got[at["meter"]] == -3 and sum(map(abs, got)) == 4
    assert units.exponents("1 / month")[at["month"]] == -1
    assert not any(units.exponents("dimensionless"))
    with pytest.raises(ValueError, match="unknown unit"):
        units.exponents("furlong / year")


def test_dimensions_agree_with_the_table(spark):
    names = [*UNIT_DIMENSION, None, "unheard of"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in df.select("a", "b", (units.dimension(units.vector(F.col("a"))) == units.dimension(units.vector(F.col("b")))).alias("same")).collect():
        if r["a"] in UNIT_DIMENSION and r["b"] in UNIT_DIMENSION:
            assert r["same"] == (UNIT_DIMENSION[r["a"]] == UNIT_DIMENSION[r["b"]])
    for r in df.select("a", units.named(units.vector(F.col("a"))).alias("n")).distinct().collect():
        assert r["n"] == (r["a"] if r["a"] in UNIT_DIMENSION else None)


@pytest.mark.parametrize("use", [lambda d: d.count(), lambda d: d.collect(), lambda d: d.select("age").distinct().count()])
def test_units_and_bases_are_refused_whatever_is_asked(spark, use):
    yearly, lived = surface(spark, "1 / year", 0.5, 0.25), surface(spark, "person * year", 10.0, 8.0)
    good = exposure.rate_times_exposure(yearly, lived, ["age"])
    assert [(r["value"], r["unit"]) for r in good.orderBy("age").collect()] == [(5.0, "person"), (2.0, "person")]
    monthly = surface(spark, "1 / month", 0.5, 0.25)
    for bad, message in (
        (lambda: exposure.rate_times_exposure(monthly, lived, ["age"]), "not a count"),
        (lambda: exposure.rate_sum(yearly, monthly, ["age"]), "different units"),
        (lambda: exposure.rate_times_exposure(lived, lived, ["age"]), "does not fit a rate"),
        (lambda: exposure.rate_times_exposure(yearly, yearly, ["age"]), "does not fit a exposure"),
        (lambda: exposure.rate_times_exposure(yearly, surface(spark, "person * year", 1.0, 2.0, basis="pensioner"), ["age"]), "bases differ"),
        (lambda: units.converted(lived, "1 / year"), "cannot be converted"),
        (lambda: exposure.rate_sum(yearly, yearly.where("age = 0"), ["age"]), "not aligned"),
        (lambda: exposure.rate_sum(yearly, surface(spark, None, 1.0, 2.0), ["age"]), "does not fit"),
    ):
        with pytest.raises(Exception, match=message):
            use(bad())
    with pytest.raises(ValueError, match="none does"):
        exposure.rate_sum(yearly, yearly.drop("unit"), ["age"])


def test_conversion_and_rates(spark):
    monthly = surface(spark, "1 / month", 0.5, None)
    year = units.converted(monthly, "1 / year")
    assert [(r["value"], r["unit"]) for r in year.orderBy("age").collect()] == [(6.0, "1 / year"), (None, "1 / year")]
    back = units.converted(year, "1 / month").orderBy("age").first()
    assert math.isclose(back["value"], 0.5)
    rate = exposure.counts_over_exposure(surface(spark, "person", 3.0), surface(spark, "person * year", 6.0), ["age"]).first()
    assert (rate["value"], rate["unit"]) == (0.5, "1 / year")


def test_exposed_by_age_keeps_a_null_table_key(spark):
    spells = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("m", 0, 0), (None, 2, 2)], "sex string, lower_age int, upper_age int")
    got = {(r["sex"], r["age"]): r["exposed"] for r in exposure.exposed_by_age(spells, ["sex"], support=(0, 3)).collect()}
    assert got == {(None, 0): 0, (None, 1): 1, (None, 2): 3, (None, 3): 1, ("m", 0): 1, ("m", 1): 0, ("m", 2): 0, ("m", 3): 0}


def test_composed_text_and_maps(spark):
    df = spark.createDataFrame([("é", "x"), ("é", None), (None, "ño"), ("plain", "x")], "a string, b string")
    got = sorted(map(tuple, text.composed(df, ["a", "b"]).collect()), key=repr)
    assert got == sorted([("é", "x"), ("é", None), (None, "ño"), ("plain", "x")], key=repr)
    plain = df.where("a = 'plain'")
    assert text.composed(plain, ["a", "b"]) is plain  # nothing to compose: no join
    maps = spark.createDataFrame([({"é": "ñ", "b": None},), ({"k": "v"},), (None,), ({},)], "m map<string,string>")
    got = [r[0] for r in maps.select(text.composed_map(F.col("m"))).collect()]
    assert got == [{"é": "ñ", "b": None}, {"k": "v"}, None, {}]
    clash = spark.createDataFrame([({"é": "1", "é": "2"},)], "m map<string,string>")
    with pytest.raises(Exception, match="compose to one"):
        clash.select(text.composed_map(F.col("m"))).collect()


SOURCE = ("name", None, date(2024, 1, 1), None, datetime(2024, 2, 1))


def provenance(spark, *rows):
    out = []
    for position, role, keys, rules, notes in rows:
        sources = [(k, *SOURCE, sha * 64, "v", False) for k, sha in keys]
        out.append(("g", position, role, sources, "r", datetime(2024, 1 + position, 1), date(2020 - position, 1, 1),
                    date(2021 + position, 1, 1), ["x"], rules, f"no {role}", ["t", "rate-v1"][: position + 1], notes))
    kind = "g string, position int, role string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.PROVENANCE.fields)
    return spark.createDataFrame(out, kind).repartition(4)


def test_provenance_is_united_in_the_order_of_first_appearance(spark):
    rows = provenance(
        spark, (1, "exposure", [("b", "2"), ("a", "1")], ["mean", "sum"], None), (0, "deaths", [("z", "3"), ("a", "1")], ["sum", "count"], ["n", None]),
    )
    got = batch.derived_provenance(rows, ["g"], "position", ["age", "year"], "divide", "rate-v1", "derived missing").first()
    assert [s["source_key"] for s in got["sources"]] == ["z", "a", "b"]
    assert got["aggregation_rules"] == ["sum", "count", "mean", "divide"]
    assert got["transformation_ids"] == ["t", "rate-v1"] and got["notes"] == ["n"] and got["dimensions"] == ["age", "year"]
    assert got["missingness_reason"] == "deaths=no deaths; exposure=no exposure; derived missing"
    assert (got["available_at"], got["observation_start"], got["observation_end"]) == (datetime(2024, 2, 1), date(2019, 1, 1), date(2022, 1, 1))
    assets = F.array(*[F.struct(F.lit(k).alias("source_key"), F.lit(s * 64).alias("sha256")) for k, s in (("a", "1"), ("b", "2"), ("z", "3"))])
    assert got["release_id"] == spark.range(1).select(identity.release_id(assets)).first()[0]
    clash = provenance(spark, (0, "deaths", [("a", "1")], [], []), (1, "exposure", [("a", "2")], [], []))
    with pytest.raises(Exception, match="two artifacts"):
        batch.derived_provenance(clash, ["g"], "position", [], "divide", "rate-v1", "").count()


def test_a_batch_of_two_releases_does_not_pass(spark):
    from factspan.operators.rules import require
    from factspan.operators.rulesets import one_release_report

    kind = "domain string, release_id string, available_at timestamp"
    two = spark.createDataFrame([("d", r, datetime(2024, 1, 1)) for r in ("a", "a", "b")], kind)
    with pytest.raises(ContractViolation, match="one_release_batch"):
        require(one_release_report(two))
    require(one_release_report(two.where("release_id = 'a'")))
