"""Market series, regulatory mortality tables and pensioner reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.contracts import SERIES_SEMANTICS
from factspan.functions import dates, numbers
from factspan.operators import exposure, reconcile
from factspan.operators.rules import (
    ContractViolation,
    Rule,
    check,
    check_absent,
    check_unique,
    report,
    require,
)
from factspan.plans.batch import Release, complete, finish
from factspan.session import stage

# --- market series -------------------------------------------------------------

RATE_TRANSFORMATION = "bcch-published-percent-to-decimal-rate"


def spec_rules() -> list[Rule]:
    """A series specification carries the exact units of its quote type."""
    ok = F.lit(False)
    for quote, (unit, canonical, _, _) in SERIES_SEMANTICS.items():
        ok = ok | (
            (F.col("quote_type") == quote)
            & (F.col("source_unit") == unit)
            & (F.col("canonical_unit") == canonical)
        )
    return [Rule("series_units", ok)]


def review_rules() -> list[Rule]:
    """Reviewed series rows: dates ordered and aligned, two distinct assets, ids agree."""
    first, last = F.col("first_observation"), F.col("last_observation")
    aligned = F.lit(False)
    for frequency in ("DAILY", *dates.FREQUENCY_MONTHS):
        both = (
            dates.frequency_end(first, frequency).isNotNull()
            & dates.frequency_end(last, frequency).isNotNull()
        )
        aligned = F.when(F.col("frequency") == frequency, both).otherwise(aligned)
    return [
        Rule("series_id_matches_spec", F.col("series_id") == F.col("spec_series_id")),
        Rule("dates_ordered", first <= last),
        Rule("dates_aligned", aligned),
        Rule("assets_distinct", F.col("series_source_key") != F.col("search_source_key")),
        Rule("digest_form", F.col("digest").rlike("^[0-9a-f]{64}$")),
    ]


def market_facts(observations: DataFrame, specs: DataFrame) -> DataFrame:
    """Observations joined with their series specification, periods and values derived."""
    joined = observations.join(specs, "series_id")
    day, end = F.col("observed_on"), F.lit(None).cast("date")
    for frequency in ("DAILY", *dates.FREQUENCY_MONTHS):
        end = F.when(
            F.col("frequency") == frequency, dates.frequency_end(day, frequency)
        ).otherwise(end)
    rate = F.col("quote_type").isin("benchmark_yield", "swap_fixed_rate")
    kind, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for quote, (_, _, k, r) in SERIES_SEMANTICS.items():
        kind = F.when(F.col("quote_type") == quote, k).otherwise(kind)
        role = F.when(F.col("quote_type") == quote, r).otherwise(role)
    value = numbers.quoted_value(F.col("published"), F.col("quote_type"))
    return joined.select(
        "variable",
        value.alias("value"),
        kind.alias("semantic_kind"),
        F.col("canonical_unit").alias("unit"),
        role.alias("observation_role"),
        day.alias("period_start"),
        end.alias("period_end"),
        F.when(rate, RATE_TRANSFORMATION).alias("transformation_id"),
        F.when(rate, "v1").alias("transformation_version"),
        F.when(value.isNotNull(), "not_applicable_observed")
        .otherwise("bcch_source_observation_missing")
        .alias("missingness_reason"),
        F.col("status_code").alias("source_status_code"),
        F.col("series_id").alias("source_series_id"),
        "quote_type",
        "tenor_years",
        "currency",
        "indexation",
        "instrument_type",
        "compounding",
        "day_count",
    )


def market(
    observations: DataFrame,
    specs: DataFrame,
    release: Release,
    reference: tuple[date, date],
    source: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parsed market observations to a validated batch inside its reference interval."""
    facts = market_facts(observations, specs)
    inside = Rule(
        "inside_reference_interval",
        (F.col("period_start") >= F.lit(reference[0]))
        & (F.col("period_end") <= F.lit(reference[1])),
    )
    unknown = observations.join(specs, "series_id", "left_anti")
    require(
        check(specs, spec_rules()),
        check(facts, [inside]),
        check_absent(unknown, "series_specified"),
    )
    payload = complete(
        facts,
        "market_quote",
        {
            "domain": "market_quote",
            "population_basis": "not_applicable",
            "parity_scope": "not_applicable",
            **release.stamp(),
            "aggregation_rule": (
                "a published observation on its own date; gaps stay gaps"
            ),
            "date_basis": "market_observation",
        },
    )
    return finish(payload, "market_quote", release, source or {"source_key": release.source_key})


# --- regulatory mortality tables -----------------------------------------------


def improvement_long(wide: DataFrame, years: Sequence[int]) -> DataFrame:
    """Wide rows (table_id, age, sex, qx, one column per year) to long facts.

    Each row gives its base probability and one improvement factor per year.
    """
    lines = [
        F.struct(
            F.lit("regulatory_mortality_probability").alias("variable"),
            F.col("qx").cast("double").alias("value"),
            F.lit(None).cast("int").alias("improvement_year"),
        ),
        *[
            F.struct(
                F.lit("regulatory_mortality_improvement_factor").alias("variable"),
                F.col(str(year)).cast("double").alias("value"),
                F.lit(year).alias("improvement_year"),
            )
            for year in years
        ],
    ]
    return wide.select("table_id", "age", "sex", F.inline(F.array(*lines)))


def emitted(blocks: DataFrame) -> DataFrame:
    """Blocks that are published once; a repeated block is checked, then dropped."""
    return blocks.where(F.col("emit")).drop("emit")


def duplicate_block_report(blocks: DataFrame, copy: str, original: str) -> DataFrame:
    """A repeated block must equal its source block cell by cell."""
    cells = [c for c in blocks.columns if c not in ("block", "emit")]
    difference = reconcile.same_rows(
        blocks.where(F.col("block") == copy), blocks.where(F.col("block") == original), cells
    )
    return check_absent(difference, "duplicate_block_equal")


def mortality(
    facts: DataFrame,
    release: Release,
    expected_rows: int | None = None,
    source: Mapping[str, str] | None = None,
) -> DataFrame:
    """Long mortality facts (table_id, age, sex, variable, value, improvement_year)."""
    if expected_rows is not None and (found := facts.count()) != expected_rows:
        raise ContractViolation([("row_count", abs(found - expected_rows))])
    base = F.col("variable") == "regulatory_mortality_probability"
    year = F.when(base, 2020).otherwise(F.col("improvement_year").cast("int"))
    ready = facts.select(
        "variable",
        "value",
        F.when(base, "probability").otherwise("index").alias("semantic_kind"),
        F.when(base, "pensioner").otherwise("not_applicable").alias("population_basis"),
        dates.year_start(year).alias("period_start"),
        dates.year_start(year + 1).alias("period_end"),
        F.col("table_id").alias("mortality_table_id"),
        "age",
        "sex",
        "improvement_year",
    )
    payload = complete(
        ready,
        "regulatory_mortality_table",
        {
            "domain": "regulatory_mortality_table",
            "unit": "dimensionless",
            "observation_role": "regulatory_input",
            "parity_scope": "not_applicable",
            **release.stamp(),
            "aggregation_rule": (
                "a published probability or improvement factor, not projected"
            ),
            "missingness_reason": "not_applicable_observed",
            "regulatory_basis": "TM_2020",
            "population_segment": "pensioner",
            "reference_year": 2020,
            "effective_start": date(2023, 7, 1),
            "maximum_effective_end": date(2029, 7, 1),
        },
    )
    return finish(
        payload,
        "regulatory_mortality_table",
        release,
        source or {"source_key": release.source_key},
    )


# --- pensioner reconciliation --------------------------------------------------

# fixed values: published tables, allowed codes, period of study
TABLES = ("RV-M-2020", "CB-H-2020", "B-M-2020", "MI-M-2020", "MI-H-2020")
COMBINATIONS = (
    (1, "F", "N"),
    (2, "F", "N"),
    (3, "M", "N"),
    (4, "F", "P"),
    (4, "F", "T"),
    (4, "M", "P"),
    (4, "M", "T"),
)
RELATIONSHIPS = (10, 11, 20, 21, 30, 35, 41, 42, 50, 51, 52, 99)
FIRST_YEAR, LAST_YEAR = 2014, 2018


def pensioner_rules() -> list[Rule]:
    return [
        Rule("fields_present", ~F.expr(
            "ORIGEN IS NULL OR TABLA IS NULL OR FEC_VIG IS NULL OR FIN_EXPOSIC IS NULL OR "
            "SEXO IS NULL OR COD_REL IS NULL OR BEN_COD_INV IS NULL OR FEC_NAC IS NULL OR "
            "FEC_FALL IS NULL")),
        Rule("origin_known", F.col("ORIGEN").isin(1, 2)),
        Rule("relationship_known", F.col("COD_REL").isin(*RELATIONSHIPS)),
        Rule("pension_date_valid", dates.int_date_ok(F.col("FEC_VIG"))),
        Rule("exposure_end_valid", dates.int_date_ok(F.col("FIN_EXPOSIC"), open_end=True)),
        Rule("birth_date_valid", dates.int_date_ok(F.col("FEC_NAC"))),
        Rule("death_date_valid", dates.int_date_ok(F.col("FEC_FALL"), zero=True)),
    ]


def person_profile(rows: DataFrame) -> DataFrame:
    """Counts of rows and broken rules per (table, sex, invalidity), from one scan."""
    broken = [
        F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(f"rule:{r.id}")
        for r in pensioner_rules()
    ]
    return rows.groupBy("TABLA", "SEXO", "BEN_COD_INV").agg(
        F.count(F.lit(1)).alias("n"), *broken
    )


def person_report(profile: DataFrame, expected_rows: int) -> DataFrame:
    """Row rules, exact row count, and exactly the reviewed combinations."""
    allowed = profile.sparkSession.createDataFrame(
        list(COMBINATIONS), "TABLA int, SEXO string, BEN_COD_INV string"
    )
    difference = reconcile.key_difference(profile, allowed, ["TABLA", "SEXO", "BEN_COD_INV"])
    names = [c for c in profile.columns if c.startswith("rule:")]
    totals = profile.agg(
        *[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in names],
        F.abs(F.coalesce(F.sum("n"), F.lit(0)) - expected_rows).alias("rule:row_count"),
    )
    lines = [
        F.struct(
            F.lit(c.removeprefix("rule:")).alias("rule_id"),
            F.col(f"`{c}`").cast("bigint").alias("failed"),
            F.lit(None).cast("string").alias("sample_key"),
        )
        for c in totals.columns
    ]
    return report(
        totals.select(F.inline(F.array(*lines))), check_absent(difference, "route_combinations")
    )


def table_of(table: Column, sex: Column) -> Column:
    return (
        F.when(table == 1, "B-M-2020")
        .when(table == 2, "RV-M-2020")
        .when(table == 3, "CB-H-2020")
        .when((table == 4) & (sex == "F"), "MI-M-2020")
        .when((table == 4) & (sex == "M"), "MI-H-2020")
    )


def spells(rows: DataFrame) -> DataFrame:
    """Person rows to inclusive age spells (table_id, lower_age, upper_age, death_age).

    Spells are cut to the study years; totally disabled rows of relationship 99 enter three
    years late; death, censoring and the child age limit end a spell.
    """
    start, birth, death = F.col("FEC_VIG"), F.col("FEC_NAC"), F.col("FEC_FALL")
    year = lambda c: F.floor(c / 10000).cast("int")
    insured = dates.round_half_up(dates.age_at(birth, start)).cast("int")
    origin = year(start) - insured
    late = (F.col("BEN_COD_INV") == "T") & (F.col("COD_REL") == 99)
    entry = F.greatest(F.lit(FIRST_YEAR), F.when(late, year(start) + 3).otherwise(year(start)))
    theta = insured + dates.age_at(start, death)
    died = death != dates.NO_DATE
    death_age = F.when(died, (F.ceil(theta) - 1).cast("int"))
    censored = F.when(F.col("FIN_EXPOSIC") != dates.OPEN_DATE, year(F.col("FIN_EXPOSIC")) - origin - 1)
    child = F.when(F.col("COD_REL").isin(30, 35) & (F.col("BEN_COD_INV") == "N"), F.lit(23))
    upper = F.least(F.lit(LAST_YEAR) - origin, death_age, censored, child, F.lit(110))
    return rows.select(
        table_of(F.col("TABLA"), F.col("SEXO")).alias("table_id"),
        F.greatest(entry - origin, F.lit(0)).alias("lower_age"),
        upper.alias("upper_age"),
        death_age.alias("death_age"),
    ).where("table_id IS NOT NULL AND lower_age <= upper_age")


def public_counts(rows: DataFrame) -> DataFrame:
    """Exposed and deaths per table and age on the complete 5 x 111 grid.

    Only aggregates leave this function: no person field, date or identifier.
    """
    key = ["table_id", "lower_age", "upper_age", "death_age"]
    # equal spells are counted first and written: persons are scanned once
    lives = stage(spells(rows).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "spells")
    exposed = exposure.exposed_by_age(lives, ["table_id"], weight="n")
    deaths = exposure.deaths_by_age(lives, ["table_id"], weight="n")
    grid = (
        rows.sparkSession.createDataFrame([(t,) for t in TABLES], "table_id string")
        .withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(110))))
    )
    return (
        grid.join(exposed, ["table_id", "age"], "left")
        .join(deaths, ["table_id", "age"], "left")
        .select(
            "table_id",
            "age",
            F.coalesce("exposed", F.lit(0)).alias("exposed"),
            F.coalesce("deaths", F.lit(0)).alias("deaths"),
        )
    )


def workbook_rules() -> list[Rule]:
    exposed, deaths, qx = F.col("exposed"), F.col("deaths"), F.col("qx")
    ratio = deaths / F.when(exposed > 0, exposed)
    close = F.abs(qx - ratio) <= F.greatest(
        F.lit(1e-12) * F.greatest(F.abs(qx), F.abs(ratio)), F.lit(1e-15)
    )
    return [
        Rule("counts_nonnegative", (exposed >= 0) & (deaths >= 0)),
        Rule("deaths_within_exposed", deaths <= exposed),
        Rule("qx_matches_counts", F.when(exposed == 0, qx.isNull()).otherwise(close)),
    ]


def reconcile_pensioners(
    rows: DataFrame,
    workbook: DataFrame,
    deviations: DataFrame,
    expected_rows: int,
    mode: str = "enforce",
) -> DataFrame:
    """555 aggregate rows: public counts, workbook counts, published deviations."""
    profiled = stage(person_profile(rows), "person-profile")
    require(
        report(
            person_report(profiled, expected_rows),
            check(workbook, workbook_rules()),
            check_unique(workbook, ["table_id", "age"], "workbook_cell_unique"),
            check_unique(deviations, ["table_id", "age"], "deviation_cell_unique"),
        )
    )
    return reconcile.three_way(public_counts(rows), workbook, deviations, mode=mode)
