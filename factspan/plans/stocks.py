"""Census and resident population tables to demographic facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.functions import dates, text
from factspan.functions.numbers import integral
from factspan.operators.intervals import open_not_last, overlapping_bins
from factspan.operators.rules import (
    Rule,
    check,
    check_absent,
    check_not_empty,
    check_unique,
    require,
    require_columns,
)
from factspan.operators.rulesets import nonblank
from factspan.plans.batch import Release, complete, finish

# fixed values: published sex columns of the census table
SEX_COLUMNS = {
    "population_male": "male",
    "population_female": "female",
    "population_total": "all",
}


def census_rules(columns: list[str]) -> list[Rule]:
    counts = [c for c in SEX_COLUMNS if c in columns]
    rules = [
        Rule("age_group_valid", text.census_bin(F.col("age_group")).isNotNull()),
        *[Rule(f"{c}_whole", integral(F.col(c)) & (F.col(c) >= 0)) for c in counts],
    ]
    if "population_total" in counts:
        both = F.col("population_male") + F.col("population_female")
        rules.append(Rule("total_is_male_plus_female", F.col("population_total") == both))
    if "census_year" in columns:
        rules.append(Rule("census_year_2024", F.col("census_year") == 2024))
    return rules


def by_sex(df: DataFrame, keep: list[str], columns: Mapping[str, str] = SEX_COLUMNS) -> DataFrame:
    """Wide sex columns to one row per sex; a published total stays as ``all``."""
    wide = [c for c in columns if c in df.columns]
    long = df.unpivot(keep, wide, "published_column", "value")
    return long.withColumn("sex", text.lookup(F.col("published_column"), columns)).drop(
        "published_column"
    )


def census_facts(table: DataFrame) -> DataFrame:
    """Census age groups as (bin, sex, value) rows."""
    bins = table.withColumn("b", text.census_bin(F.col("age_group"))).select("b.*", *table.columns)
    long = by_sex(bins, ["age_lower", "age_upper", "age_open"])
    return long.withColumn("value", F.col("value").cast("double"))


def census(
    table: DataFrame, release: Release, source: Mapping[str, str] | None = None
) -> DataFrame:
    """Grouped census table to a validated batch."""
    require_columns(table, ["age_group", "population_male", "population_female"])
    facts = census_facts(table)
    scale = facts.where(F.col("sex") == "male")
    require(
        check_not_empty(table),
        check(table, census_rules(table.columns)),
        check_absent(overlapping_bins(scale, ["sex"]), "age_groups_disjoint"),
    )
    start, end = dates.census_instant()
    text_all = "census 2024 count of an age group, both sexes together"
    text_sex = "census 2024 count of an age group and sex"
    ready = facts.withColumn(
        "aggregation_rule", F.when(F.col("sex") == "all", text_all).otherwise(text_sex)
    )
    payload = complete(
        ready,
        "demographic",
        {
            "domain": "demographic",
            "variable": "population",
            "semantic_kind": "population",
            "unit": "person",
            "population_basis": "census_enumerated",
            "observation_role": "observed_fact",
            "parity_scope": "not_applicable",
            "period_start": start,
            "period_end": end,
            **release.stamp(),
            "missingness_reason": "not_applicable_observed",
            "region": "CL",
            "cause": "not_applicable",
            "date_basis": "census_reference_instant",
            "age_role": "enumerated_habitual_resident",
            "age_measure_unit": "grouped_completed_years",
            "sex_role": "enumerated_habitual_resident",
            "geography_basis": "habitual_residence",
            "geography_vintage": "censo2024",
        },
    )
    return finish(payload, "demographic", release, source or {"source_key": release.source_key})


def population_facts(table: DataFrame, historical_end_year: int) -> DataFrame:
    """Resident stocks (year, age label, sex label, population, region?) as typed rows."""
    region = text.strip(F.col("region")) if "region" in table.columns else F.lit("CL")
    year = F.col("year").try_cast("double")
    age = text.single_age(F.col("age").cast("string"))
    sex = text.lookup(text.spanish_label(F.col("sex")), text.POPULATION_SEX)
    start, end = dates.population_instant(year)
    # the raw sex label is replaced, so everything is selected at once
    facts = table.select(
        year.alias("year"),
        F.col("population").try_cast("double").alias("value"),
        age["age_lower"].alias("age_lower"),
        age["age_upper"].alias("age_upper"),
        age["age_open"].alias("age_open"),
        sex.alias("sex"),
        region.alias("region"),
        start.alias("period_start"),
        end.alias("period_end"),
        dates.population_role(year, historical_end_year).alias("observation_role"),
    )
    return facts.withColumn("age_quantity", F.when(~F.col("age_open"), F.col("age_lower")))


def population_rules() -> list[Rule]:
    return [
        Rule("year_range", integral(F.col("year")) & F.col("year").between(1992, 2070)),
        Rule("population_nonnegative", F.col("value").isNotNull() & ~F.isnan("value")
             & (F.col("value") >= 0) & (F.col("value") < F.lit(float("inf")))),
        Rule("age_single_or_open", F.col("age_lower").isNotNull()),
        Rule("sex_known", F.col("sex").isNotNull()),
        Rule("region_nonblank", nonblank("region")),
    ]


def population(
    table: DataFrame,
    release: Release,
    historical_end_year: int,
    source: Mapping[str, str] | None = None,
) -> DataFrame:
    """Resident population table to a validated batch."""
    if not 1992 <= historical_end_year <= 2070:
        raise ValueError("historical_end_year must lie from 1992 through 2070")
    require_columns(table, ["year", "age", "sex", "population"])
    facts = population_facts(table, historical_end_year)
    group = ["period_start", "sex", "region"]
    require(
        check_not_empty(table),
        check(facts, population_rules()),
        check_unique(
            facts, ["age_lower", "age_upper", "age_open", *group], "population_key_unique"
        ),
        check_absent(open_not_last(facts, group), "open_age_last"),
        check_absent(overlapping_bins(facts, group), "ages_disjoint"),
    )
    historical = "mid-year estimate of a past year by age and sex (base 2024)"
    projected = "mid-year projection by age and sex (base 2024)"
    ready = facts.withColumn(
        "aggregation_rule",
        F.when(F.col("observation_role") == "observed_fact", historical).otherwise(projected),
    )
    payload = complete(
        ready,
        "demographic",
        {
            "domain": "demographic",
            "variable": "population",
            "semantic_kind": "population",
            "unit": "person",
            "population_basis": "resident_estimate",
            "parity_scope": "not_applicable",
            **release.stamp(),
            "missingness_reason": "not_applicable_observed",
            "cause": "not_applicable",
            "date_basis": "stock_reference_instant",
            "age_role": "resident",
            "age_measure_unit": "completed_years",
            "sex_role": "resident",
            "geography_basis": "habitual_residence",
            "geography_vintage": "ine-base2024",
        },
    )
    return finish(
        payload,
        "demographic",
        release,
        source or {"source_key": release.source_key},
        compose=("region",),
    )
