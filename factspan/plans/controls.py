"""Birth control tables to facts, and their reconciliation with counted births."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.contracts import COMPARISON_KEY
from factspan.functions import dates, text
from factspan.functions.structures import reasons_json
from factspan.operators.reconcile import compare_values, key_difference, release_kind
from factspan.operators.rules import (
    Rule,
    check,
    check_absent,
    check_not_empty,
    check_unique,
    require,
)
from factspan.plans.batch import Release, complete, finish

SEXES = ("all", "male", "female", "indeterminate")
RULE = "published birth count, kept for comparison; events are not corrected by it"


def control_rules(kind: str, start: date, end: date) -> list[Rule]:
    """Rows of (year, month, sex, region, geography_vintage, births)."""
    _, monthly = release_kind(kind)
    month, region, vintage = F.col("month"), F.col("region"), F.col("geography_vintage")
    first, last, _ = dates.control_period(F.col("year"), month)
    trimmed = [F.col(c) == text.strip(F.col(c)) for c in ("sex", "region")]
    return [
        Rule("year_positive", F.col("year") >= 1),
        Rule("month_state", month.between(1, 12) if monthly else month.isNull()),
        Rule("births_nonnegative", F.col("births") >= 0),
        Rule("sex_known", F.col("sex").isin(*SEXES)),
        Rule("region_known", text.region_text_ok(region)),
        Rule("no_outer_blanks", trimmed[0] & trimmed[1]),
        Rule(
            "vintage_state",
            F.when(region == "CL", F.lit(True)).otherwise(vintage.rlike(r"\S"))
            & (vintage.isNull() | (vintage.rlike(r"\S") & (vintage == text.strip(vintage)))),
        ),
        Rule("inside_coverage", (first >= F.lit(start)) & (last <= F.lit(end))),
    ]


def missingness() -> Column:
    return reasons_json(
        {
            "birth_order": "published_all_orders_total",
            "commune": "aggregated_to_published_geography",
            "maternal_age": "aggregated_all_maternal_ages",
            "maternal_nationality": "not_published_in_aggregate_control",
            "registration_interval": "not_published_at_control_row_level",
            "geography_vintage": F.when(
                F.col("geography_vintage").isNull(), "not_applicable_to_national_total"
            ),
        }
    )


def control_facts(table: DataFrame) -> DataFrame:
    start, end, basis = dates.control_period(F.col("year"), F.col("month"))
    return table.select(
        F.col("births").cast("double").alias("value"),
        "sex",
        "region",
        "geography_vintage",
        start.alias("period_start"),
        end.alias("period_end"),
        basis.alias("date_basis"),
    )


def controls(
    table: DataFrame,
    release: Release,
    kind: str,
    start: date,
    end: date,
    source: Mapping[str, str] | None = None,
) -> DataFrame:
    """Published birth totals to a validated batch of diagnostic controls."""
    provisional, _ = release_kind(kind)
    if provisional != release.provisional:
        raise ValueError("release kind and provisional flag disagree")
    facts = control_facts(table)
    require(
        check_not_empty(table),
        check(table, control_rules(kind, start, end)),
        check_unique(
            facts,
            ["period_start", "period_end", "sex", "region", "geography_vintage"],
            "control_key_unique",
        ),
    )
    payload = complete(
        facts.withColumn("missingness_reason", missingness()),
        "demographic",
        {
            "domain": "demographic",
            "variable": "births",
            "semantic_kind": "count",
            "unit": "event",
            "population_basis": "not_applicable",
            "observation_role": "diagnostic_control",
            "parity_scope": "all_orders",
            **release.stamp(),
            "transformation_id": "ine-birth-control-normalize",
            "transformation_version": "v1",
            "aggregation_rule": RULE,
            "age_open": False,
            "cause": "not_applicable",
            "age_role": "mother",
            "age_measure_unit": "all_grouped_completed_years",
            "sex_role": "newborn",
            "geography_basis": "maternal_residence",
            "nationality_role": "mother",
        },
    )
    return finish(payload, "demographic", release, source or {"source_key": release.source_key})


def _side_rules(role: str, parity: str) -> list[Rule]:
    return [
        Rule("births_only", F.col("variable") == "births"),
        Rule("count_only", F.col("semantic_kind") == "count"),
        Rule("event_only", F.col("unit") == "event"),
        Rule("role_exact", F.col("observation_role") == role),
        Rule("parity_exact", F.col("parity_scope") == parity),
    ]


def _kind_rules(kind: str) -> list[Rule]:
    provisional, monthly = release_kind(kind)
    start, end = F.col("period_start"), F.col("period_end")
    basis = "birth_occurrence_month" if monthly else "birth_occurrence_year"
    if monthly:
        shape = (F.dayofmonth(start) == 1) & (end == F.add_months(start, 1))
    else:
        shape = (start == F.trunc(start, "YEAR")) & (end == F.add_months(start, 12))
    return [
        Rule("provisional_matches_kind", F.col("provisional") == provisional),
        Rule("basis_matches_kind", F.col("date_basis") == basis),
        Rule("period_matches_kind", shape),
    ]


def compare_births(counted: DataFrame, published: DataFrame, kind: str) -> DataFrame:
    """Counted births against published controls on 32 null-safe keys, one to one.

    Roles, calendar shape and identical key sets are required; no partial reconciliation.
    """
    key = list(COMPARISON_KEY)
    require(
        check(counted, _side_rules("observed_fact", "unknown_order")),
        check(published, _side_rules("diagnostic_control", "all_orders")),
        check(published, _kind_rules(kind)),
        check_not_empty(counted, "counted_not_empty"),
        check_unique(counted, key, "counted_key_unique"),
        check_unique(published, key, "published_key_unique"),
        check_absent(key_difference(counted, published, key), "same_key_set"),
    )
    return compare_values(
        counted, published, key, kind, names=("counted_value", "control_value")
    )
