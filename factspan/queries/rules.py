"""Rule reports of every domain over rows with deliberate errors.

Each case is one table of ``orders`` rows dressed as domain rows. A column is written once
as text and used by both sides, with ``k`` the order key and ``c`` the customer key.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan import contracts as C
from factspan.functions import text
from factspan.operators import reconcile, rulesets
from factspan.operators.rules import Rule, check, check_unique, quarantine
from factspan.plans import batch, controls, finance, stocks
from factspan.queries.base import query, table

SQL_TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}
# columns every case shares; a case overrides what it varies
ENVELOPE = {
    "fact_id": "CASE WHEN k % 101 = 0 THEN 'fact:' || k ELSE 'factspan:fact:v1:' || HASH END",
    "observation_id": "'factspan:observation:v1:' || HASH",
    "release_id": "'factspan:release:v1:' || CASE WHEN k % 103 = 0 THEN 'x' ELSE HASH END",
    "variable": "CASE WHEN k % 107 = 0 THEN ' ' ELSE 'measure' END",
    "value": "CASE WHEN k % 11 = 0 THEN NULL ELSE k % 50 - CASE WHEN k % 13 = 0 THEN 60 ELSE 0 END END",
    "semantic_kind": "CASE WHEN k % 109 = 0 THEN 'rates' ELSE 'count' END",
    "unit": "CASE WHEN k % 17 = 0 THEN 'person' ELSE 'event' END",
    "population_basis": "'not_applicable'",
    "observation_role": "CASE WHEN k % 19 = 0 THEN 'seen' ELSE 'observed_fact' END",
    "parity_scope": "CASE WHEN k % 23 = 0 THEN 'some' ELSE 'not_applicable' END",
    "period_start": "DATE'2020-01-01'",
    "period_end": "CASE WHEN k % 29 = 0 THEN DATE'2020-01-01' ELSE DATE'2021-01-01' END",
    "source_key": "CASE WHEN k % 31 = 0 THEN 'Bad-Key' ELSE 'key_1' END",
    "vintage": "CASE WHEN k % 37 = 0 THEN '' ELSE 'v1' END",
    "released_at": "CASE WHEN k % 5 = 0 THEN NULL ELSE DATE'2022-01-01' END",
    "release_missingness_reason":
        "CASE WHEN k % 10 = 0 THEN 'publisher_date_not_available' WHEN k % 41 = 0 THEN 'late' END",
    "available_at": "CASE WHEN k % 43 = 0 THEN NULL ELSE TIMESTAMP'2022-01-02 00:00:00' END",
    "provisional": "false",
    "transformation_id": "CASE WHEN k % 3 = 0 THEN 'sum' END",
    "transformation_version": "CASE WHEN k % 6 = 0 THEN 'v1' END",
    "aggregation_rule": "'one row'",
    "missingness_reason": "CASE WHEN k % 22 = 0 THEN 'not_published' ELSE 'not_applicable_observed' END",
    "source_status_code": "CASE WHEN k % 47 = 0 THEN ' ' END",
}


def _spark_case(spark, sf_dir, domain: str, columns: dict[str, str]) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")
    )
    fields = C.domain_schema(domain).fields
    return base.select(
        "k",
        *[
            F.expr(_text(columns.get(f.name, "NULL"), "sha2(cast(k as string), 256)"))
            .cast(f.dataType)
            .alias(f.name)
            for f in fields
        ],
    )


def _text(expression: str, digest: str) -> str:
    return expression.replace("HASH", digest)


def _sql_case(domain: str, columns: dict[str, str]) -> str:
    listed = ", ".join(
        f"CAST({_text(columns.get(f.name, 'NULL'), 'sha256(CAST(k AS VARCHAR))')} AS "
        f"{SQL_TYPES[f.dataType.simpleString()]}) AS {f.name}"
        for f in C.domain_schema(domain).fields
    )
    return (
        f"t AS (SELECT k, {listed} FROM "
        "(SELECT o_orderkey AS k, o_custkey AS c FROM orders))"
    )


def _sql_report(domain: str, columns: dict[str, str], rules: dict[str, str]) -> str:
    lines = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id, count(*) FILTER (WHERE NOT coalesce(({condition}), false)) "
        "AS failed FROM t"
        for rule, condition in rules.items()
    )
    return f"WITH {_sql_case(domain, columns)} {lines}"


def _blank_rules(required, optional=()) -> dict[str, str]:
    rules = {f"{n}_nonblank": f"trim({n}) <> ''" for n in required}
    rules.update({f"{n}_text_or_null": f"{n} IS NULL OR trim({n}) <> ''" for n in optional})
    return rules


def _in(name: str, values) -> str:
    return f"{name} IN ({', '.join(repr(v) for v in values)})"


def _implies(condition: str, then: str) -> str:
    return f"NOT coalesce({condition}, false) OR coalesce({then}, false)"


VALUE_RANGE = (
    "value IS NULL OR ((semantic_kind NOT IN ('count', 'price', 'amount', 'probability') "
    "OR value >= 0) AND (semantic_kind <> 'count' OR value = floor(value)) "
    "AND (semantic_kind <> 'probability' OR value <= 1) "
    "AND (semantic_kind <> 'discount_factor' OR value > 0))"
)
EFFECTIVE = (
    "effective_start IS NOT NULL AND (effective_end IS NULL OR effective_end > effective_start) "
    "AND (maximum_effective_end IS NULL OR maximum_effective_end > effective_start) "
    "AND (effective_end IS NULL OR maximum_effective_end IS NULL "
    "OR effective_end <= maximum_effective_end)"
)
TRIPLES = ", ".join(f"({a!r}, {b!r}, {c!r})" for a, b, c in C.SEMANTIC_TRIPLES)

ENVELOPE_SQL = {
    "fact_id_form": "regexp_full_match(fact_id, 'factspan:fact:v1:[0-9a-f]{64}')",
    "observation_id_form":
        "regexp_full_match(observation_id, 'factspan:observation:v1:[0-9a-f]{64}')",
    "release_id_form": "regexp_full_match(release_id, 'factspan:release:v1:[0-9a-f]{64}')",
    "domain_known": _in("domain", C.DOMAINS),
    "role_known": _in("observation_role", C.ROLES),
    "parity_known": _in("parity_scope", C.PARITY_SCOPES),
    "semantics_compatible": f"(semantic_kind, unit, population_basis) IN ({TRIPLES})",
    "value_finite_or_missing": "value IS NULL OR isfinite(value)",
    "missing_value_explained":
        "value IS NOT NULL OR (trim(missingness_reason) <> '' "
        "AND missingness_reason <> 'not_applicable_observed')",
    "period_half_open": "period_start < period_end",
    "available_at_present": "available_at IS NOT NULL",
    "release_date_or_reason":
        "(released_at IS NOT NULL AND release_missingness_reason IS NULL) OR (released_at IS NULL "
        "AND coalesce(release_missingness_reason = 'publisher_date_not_available', false))",
    "transformation_paired":
        "(transformation_id IS NULL AND transformation_version IS NULL) "
        "OR coalesce(trim(transformation_id) <> '' AND trim(transformation_version) <> '', false)",
    **_blank_rules([n for n in C.NONBLANK_ENVELOPE if n not in C.ID_COLUMNS]),
    "source_key_snake_case": "regexp_full_match(source_key, '[a-z0-9][a-z0-9_]*')",
    "source_status_code_text": "source_status_code IS NULL OR trim(source_status_code) <> ''",
}

CASES: dict[str, tuple[dict[str, str], dict[str, str]]] = {}

CASES["demographic"] = (
    {
        **ENVELOPE,
        "domain": "CASE WHEN k % 53 = 0 THEN 'demography' ELSE 'demographic' END",
        "variable": "CASE WHEN k % 2 = 0 THEN 'births' ELSE 'deaths' END",
        "parity_scope": "CASE k % 4 WHEN 0 THEN 'known_order' WHEN 2 THEN 'unknown_order' "
                        "ELSE 'not_applicable' END",
        "birth_order": "CASE WHEN k % 8 = 0 THEN 1 + k % 3 WHEN k % 59 = 0 THEN 1 END",
        "age_lower": "CASE WHEN k % 5 < 4 THEN k % 90 END",
        "age_upper": "CASE WHEN k % 5 < 3 THEN k % 90 + CASE WHEN k % 61 = 0 THEN 0 ELSE 5 END END",
        "age_open": "k % 5 = 3",
        "age_quantity": "CASE WHEN k % 7 = 0 THEN k % 40 - 2 END",
        "sex": "CASE WHEN k % 67 = 0 THEN '' ELSE 'male' END",
        "region": "'CL'",
        "cause": "'all_causes'",
        "commune": "CASE WHEN k % 71 = 0 THEN ' ' END",
        "registration_start": "CASE WHEN k % 3 = 0 THEN TIMESTAMP'2020-01-01 00:00:00' END",
        "registration_end": "CASE WHEN k % 6 = 0 THEN TIMESTAMP'2020-02-01 00:00:00' END",
    },
    {
        "domain_demographic": "domain = 'demographic'",
        "age_state":
            "(age_lower IS NULL AND age_upper IS NULL AND NOT age_open) "
            "OR coalesce(age_lower >= 0 AND age_upper > age_lower AND NOT age_open, false) "
            "OR coalesce(age_lower >= 0 AND age_upper IS NULL AND age_open, false)",
        "age_quantity_range": "age_quantity IS NULL OR age_quantity >= 0",
        **_blank_rules(("sex", "region", "cause"), C.OPTIONAL_DEMOGRAPHIC_TEXT),
        "registration_paired":
            "(registration_start IS NULL AND registration_end IS NULL) "
            "OR coalesce(registration_end > registration_start, false)",
        "parity_state":
            "(variable <> 'births' AND parity_scope = 'not_applicable' AND birth_order IS NULL) OR "
            "(variable = 'births' AND parity_scope IN ('all_orders', 'unknown_order') "
            "AND birth_order IS NULL) OR coalesce(variable = 'births' "
            "AND parity_scope = 'known_order' AND birth_order >= 1 "
            "AND birth_order = floor(birth_order), false)",
    },
)

CASES["environmental"] = (
    {
        **ENVELOPE,
        "domain": "'environmental'",
        "semantic_kind": "'index'",
        "unit": "CASE WHEN k % 3 = 0 THEN 'microgram / meter ** 3' ELSE 'day' END",
        "station": "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN ' ' ELSE 'st' END",
        "region": "'CL-01'",
        "pollutant": "CASE WHEN k % 3 = 0 OR k % 13 = 0 THEN 'pm25' END",
        "environmental_measure": "CASE WHEN k % 5 = 0 THEN 'concentration' ELSE 'days' END",
        "averaging_interval": "'24h'",
        "validation_status": "CASE WHEN k % 17 = 0 THEN '' ELSE 'final' END",
    },
    {
        "domain_environmental": "domain = 'environmental'",
        **_blank_rules(
            ("region", "environmental_measure", "averaging_interval", "validation_status"),
            ("station", "commune", "geography_basis", "geography_vintage", "pollutant"),
        ),
        "pollutant_measured_at_station": _implies("pollutant IS NOT NULL", "trim(station) <> ''"),
        "pollutant_semantics": _implies(
            "pollutant IS NOT NULL",
            "semantic_kind = 'index' AND unit = 'microgram / meter ** 3' "
            "AND population_basis = 'not_applicable'",
        ),
        "concentration_names_pollutant": _implies(
            "environmental_measure = 'concentration'", "pollutant IS NOT NULL"
        ),
    },
)

CASES["health_system"] = (
    {
        **ENVELOPE,
        "domain": "CASE WHEN k % 5 = 0 THEN 'health' ELSE 'health_system' END",
        "facility": "'f' || c",
        "health_service": "CASE WHEN k % 7 = 0 THEN ' ' ELSE 's' END",
        "region": "'CL-02'",
        "commune": "CASE WHEN k % 11 = 0 THEN '' WHEN k % 2 = 0 THEN '02101' END",
        "service_measure": "'beds'",
        "capacity_measure": "CASE WHEN k % 13 = 0 THEN NULL ELSE 'installed' END",
        "event_measure": "'stay'",
        "reporting_grain": "'month'",
    },
    {
        "domain_health_system": "domain = 'health_system'",
        **_blank_rules(
            (
                "facility",
                "health_service",
                "region",
                "service_measure",
                "capacity_measure",
                "event_measure",
                "reporting_grain",
            ),
            ("commune", "geography_basis", "geography_vintage"),
        ),
    },
)

_CURVE = "quote_type IN ('benchmark_yield', 'swap_fixed_rate')"
_GRAIN = " OR ".join(
    f"(variable = {a!r} AND quote_type = {b!r} AND currency = {c!r} AND indexation = {d!r} "
    f"AND instrument_type = {e!r})"
    for a, b, c, d, e in C.QUOTED_INSTRUMENTS
)
CASES["market_quote"] = (
    {
        **ENVELOPE,
        "domain": "'market_quote'",
        "quote_type": "CASE k % 6 WHEN 0 THEN 'benchmark_yield' WHEN 1 THEN 'swap_fixed_rate' "
                      "WHEN 2 THEN 'fixing' WHEN 3 THEN 'published_index' "
                      "WHEN 4 THEN 'published_change' ELSE 'spot' END",
        "variable": "CASE k % 6 WHEN 0 THEN 'official_benchmark_yield' "
                    "WHEN 1 THEN 'official_swap_fixed_rate' WHEN 2 THEN 'uf_fixing_clp' "
                    "WHEN 3 THEN 'consumer_price_index' ELSE 'consumer_price_change' END",
        "semantic_kind": "CASE k % 6 WHEN 0 THEN 'rate' WHEN 1 THEN 'rate' WHEN 2 THEN 'price' "
                         "ELSE 'index' END",
        "unit": "CASE k % 6 WHEN 0 THEN '1 / year' WHEN 1 THEN '1 / year' WHEN 2 THEN 'CLP' "
                "WHEN 3 THEN 'dimensionless' ELSE 'percent' END",
        "observation_role": "CASE WHEN k % 6 < 2 THEN 'market_quote' WHEN k % 7 = 0 "
                            "THEN 'observed_fact' ELSE 'covariate' END",
        "source_series_id": "'S' || c",
        "tenor_years": "CASE WHEN k % 6 < 2 THEN k % 30 END",
        "currency": "CASE WHEN c % 2 = 0 OR k % 6 = 2 THEN 'CLP' ELSE 'UF' END",
        "indexation": "CASE WHEN k % 6 = 2 THEN 'UF' WHEN c % 2 = 0 THEN 'nominal' ELSE 'UF' END",
        "instrument_type": "CASE WHEN k % 6 = 0 AND c % 2 = 0 THEN 'bcp_benchmark_bond' "
                           "WHEN k % 6 = 0 THEN 'bcu_btu_benchmark_bond' "
                           "WHEN k % 6 = 1 THEN 'spc_nominal_fixed_swap' "
                           "WHEN k % 6 = 2 THEN 'uf_fixing' ELSE 'index' END",
        "compounding": "CASE WHEN k % 11 = 0 THEN 'daily' WHEN k % 2 = 0 THEN 'simple' END",
        "day_count": "CASE WHEN k % 13 = 0 THEN 'actual_360' END",
        "date_basis": "'market_observation'",
    },
    {
        "domain_market_quote": "domain = 'market_quote'",
        "quote_type_known": _in("quote_type", C.MARKET_QUOTE_TYPES),
        "compounding_known": "compounding IS NULL OR " + _in("compounding", C.COMPOUNDING),
        "day_count_known": "day_count IS NULL OR " + _in("day_count", C.DAY_COUNTS),
        **_blank_rules(
            ("source_series_id", "currency", "indexation", "instrument_type", "date_basis"),
            ("compounding", "day_count"),
        ),
        "role_parity_basis":
            "parity_scope = 'not_applicable' AND population_basis = 'not_applicable' "
            f"AND observation_role = CASE WHEN {_CURVE} THEN 'market_quote' ELSE 'covariate' END",
        "tenor_years_positive": "tenor_years IS NULL OR tenor_years > 0",
        "quote_semantics":
            f"({_CURVE} AND semantic_kind = 'rate' AND unit = '1 / year') "
            "OR (quote_type = 'fixing' AND semantic_kind = 'price') "
            "OR (quote_type = 'published_index' AND variable = 'consumer_price_index' "
            "AND semantic_kind = 'index' AND unit = 'dimensionless') "
            "OR (quote_type = 'published_change' AND variable = 'consumer_price_change' "
            "AND semantic_kind = 'index' AND unit = 'percent')",
        "instrument_grain": _implies(_CURVE, _GRAIN),
        "value_range": VALUE_RANGE,
        "unit_fixing_shape": _implies(
            "variable = 'uf_fixing_clp' OR instrument_type = 'uf_fixing'",
            "variable = 'uf_fixing_clp' AND quote_type = 'fixing' AND semantic_kind = 'price' "
            "AND unit = 'CLP' AND currency = 'CLP' AND indexation = 'UF' "
            "AND instrument_type = 'uf_fixing' AND tenor_years IS NULL AND compounding IS NULL "
            "AND day_count IS NULL",
        ),
    },
)

_PUBLISHED = (
    "currency = 'UF' AND indexation = 'UF' AND compounding = 'annual_compounded' "
    "AND day_count IS NULL AND financial_entity_id IS NULL AND financial_entity_type IS NULL"
)
_CURVES = " OR ".join(
    f"coalesce(regulatory_basis = {basis!r} AND quote_type = {quote!r} AND variable = {variable!r} "
    f"AND instrument_type = {instrument!r} AND {_PUBLISHED} AND "
    + (
        "tenor_years IS NULL"
        if longest is None
        else f"tenor_years = floor(tenor_years) AND tenor_years > 0 AND tenor_years <= {longest}"
    )
    + ", false)"
    for basis, quote, variable, instrument, longest in C.REGULATORY_CURVES
)
_INSURER = (
    "coalesce(regulatory_basis = 'NCG_209' AND quote_type = 'asset_sufficiency_irr' "
    "AND variable = 'insurer_asset_sufficiency_irr' AND currency = 'not_applicable' "
    "AND indexation = 'not_applicable' AND instrument_type = 'insurer_asset_sufficiency_irr' "
    "AND compounding IS NULL AND day_count IS NULL AND tenor_years IS NULL "
    "AND financial_entity_id IS NOT NULL AND financial_entity_type = 'insurer', false)"
)
CASES["regulatory_rate"] = (
    {
        **ENVELOPE,
        "domain": "'regulatory_rate'",
        "observation_role": "CASE WHEN k % 19 = 0 THEN 'observed_fact' ELSE 'regulatory_input' END",
        "semantic_kind": "CASE WHEN k % 29 = 0 THEN 'index' ELSE 'rate' END",
        "unit": "'1 / year'",
        "regulatory_basis": "CASE k % 5 WHEN 0 THEN 'VTD_CMF' WHEN 1 THEN 'VTD_CMF' "
                            "WHEN 2 THEN 'NCG_209' WHEN 3 THEN 'TITRP' ELSE 'TM_2020' END",
        "regulatory_use": "'reserve'",
        "quote_type": "CASE k % 5 WHEN 0 THEN 'regulatory_discount_rate' "
                      "WHEN 1 THEN 'published_zero_rate' WHEN 2 THEN 'asset_sufficiency_irr' "
                      "WHEN 3 THEN 'technical_rate' ELSE 'technical_rate_input' END",
        "variable": "CASE k % 5 WHEN 0 THEN 'cmf_regulatory_discount_rate' "
                    "WHEN 1 THEN 'cmf_published_real_zero_rate' "
                    "WHEN 2 THEN 'insurer_asset_sufficiency_irr' "
                    "ELSE 'programmed_withdrawal_technical_rate' END",
        "instrument_type": "CASE k % 5 WHEN 0 THEN 'cmf_vtd_spot_rate_ac' "
                           "WHEN 1 THEN 'cmf_vtd_real_zero_curve' "
                           "WHEN 2 THEN 'insurer_asset_sufficiency_irr' "
                           "ELSE 'programmed_withdrawal_technical_rate' END",
        "currency": "CASE WHEN k % 5 = 2 THEN 'not_applicable' ELSE 'UF' END",
        "indexation": "CASE WHEN k % 5 = 2 THEN 'not_applicable' ELSE 'UF' END",
        "compounding": "CASE WHEN k % 5 <> 2 THEN 'annual_compounded' END",
        "tenor_years": "CASE WHEN k % 5 < 2 THEN c % 140 / 2.0 END",
        "financial_entity_id": "CASE WHEN k % 5 = 2 THEN 'cl-rut:1-9' END",
        "financial_entity_type": "CASE WHEN k % 35 = 2 THEN NULL WHEN k % 5 = 2 THEN 'insurer' END",
        "effective_start": "CASE WHEN k % 31 = 0 THEN NULL ELSE DATE'2020-01-01' END",
        "effective_end": "CASE WHEN k % 3 = 0 THEN DATE'2021-01-01' END",
        "maximum_effective_end": "CASE WHEN k % 37 = 0 THEN DATE'2019-01-01' "
                                 "WHEN k % 6 = 0 THEN DATE'2020-06-01' END",
    },
    {
        "domain_regulatory_rate": "domain = 'regulatory_rate'",
        "regulatory_basis_known": _in("regulatory_basis", C.REGULATORY_RATE_BASES),
        "quote_type_known": _in("quote_type", C.REGULATORY_QUOTE_TYPES),
        "financial_entity_type_known":
            "financial_entity_type IS NULL OR " + _in("financial_entity_type", C.ENTITY_TYPES),
        "compounding_known": "compounding IS NULL OR " + _in("compounding", C.COMPOUNDING),
        "day_count_known": "day_count IS NULL OR " + _in("day_count", C.DAY_COUNTS),
        "role_parity_basis":
            "parity_scope = 'not_applicable' AND observation_role = 'regulatory_input' "
            "AND population_basis = 'not_applicable'",
        **_blank_rules(
            ("regulatory_use", "currency", "indexation", "instrument_type"),
            ("financial_entity_id", "financial_entity_type", "compounding", "day_count"),
        ),
        "entity_paired": "(financial_entity_id IS NULL) = (financial_entity_type IS NULL)",
        "rate_semantics":
            "semantic_kind = 'rate' AND unit = '1 / year' AND population_basis = 'not_applicable'",
        "basis_matches_quote": "(regulatory_basis, quote_type) IN ("
        + ", ".join(f"({a!r}, {b!r})" for a, b in C.REGULATORY_PAIRINGS)
        + ")",
        "published_grain": f"{_CURVES} OR {_INSURER}",
        "value_range": VALUE_RANGE,
        "tenor_years_positive": "tenor_years IS NULL OR tenor_years > 0",
        "effective_interval_ordered": EFFECTIVE,
    },
)

CASES["regulatory_mortality_table"] = (
    {
        **ENVELOPE,
        "domain": "'regulatory_mortality_table'",
        "variable": "CASE WHEN k % 2 = 0 THEN 'regulatory_mortality_probability' "
                    "ELSE 'regulatory_mortality_improvement_factor' END",
        "value": "CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 120) / 100.0 - "
                 "CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END",
        "semantic_kind": "CASE WHEN k % 2 = 0 THEN 'probability' ELSE 'index' END",
        "unit": "'dimensionless'",
        "population_basis": "CASE WHEN k % 2 = 0 THEN 'pensioner' ELSE 'not_applicable' END",
        "observation_role": "'regulatory_input'",
        "regulatory_basis": "CASE WHEN k % 17 = 0 THEN 'TITRP' ELSE 'TM_2020' END",
        "mortality_table_id": "CASE WHEN k % 19 = 0 THEN ' ' ELSE 'CB-H-2020' END",
        "age": "CASE WHEN k % 23 = 0 THEN 20.5 ELSE k % 110 END",
        "sex": "'male'",
        "population_segment": "CASE WHEN k % 29 = 0 THEN 'all' ELSE 'pensioner' END",
        "reference_year": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN 2014 ELSE 2020 END",
        "improvement_year": "CASE WHEN k % 41 = 0 THEN 2021.5 WHEN k % 2 = 1 THEN 2021 + k % 16 END",
        "effective_start": "DATE'2023-07-01'",
        "effective_end": "CASE WHEN k % 43 = 0 THEN DATE'2030-07-01' END",
        "maximum_effective_end": "DATE'2029-07-01'",
    },
    {
        "domain_mortality": "domain = 'regulatory_mortality_table'",
        "regulatory_basis_known": "regulatory_basis = 'TM_2020'",
        "role_and_parity":
            "parity_scope = 'not_applicable' AND observation_role = 'regulatory_input'",
        **_blank_rules(("mortality_table_id", "sex", "population_segment")),
        "age_integral": "age = floor(age) AND age >= 0",
        "reference_year_integral": "reference_year = floor(reference_year) AND reference_year >= 0",
        "improvement_year_integral":
            "improvement_year IS NULL OR (improvement_year = floor(improvement_year) "
            "AND improvement_year >= 0)",
        "mortality_semantics":
            "((variable = 'regulatory_mortality_probability' AND semantic_kind = 'probability' "
            "AND unit = 'dimensionless' AND population_basis = 'pensioner' "
            "AND improvement_year IS NULL) OR "
            "(variable = 'regulatory_mortality_improvement_factor' AND semantic_kind = 'index' "
            "AND unit = 'dimensionless' AND population_basis = 'not_applicable' "
            "AND improvement_year IS NOT NULL AND (value IS NULL OR value >= 0))) "
            f"AND ({VALUE_RANGE})",
        "table_vintage":
            "reference_year = 2020 AND population_segment = 'pensioner' "
            "AND effective_start = DATE '2023-07-01' "
            "AND maximum_effective_end = DATE '2029-07-01'",
        "effective_interval_ordered": EFFECTIVE,
    },
)

_NEUTRAL = ("pension_type", "modality", "offer_type", "intermediation_type", "contract_state")
CASES["pension_product_statistic"] = (
    {
        **ENVELOPE,
        "domain": "'pension_product_statistic'",
        "variable": "CASE k % 4 WHEN 0 THEN 'annuity_policy_count' "
                    "WHEN 1 THEN 'annuity_single_premium' WHEN 2 THEN 'asset_sufficiency_balance' "
                    "ELSE 'scomp_selected_pension_share' END",
        "semantic_kind": "CASE k % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'amount' "
                         "WHEN 2 THEN 'signed_amount' ELSE 'index' END",
        "unit": "CASE k % 4 WHEN 0 THEN 'event' WHEN 3 THEN 'percent' ELSE 'UF' END",
        "observation_role": "CASE WHEN k % 4 = 2 THEN 'regulatory_input' ELSE 'product_statistic' END",
        "financial_entity_id": "'cl-rut:1-9'",
        "financial_entity_type": "CASE WHEN k % 7 = 0 THEN 'afp' ELSE 'insurer' END",
        "pension_type": "CASE WHEN k % 4 = 2 AND k % 3 > 0 THEN 'not_applicable' "
                        "WHEN k % 11 = 0 THEN 'war' ELSE 'old_age' END",
        "modality": "CASE WHEN k % 4 = 2 THEN 'not_applicable' ELSE 'immediate_annuity' END",
        "offer_type": "'not_applicable'",
        "intermediation_type": "CASE WHEN k % 13 = 0 THEN 'broker' ELSE 'not_applicable' END",
        "contract_state": "'not_applicable'",
        "aggregation_grain": "'insurer'",
        "product_term_set_id": "CASE WHEN k % 17 = 0 THEN 'scomp:v1:a' WHEN k % 19 = 0 THEN '' END",
    },
    {
        "domain_pension_product": "domain = 'pension_product_statistic'",
        "financial_entity_type_known": _in("financial_entity_type", C.ENTITY_TYPES),
        "pension_type_known": _in("pension_type", C.PENSION_TYPES),
        "modality_known": _in("modality", C.MODALITIES),
        "offer_type_known": _in("offer_type", C.OFFER_TYPES),
        "intermediation_type_known": "intermediation_type = 'not_applicable'",
        "contract_state_known": _in("contract_state", C.CONTRACT_STATES),
        "aggregation_grain_known": _in("aggregation_grain", C.ENTITY_TYPES),
        **_blank_rules(("financial_entity_id",), ("product_term_set_id",)),
        "entity_matches_grain": "financial_entity_type = aggregation_grain",
        "statistic_semantics":
            "parity_scope = 'not_applicable' AND population_basis = 'not_applicable' "
            "AND ((observation_role = 'product_statistic' AND (variable, semantic_kind, unit) IN ("
            + ", ".join(f"({a!r}, {b!r}, {c!r})" for a, b, c in C.PRODUCT_STATISTICS)
            + f")) OR semantic_kind = 'signed_amount') AND ({VALUE_RANGE})",
        "signed_amount_shape": _implies(
            "semantic_kind = 'signed_amount'",
            "variable = 'asset_sufficiency_balance' AND unit = 'UF' "
            "AND observation_role = 'regulatory_input' AND financial_entity_type = 'insurer' "
            "AND aggregation_grain = 'insurer' AND "
            + " AND ".join(f"{n} = 'not_applicable'" for n in _NEUTRAL)
            + " AND product_term_set_id IS NULL",
        ),
    },
)


def _register(domain: str) -> None:
    columns, rules = CASES[domain]

    @query(_sql_report(domain, columns, rules), name=f"rules_{domain}")
    def run(spark, sf_dir):
        rows = _spark_case(spark, sf_dir, domain, columns)
        return check(rows, rulesets.DOMAIN_RULES[domain]()).select("rule_id", "failed")


for _domain in CASES:
    _register(_domain)

_HEALTH = {**CASES["health_system"][0], "domain": "'health_system'"}


@query(_sql_report("health_system", _HEALTH, ENVELOPE_SQL))
def rules_envelope(spark, sf_dir):
    rows = _spark_case(spark, sf_dir, "health_system", _HEALTH)
    return check(rows, rulesets.envelope_rules()).select("rule_id", "failed")


@query("""
SELECT 'quantity_small' AS rule_id, count(*) FILTER (WHERE NOT l_quantity < 45) AS failed,
       min(CAST(l_orderkey AS VARCHAR)) FILTER (WHERE NOT l_quantity < 45) AS sample_key
FROM lineitem
UNION ALL SELECT 'flag_not_r', count(*) FILTER (WHERE l_returnflag = 'R'),
       min(CAST(l_orderkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'R') FROM lineitem
UNION ALL SELECT 'null_is_failure', count(*) FILTER (WHERE l_suppkey % 9 = 0),
       min(CAST(l_orderkey AS VARCHAR)) FILTER (WHERE l_suppkey % 9 = 0) FROM lineitem
UNION ALL SELECT 'always', 0, NULL FROM (SELECT 1)
""")
def rule_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    unknown = F.when(F.col("l_suppkey") % 9 != 0, F.lit(True))
    rules = [
        Rule("quantity_small", F.col("l_quantity") < 45),
        Rule("flag_not_r", F.col("l_returnflag") != "R"),
        Rule("null_is_failure", unknown),
        Rule("always", F.lit(True)),
    ]
    return check(lines, rules, key=F.col("l_orderkey"))


@query("""
SELECT array_to_string(list_filter([
    CASE WHEN NOT l_quantity < 45 THEN 'quantity_small' END,
    CASE WHEN l_returnflag = 'R' THEN 'flag_not_r' END], lambda x: x IS NOT NULL), ',') AS broken,
  count(*) AS rows
FROM lineitem WHERE l_quantity >= 45 OR l_returnflag = 'R' GROUP BY 1
""")
def quarantined_rows(spark, sf_dir):
    rules = [
        Rule("quantity_small", F.col("l_quantity") < 45),
        Rule("flag_not_r", F.col("l_returnflag") != "R"),
    ]
    _, bad = quarantine(table(spark, sf_dir, "lineitem"), rules)
    return bad.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query("""
WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2)
SELECT 'brand_size_unique' AS rule_id,
       CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS failed FROM g
""")
def unique_keys(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return check_unique(parts, ["p_brand", "p_size"], "brand_size_unique").select(
        "rule_id", "failed"
    )


@query("""
WITH t AS (SELECT o_orderkey % 5 AS i, o_orderkey % 30 AS n, o_orderkey % 37 = 0 AS blank FROM orders)
SELECT 'scalar_or_interval' AS rule_id, count(*) FILTER (WHERE i = 1 AND n = 0) AS failed FROM t
UNION ALL SELECT 'ordinal_nonnegative', count(*) FILTER (WHERE n - 2 < 0) FROM t
UNION ALL SELECT 'label_nonblank', count(*) FILTER (WHERE blank) FROM t
UNION ALL SELECT 'set_matches_vocabulary', count(*) FILTER (WHERE n = 7) FROM t
UNION ALL SELECT 'term_in_vocabulary', count(*) FILTER (WHERE NOT CASE i
    WHEN 0 THEN n > 0 WHEN 1 THEN true WHEN 2 THEN n BETWEEN 1 AND 20 WHEN 3 THEN false
    ELSE false END) FROM t
""")
def rules_product_terms(spark, sf_dir):
    i, n = F.col("o_orderkey") % 5, F.col("o_orderkey") % 30
    codes = F.array(
        *[
            F.lit(c)
            for c in (
                "guarantee_years",
                "guarantee_years_band",
                "survivor_percentage",
                "temporary_increase_months",
                "other",
            )
        ]
    )
    band = i == 1
    value = F.when(i == 2, n / 20).when(i == 3, n + 0.5).otherwise(n).cast("double")
    terms = table(spark, sf_dir, "orders").select(
        F.when(n == 7, "scomp:v2:x").otherwise("scomp:v1:x").alias("product_term_set_id"),
        (n - 2).cast("int").alias("term_ordinal"),
        F.element_at(codes, (i + 1).cast("int")).alias("term_code"),
        F.when(band, "published_aggregate_grouping").otherwise("contract_term").alias("term_role"),
        F.when(~band, value).alias("numeric_value"),
        F.when(band, F.lit(0.0)).alias("lower_bound"),
        F.when(band, n.cast("double")).alias("upper_bound"),
        F.when(i.isin(0, 1), "year").when(i == 2, "dimensionless").otherwise("month").alias("unit"),
        F.when(F.col("o_orderkey") % 37 == 0, " ").otherwise("label").alias("source_label"),
    )
    return check(terms, rulesets.term_rules()).select("rule_id", "failed")


@query("""
WITH a AS (SELECT CAST(ts AS DATE) AS release_id, event_type, event_id, event_id % 4 AS k
           FROM events)
SELECT 'source_key_snake_case' AS rule_id, count(*) FILTER (WHERE k = 1) AS failed FROM a
UNION ALL SELECT 'sha256_form', count(*) FILTER (WHERE k = 2) FROM a
UNION ALL SELECT 'available_at_present', count(*) FILTER (WHERE event_id % 9 = 0) FROM a
UNION ALL SELECT 'release_date_or_reason', count(*) FILTER (WHERE k = 3) FROM a
""")
def rules_assets(spark, sf_dir):
    kind = F.col("event_id") % 4
    assets = table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("release_id"),
        F.when(kind == 1, F.upper("event_type")).otherwise(F.col("event_type")).alias("source_key"),
        F.when(kind == 2, "abc").otherwise(F.sha2("event_type", 256)).alias("sha256"),
        F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("timestamp")).alias("available_at"),
        F.to_date("ts").alias("released_at"),
        F.when(kind == 3, "publisher_date_not_available").alias("release_missingness_reason"),
    )
    return check(assets, rulesets.asset_rules()).select("rule_id", "failed")


# --- rules of the sources ------------------------------------------------------


def _report_sql(cte: str, rules: dict[str, str]) -> str:
    lines = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule_id, count(*) FILTER (WHERE NOT coalesce(({ok}), false)) AS failed "
        "FROM t"
        for rule, ok in rules.items()
    )
    return f"WITH {cte} {lines}"


PEOPLE = """
t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END
               AS origin, CASE WHEN o_orderkey % 29 = 0 THEN 12 ELSE 10 END AS rel FROM orders)
"""


@query(_report_sql(PEOPLE, {
    "fields_present": "origin IS NOT NULL",
    "origin_known": "origin IN (1, 2)",
    "relationship_known": "rel = 10",
    "pension_date_valid": "k % 23 <> 0",
    "exposure_end_valid": "k % 19 <> 0",
    "birth_date_valid": "k % 17 <> 0",
    "death_date_valid": "k % 13 <> 0",
}))
def rules_pensioners(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    people = table(spark, sf_dir, "orders").select(
        F.when(key % 31 != 0, (1 + key % 3).cast("int")).alias("ORIGEN"),
        F.lit(1).alias("TABLA"),
        F.when(key % 23 == 0, 0).otherwise(day).alias("FEC_VIG"),
        F.when(key % 19 == 0, 20201301).when(key % 2 == 0, 99991231).otherwise(day).alias(
            "FIN_EXPOSIC"
        ),
        F.lit("F").alias("SEXO"),
        F.when(key % 29 == 0, 12).otherwise(10).alias("COD_REL"),
        F.lit("N").alias("BEN_COD_INV"),
        F.when(key % 17 == 0, 19991340).otherwise(day).alias("FEC_NAC"),
        F.when(key % 13 == 0, 20210229).when(key % 2 == 0, 0).otherwise(day).alias("FEC_FALL"),
    )
    return check(people, finance.pensioner_rules()).select("rule_id", "failed")


CONTROLS = """
t AS (SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, month(o_orderdate) AS m
      FROM orders)
"""


@query(_report_sql(CONTROLS, {
    "year_positive": "true",
    "month_state": "k % 7 <> 0 AND k % 11 <> 0",
    "births_nonnegative": "k % 13 <> 0",
    "sex_known": "k % 5 <> 0",
    "region_known": "c % 18 < 16 OR c % 18 = 17",
    "no_outer_blanks": "k % 5 <> 0",
    "vintage_state": "c % 18 = 17 OR k % 3 <> 0",
    "inside_coverage": "k % 7 = 0 AND y <= 2000 OR k % 7 <> 0 AND k % 11 <> 0 AND y <= 2000",
}))
def rules_controls(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey") % 18
    rows = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"),
        F.when(key % 7 == 0, F.lit(None).cast("int"))
        .when(key % 11 == 0, 13)
        .otherwise(F.month("o_orderdate"))
        .alias("month"),
        F.when(key % 5 == 0, " male").otherwise("male").alias("sex"),
        F.when(customer == 17, "CL")
        .otherwise(F.concat(F.lit("CL-"), F.lpad((customer + 1).cast("string"), 2, "0")))
        .alias("region"),
        F.when(key % 3 != 0, "dpa-2019").alias("geography_vintage"),
        F.when(key % 13 == 0, -1).otherwise(5).alias("births"),
    )
    rules = controls.control_rules("coyuntural_monthly", date(1995, 1, 1), date(2001, 1, 1))
    return check(rows, rules).select("rule_id", "failed")


@query(_report_sql(
    "t AS (SELECT p_partkey AS k, p_size AS s FROM part)",
    {
        "age_group_valid": "k % 7 <> 0",
        "population_male_whole": "k % 11 <> 0",
        "population_female_whole": "k % 13 <> 0",
        "population_total_whole": "true",
        "total_is_male_plus_female": "k % 11 <> 0 AND k % 13 <> 0",
        "census_year_2024": "k % 5 <> 0",
    },
))
def rules_census(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    label = F.concat(size.cast("string"), F.lit(" a "), (size + 4).cast("string"))
    rows = table(spark, sf_dir, "part").select(
        F.when(key % 7 == 0, "50 y más").when(key % 2 == 0, "85 o más").otherwise(label).alias(
            "age_group"
        ),
        F.when(key % 11 == 0, size + 0.5).otherwise(size.cast("double")).alias("population_male"),
        F.when(key % 13 == 0, -1.0).otherwise(2.0).alias("population_female"),
        (size + 2).cast("double").alias("population_total"),
        F.when(key % 5 == 0, 2017).otherwise(2024).alias("census_year"),
    )
    return check(rows, stocks.census_rules(rows.columns)).select("rule_id", "failed")


@query(_report_sql(
    "t AS (SELECT c_custkey AS k FROM customer)",
    {
        "entity_id_canonical": "k % 3 <> 0",
        "label_trimmed": "k % 5 <> 0",
        "source_key_snake_case": "k % 7 <> 0",
        "interval_ordered": "k % 11 <> 0",
    },
))
def rules_aliases(spark, sf_dir):
    key = F.col("c_custkey")
    body = (key + 1).cast("string")
    tail = F.concat(body, F.lit("-"), text.rut_digit(body))
    rows = table(spark, sf_dir, "customer").select(
        F.when(key % 3 == 0, tail).otherwise(F.concat(F.lit("cl-rut:"), tail)).alias("entity_id"),
        F.when(key % 5 == 0, F.concat("c_name", F.lit(" "))).otherwise(F.col("c_name")).alias(
            "label"
        ),
        F.when(key % 7 == 0, "Bad-Key").otherwise("key_1").alias("source_key"),
        F.lit(date(2020, 1, 1)).alias("valid_start"),
        F.when(key % 11 == 0, F.lit(date(2020, 1, 1)))
        .when(key % 2 == 0, F.lit(date(2021, 1, 1)))
        .alias("valid_end"),
    )
    return check(rows, rulesets.alias_rules()).select("rule_id", "failed")


@query("""
WITH b AS (SELECT DISTINCT CASE WHEN p_size % 7 = 3 AND p_type = 'SMALL' THEN 6 ELSE p_size % 7 END AS a, p_type AS b
      FROM part),
g AS (SELECT a, b FROM (SELECT unnest(range(0, 6)) AS a), (SELECT DISTINCT p_type AS b FROM part))
SELECT CAST(coalesce(b.a, g.a) AS BIGINT) AS a, coalesce(b.b, g.b) AS b,
       CAST(CASE WHEN b.a IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_left,
       CAST(CASE WHEN g.a IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_right
FROM b FULL JOIN g ON b.a = g.a AND b.b = g.b WHERE b.a IS NULL OR g.a IS NULL
""")
def allowed_combinations(spark, sf_dir):
    """Combinations of every part against every allowed one; one is missing as its parts count as another."""
    parts = table(spark, sf_dir, "part")
    size = F.expr("CASE WHEN p_size % 7 = 3 AND p_type = 'SMALL' THEN 6 ELSE p_size % 7 END").cast("bigint")
    seen = parts.select(size.alias("a"), F.col("p_type").alias("b")).distinct()
    kinds = parts.select(F.col("p_type").alias("b")).distinct()
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))
    grid = kinds.select(F.explode(steps).alias("a"), "b")
    return reconcile.key_difference(seen, grid, ["a", "b"])


@query("""
SELECT o_orderpriority AS release_id, max(o_orderdate::DATE) AS available_at,
       min(o_orderdate::DATE) AS observation_start,
       CAST(max(o_orderdate::DATE) + 1 AS DATE) AS observation_end,
       array_to_string(list_sort(list_distinct(list('rule ' || o_orderstatus))), ',') || ',divide'
         AS rules
FROM orders GROUP BY 1
""")
def merged_provenance(spark, sf_dir):
    """Provenance of one result per priority, merged from one row per priority and status."""
    day = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.max(day).alias("available_at"),
        F.min(day).alias("observation_start"),
        F.date_add(F.max(day), 1).alias("observation_end"),
    )
    provenance = rows.select(
        F.col("o_orderpriority").alias("release_id"),
        "available_at",
        "observation_start",
        "observation_end",
        F.array(F.concat(F.lit("rule "), F.col("o_orderstatus"))).alias("aggregation_rules"),
        F.array(F.lit("count-v1")).alias("transformation_ids"),
    )
    merged = batch.merged_provenance(provenance, ["release_id"], "divide", "rate-v1")
    return merged.select(
        "release_id",
        "available_at",
        "observation_start",
        "observation_end",
        F.array_join("aggregation_rules", ",").alias("rules"),
    )


@query("""
WITH parts AS (SELECT o_orderpriority, o_orderstatus, max(o_orderdate::DATE) AS latest, min(o_orderdate::DATE) AS earliest,
                      CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS p, count(*) AS n FROM orders GROUP BY 1, 2),
rules AS (SELECT o_orderpriority, unnest(['sum ' || substr(o_orderstatus, 1, 1), 'by month', 'rows ' || n % 2]) AS r,
                 unnest([p * 3, p * 3 + 1, p * 3 + 2]) AS place FROM parts),
firsts AS (SELECT o_orderpriority, r, min(place) AS place FROM rules GROUP BY 1, 2)
SELECT p.o_orderpriority, max(latest) AS available_at, min(earliest) AS observation_start,
  (SELECT string_agg(r, ',' ORDER BY place) FROM firsts l WHERE l.o_orderpriority = p.o_orderpriority) || ',divide' AS rules,
  string_agg('file_' || lower(o_orderstatus), ',' ORDER BY p) AS sources,
  string_agg('input ' || o_orderstatus || '=none', '; ' ORDER BY p) || '; derived' AS missingness_reason
FROM parts p GROUP BY 1
""")
def derived_provenance(spark, sf_dir):
    """Provenance of one result per priority out of its statuses, united in the order of the inputs."""
    day, status = F.to_date("o_orderdate"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.max(day).alias("available_at"), F.min(day).alias("observation_start"), F.date_add(F.max(day), 1).alias("observation_end"),
        F.count(F.lit(1)).alias("n"),
    )
    source = F.struct(
        F.concat(F.lit("file_"), F.lower(status)).alias("source_key"), status.alias("name"), F.lit(None).cast("string").alias("url"),
        F.col("available_at").alias("release_date"), F.lit(None).cast("string").alias("release_missingness_reason"),
        F.col("available_at").cast("timestamp").alias("retrieved_at"), F.sha2(status, 256).alias("sha256"),
        F.lit("v1").alias("vintage"), F.lit(False).alias("provisional"),
    )
    provenance = rows.select(
        "o_orderpriority", "available_at", "observation_start", "observation_end",
        F.when(status == "P", 0).when(status == "F", 1).otherwise(2).alias("position"),
        F.concat(F.lit("input "), status).alias("role"), F.lit("none").alias("missingness_reason"), F.array(source).alias("sources"),
        F.array(F.concat(F.lit("sum "), status), F.lit("by month"), F.concat(F.lit("rows "), (F.col("n") % 2).cast("string")))
        .alias("aggregation_rules"),
        F.array(F.lit("count-v1")).alias("transformation_ids"), F.array().cast("array<string>").alias("notes"),
    )
    made = batch.derived_provenance(provenance, ["o_orderpriority"], "position", ["year"], "divide", "rate-v1", "derived")
    return made.select(
        "o_orderpriority", "available_at", "observation_start", F.array_join("aggregation_rules", ",").alias("rules"),
        F.array_join(F.transform("sources", lambda x: x["source_key"]), ",").alias("sources"), "missingness_reason",
    )
