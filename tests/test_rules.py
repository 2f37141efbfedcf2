from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factspan import contracts as C
from factspan.operators import rules, rulesets
from factspan.operators.rules import ContractViolation, Rule, check, enforce, quarantine

H = "a" * 64
ENVELOPE = {
    "fact_id": f"factspan:fact:v1:{H}",
    "observation_id": f"factspan:observation:v1:{H}",
    "release_id": f"factspan:release:v1:{H}",
    "variable": "births",
    "value": 3.0,
    "semantic_kind": "count",
    "unit": "event",
    "population_basis": "not_applicable",
    "observation_role": "observed_fact",
    "parity_scope": "all_orders",
    "period_start": date(2024, 1, 1),
    "period_end": date(2025, 1, 1),
    "source_key": "source_1",
    "vintage": "v",
    "released_at": date(2025, 2, 1),
    "release_missingness_reason": None,
    "available_at": datetime(2025, 2, 2),
    "provisional": False,
    "transformation_id": None,
    "transformation_version": None,
    "aggregation_rule": "rule",
    "missingness_reason": "not_applicable_observed",
    "source_status_code": None,
}
ROWS = {
    "demographic": {
        **ENVELOPE, "age_lower": 15.0, "age_upper": 20.0, "age_open": False, "sex": "male",
        "region": "CL", "cause": "not_applicable",
    },
    "environmental": {
        **ENVELOPE, "variable": "pm25", "semantic_kind": "index", "unit": "microgram / meter ** 3",
        "parity_scope": "not_applicable", "station": "st", "region": "CL-13",
        "pollutant": "pm25", "environmental_measure": "concentration",
        "averaging_interval": "24h", "validation_status": "final",
    },
    "health_system": {
        **ENVELOPE, "variable": "beds", "parity_scope": "not_applicable", "facility": "f",
        "health_service": "s", "region": "CL-13", "service_measure": "beds",
        "capacity_measure": "installed", "event_measure": "stay", "reporting_grain": "month",
    },
    "market_quote": {
        **ENVELOPE, "variable": "official_benchmark_yield", "semantic_kind": "rate",
        "unit": "1 / year", "value": -0.01, "observation_role": "market_quote",
        "parity_scope": "not_applicable", "source_series_id": "S", "quote_type": "benchmark_yield",
        "tenor_years": 5.0, "currency": "CLP", "indexation": "nominal",
        "instrument_type": "bcp_benchmark_bond", "date_basis": "market_observation",
    },
    "regulatory_rate": {
        **ENVELOPE, "variable": "cmf_regulatory_discount_rate", "semantic_kind": "rate",
        "unit": "1 / year", "value": -0.002, "observation_role": "regulatory_input",
        "parity_scope": "not_applicable", "regulatory_basis": "VTD_CMF", "regulatory_use": "reserve",
        "quote_type": "regulatory_discount_rate", "effective_start": date(2024, 1, 1),
        "tenor_years": 120.0, "currency": "UF", "indexation": "UF",
        "instrument_type": "cmf_vtd_spot_rate_ac", "compounding": "annual_compounded",
    },
    "regulatory_mortality_table": {
        **ENVELOPE, "variable": "regulatory_mortality_probability", "semantic_kind": "probability",
        "unit": "dimensionless", "population_basis": "pensioner", "value": 0.5,
        "observation_role": "regulatory_input", "parity_scope": "not_applicable",
        "regulatory_basis": "TM_2020", "mortality_table_id": "CB-H-2020", "age": 65.0,
        "sex": "male", "population_segment": "pensioner", "reference_year": 2020.0,
        "effective_start": date(2023, 7, 1), "maximum_effective_end": date(2029, 7, 1),
    },
    "pension_product_statistic": {
        **ENVELOPE, "variable": "annuity_policy_count", "observation_role": "product_statistic",
        "parity_scope": "not_applicable", "financial_entity_id": "cl-rut:6-K",
        "financial_entity_type": "insurer", "pension_type": "old_age",
        "modality": "immediate_annuity", "offer_type": "not_applicable",
        "intermediation_type": "not_applicable", "contract_state": "contracted",
        "aggregation_grain": "insurer",
    },
}


def frame(spark, domain, *rows):
    schema = C.domain_schema(domain)
    data = [
        tuple({**ROWS[domain], "domain": domain, **row}.get(n) for n in schema.fieldNames())
        for row in rows
    ]
    return spark.createDataFrame(data, schema)


def broken(spark, domain, **changes):
    report = rulesets.domain_report(frame(spark, domain, changes), domain)
    return {r["rule_id"] for r in report.where("failed > 0").collect()}


@pytest.mark.parametrize("domain", C.DOMAINS)
def test_a_sound_row_of_every_domain_passes(spark, domain):
    assert broken(spark, domain) == set()


# (domain, change, rule that must fire)
BREAKS = [
    ("demographic", {"fact_id": "x"}, "fact_id_form"),
    ("demographic", {"semantic_kind": "population"}, "semantics_compatible"),
    ("demographic", {"value": float("inf")}, "value_finite_or_missing"),
    ("demographic", {"value": None}, "missing_value_explained"),
    ("demographic", {"period_end": date(2024, 1, 1)}, "period_half_open"),
    ("demographic", {"available_at": None}, "available_at_present"),
    ("demographic", {"released_at": None}, "release_date_or_reason"),
    ("demographic", {"release_missingness_reason": "publisher_date_not_available"},
     "release_date_or_reason"),
    ("demographic", {"transformation_id": "t"}, "transformation_paired"),
    ("demographic", {"vintage": " "}, "vintage_nonblank"),
    ("demographic", {"source_key": "Bad"}, "source_key_snake_case"),
    ("demographic", {"source_status_code": ""}, "source_status_code_text"),
    ("demographic", {"observation_role": "guess"}, "role_known"),
    ("demographic", {"age_upper": 15.0}, "age_state"),
    ("demographic", {"age_upper": None}, "age_state"),
    ("demographic", {"age_open": True}, "age_state"),
    ("demographic", {"age_quantity": -1.0}, "age_quantity_range"),
    ("demographic", {"sex": ""}, "sex_nonblank"),
    ("demographic", {"commune": " "}, "commune_text_or_null"),
    ("demographic", {"registration_start": datetime(2024, 1, 1)}, "registration_paired"),
    ("demographic", {"birth_order": 1.0}, "parity_state"),
    ("demographic", {"parity_scope": "known_order"}, "parity_state"),
    ("demographic", {"variable": "deaths"}, "parity_state"),
    ("environmental", {"station": None}, "pollutant_measured_at_station"),
    ("environmental", {"unit": "day"}, "pollutant_semantics"),
    ("environmental", {"pollutant": None}, "concentration_names_pollutant"),
    ("environmental", {"validation_status": ""}, "validation_status_nonblank"),
    ("health_system", {"domain": "environmental"}, "domain_health_system"),
    ("health_system", {"facility": None}, "facility_nonblank"),
    ("market_quote", {"quote_type": "spot"}, "quote_type_known"),
    ("market_quote", {"observation_role": "covariate"}, "role_parity_basis"),
    ("market_quote", {"tenor_years": 0.0}, "tenor_years_positive"),
    ("market_quote", {"unit": "1 / month"}, "quote_semantics"),
    ("market_quote", {"currency": "UF"}, "instrument_grain"),
    ("market_quote", {"instrument_type": "uf_fixing"}, "unit_fixing_shape"),
    ("market_quote", {"compounding": "daily"}, "compounding_known"),
    ("regulatory_rate", {"tenor_years": 121.0}, "published_grain"),
    ("regulatory_rate", {"tenor_years": 1.5}, "published_grain"),
    ("regulatory_rate", {"regulatory_basis": "TITRP"}, "basis_matches_quote"),
    ("regulatory_rate", {"financial_entity_id": "x"}, "entity_paired"),
    ("regulatory_rate", {"effective_end": date(2023, 1, 1)}, "effective_interval_ordered"),
    ("regulatory_rate", {"effective_start": None}, "effective_interval_ordered"),
    ("regulatory_rate", {"semantic_kind": "index", "unit": "percent"}, "rate_semantics"),
    ("regulatory_mortality_table", {"age": 65.5}, "age_integral"),
    ("regulatory_mortality_table", {"value": 1.5}, "mortality_semantics"),
    ("regulatory_mortality_table", {"improvement_year": 2021.0}, "mortality_semantics"),
    ("regulatory_mortality_table", {"reference_year": 2014.0}, "table_vintage"),
    ("regulatory_mortality_table", {"regulatory_basis": "TITRP"}, "regulatory_basis_known"),
    ("pension_product_statistic", {"aggregation_grain": "afp"}, "entity_matches_grain"),
    ("pension_product_statistic", {"value": 1.5}, "statistic_semantics"),
    ("pension_product_statistic", {"value": -1.0}, "statistic_semantics"),
    ("pension_product_statistic", {"semantic_kind": "signed_amount", "unit": "UF"},
     "signed_amount_shape"),
    ("pension_product_statistic", {"modality": "loan"}, "modality_known"),
]


def test_every_break_fires_its_rule(spark):
    """One row per break, checked together: each row's broken rules hold the expected one."""
    for domain in C.DOMAINS:
        cases = [(change, rule) for d, change, rule in BREAKS if d == domain]
        df = frame(spark, domain, *[change for change, _ in cases])
        every = {r.id: r for r in [*rulesets.envelope_rules(), *rulesets.DOMAIN_RULES[domain]()]}
        _, bad = quarantine(df.withColumn("__i", F.monotonically_increasing_id()),
                            list(every.values()))
        found = [set(r["broken_rules"]) for r in bad.orderBy("__i").collect()]
        assert len(found) == len(cases)
        for (change, rule), got in zip(cases, found, strict=True):
            assert rule in got, (domain, change, got)


def test_duplicate_keys_are_reported(spark):
    df = frame(spark, "demographic", {}, {})
    report = {r["rule_id"]: r["failed"] for r in rulesets.domain_report(df, "demographic").collect()}
    assert report["fact_unique_in_release"] == 2
    assert report["domain_key_unique"] == 2


def test_an_extra_column_or_empty_table_is_refused(spark):
    df = frame(spark, "demographic", {})
    with pytest.raises(ContractViolation):
        rulesets.domain_report(df.withColumn("extra", F.lit(1)), "demographic")
    with pytest.raises(ContractViolation, match="not_empty"):
        rulesets.validate(df.limit(0), "demographic")


def test_null_counts_as_failure_and_enforce_raises(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "v int")
    positive = [Rule("positive", F.col("v") > 0)]
    line = check(df, positive, key=F.col("v")).first()
    assert (line["failed"], line["sample_key"]) == (2, "-1")
    with pytest.raises(ContractViolation, match="positive: 2"):
        enforce(df, positive)
    good, bad = quarantine(df, positive)
    assert good.count() == 1
    assert bad.count() == 2


def test_check_runs_as_one_scan(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "v int")
    many = [Rule(f"r{i}", F.col("v") != i) for i in range(30)]
    plan = check(df, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_constant_rule(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "x int, y string")
    assert rules.check_constant(df, ["x"], "c").first()["failed"] == 0
    assert rules.check_constant(df, ["x", "y"], "c").first()["failed"] == 1


def test_product_terms(spark):
    columns = ("product_term_set_id string, term_ordinal int, term_code string, term_role string, "
               "numeric_value double, lower_bound double, upper_bound double, unit string, "
               "source_label string")
    years = ("scomp:v1:a", 0, "guarantee_years", "contract_term", 10.0, None, None, "year", "l")
    band = ("scomp:v1:a", 1, "guarantee_years_band", "published_aggregate_grouping", None, 0.0,
            10.0, "year", "l")
    good = spark.createDataFrame([years, band], columns)
    assert rulesets.term_report(good).where("failed > 0").count() == 0
    bad = spark.createDataFrame([years, (*band[:1], 3, *band[2:]), (*band[:1], 4, *band[2:]),
                                 (*years[:4], 1.5, *years[5:])], columns)
    fired = {r["rule_id"] for r in rulesets.term_report(bad).where("failed > 0").collect()}
    assert fired == {"ordinals_contiguous", "band_cardinality", "term_in_vocabulary"}


def test_side_table_rules(spark):
    assets = spark.createDataFrame(
        [("r", "a_1", H, datetime(2024, 1, 1), date(2024, 1, 1), None),
         ("r", "a_1", H, datetime(2024, 1, 1), date(2024, 1, 1), None)], C.ASSETS)
    fired = {r["rule_id"] for r in
             rulesets.asset_report(assets, primary="b").where("failed > 0").collect()}
    assert fired == {"source_key_unique", "primary_asset_present"}
    aliases = spark.createDataFrame(
        [("cl-rut:6-K", "Name", "k", date(2024, 1, 1), None),
         ("6-K", " Name", "K", date(2024, 1, 1), date(2023, 1, 1))],
        "entity_id string, label string, source_key string, valid_start date, valid_end date")
    assert [r["failed"] for r in check(aliases, rulesets.alias_rules()).collect()] == [1, 1, 1, 1]
    entities = spark.createDataFrame(
        [("market_total", "market:total"), ("insurer", "cl-rut:6-K"), ("insurer", "market:total"),
         ("bank", "cl-rut:6-K")], "entity_type string, entity_id string")
    assert [r["failed"] for r in check(entities, rulesets.entity_rules()).collect()] == [1, 1]
