"""Table layouts, key lists and closed vocabularies.

Every value below is fixed by the published data contract.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, DT, TS, NTZ = (
    T.StringType(),
    T.DoubleType(),
    T.BooleanType(),
    T.DateType(),
    T.TimestampType(),
    T.TimestampNTZType(),
)


def layout(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def texts(*names: str) -> list[tuple[str, T.DataType]]:
    return [(name, S) for name in names]


# --- fixed values: vocabularies -------------------------------------------------

DOMAINS = (
    "demographic",
    "environmental",
    "health_system",
    "market_quote",
    "regulatory_rate",
    "regulatory_mortality_table",
    "pension_product_statistic",
)
ROLES = (
    "observed_fact",
    "external_projection",
    "administrative_proxy",
    "market_quote",
    "regulatory_input",
    "diagnostic_control",
    "product_statistic",
    "covariate",
)
PARITY_SCOPES = ("not_applicable", "all_orders", "known_order", "unknown_order")
RELEASE_REASONS = ("publisher_date_not_available",)

MARKET_QUOTE_TYPES = (
    "benchmark_yield",
    "swap_fixed_rate",
    "fixing",
    "published_index",
    "published_change",
)
RATE_QUOTE_TYPES = ("benchmark_yield", "swap_fixed_rate")
REGULATORY_QUOTE_TYPES = (
    "published_zero_rate",
    "regulatory_discount_rate",
    "asset_sufficiency_irr",
    "technical_rate_input",
    "technical_rate",
)
COMPOUNDING = (
    "simple",
    "continuous",
    "annual_compounded",
    "semiannual_compounded",
    "quarterly_compounded",
    "monthly_compounded",
)
DAY_COUNTS = ("actual_360", "actual_365_fixed", "actual_actual", "thirty_360", "business_252")
REGULATORY_RATE_BASES = ("NCG_209", "VTD_CMF", "TITRP")
MORTALITY_BASIS = "TM_2020"
ENTITY_TYPES = ("insurer", "afp", "market_total")
PENSION_TYPES = ("not_applicable", "old_age", "disability", "survivor")
MODALITIES = (
    "not_applicable",
    "programmed_withdrawal",
    "temporary_annuity",
    "immediate_annuity",
    "deferred_annuity",
    "combined_annuity",
    "temporarily_increased_annuity",
)
OFFER_TYPES = ("not_applicable", "internal", "external")
INTERMEDIATION_TYPES = ("not_applicable",)
CONTRACT_STATES = ("not_applicable", "contracted", "active", "receiving")

# (semantic_kind, unit, population_basis) combinations a value may carry
_PEOPLE = ("census_enumerated", "resident_estimate", "pensioner")
_RATE_BASES = (
    "not_applicable",
    "census_enumerated",
    "resident_estimate",
    "person_time",
    "pensioner",
)
SEMANTICS = {
    "count": {"person": _PEOPLE, "event": ("not_applicable", *_PEOPLE)},
    "exposure": {"person * year": ("resident_estimate", "person_time", "pensioner")},
    "population": {"person": _PEOPLE},
    "rate": {"1 / year": _RATE_BASES, "1 / month": _RATE_BASES},
    "probability": {
        "dimensionless": ("not_applicable", "resident_estimate", "pensioner"),
        "percent": ("not_applicable", "resident_estimate", "pensioner"),
    },
    "index": {
        unit: ("not_applicable",)
        for unit in (
            "dimensionless",
            "percent",
            "day",
            "degree_Celsius",
            "millimeter",
            "microgram / meter ** 3",
        )
    },
    "price": {"CLP": ("not_applicable",), "UF": ("not_applicable",)},
    "amount": {"CLP": ("not_applicable",), "UF": ("not_applicable",)},
    "signed_amount": {"CLP": ("not_applicable",), "UF": ("not_applicable",)},
    "discount_factor": {"dimensionless": ("not_applicable",)},
}
SEMANTIC_TRIPLES = tuple(
    (kind, unit, basis)
    for kind, units in SEMANTICS.items()
    for unit, bases in units.items()
    for basis in bases
)
# physical dimension of each unit, for unit compatibility checks
UNIT_DIMENSION = {
    "person": "person",
    "event": "event",
    "person * year": "person * time",
    "1 / year": "1 / time",
    "1 / month": "1 / time",
    "dimensionless": "1",
    "percent": "1",
    "day": "time",
    "degree_Celsius": "temperature",
    "millimeter": "length",
    "microgram / meter ** 3": "mass / length ** 3",
    "CLP": "currency CLP",
    "UF": "currency UF",
}

# (variable, quote type, currency, indexation, instrument) a quoted curve may carry
QUOTED_INSTRUMENTS = (
    ("official_benchmark_yield", "benchmark_yield", "CLP", "nominal", "bcp_benchmark_bond"),
    ("official_benchmark_yield", "benchmark_yield", "UF", "UF", "bcu_btu_benchmark_bond"),
    ("official_swap_fixed_rate", "swap_fixed_rate", "CLP", "nominal", "spc_nominal_fixed_swap"),
    ("official_swap_fixed_rate", "swap_fixed_rate", "UF", "UF", "spc_uf_fixed_swap"),
)
# series specification by quote type: source unit, canonical unit, kind, role
SERIES_SEMANTICS = {
    "benchmark_yield": ("percent", "1 / year", "rate", "market_quote"),
    "swap_fixed_rate": ("percent", "1 / year", "rate", "market_quote"),
    "fixing": ("CLP", "CLP", "price", "covariate"),
    "published_index": ("index_points", "dimensionless", "index", "covariate"),
    "published_change": ("percent", "percent", "index", "covariate"),
}
# (basis, quote type, variable, instrument, greatest tenor) of a published regulatory curve
REGULATORY_CURVES = (
    ("VTD_CMF", "regulatory_discount_rate", "cmf_regulatory_discount_rate",
     "cmf_vtd_spot_rate_ac", 120),
    ("VTD_CMF", "published_zero_rate", "cmf_published_real_zero_rate",
     "cmf_vtd_real_zero_curve", 25),
    ("TITRP", "technical_rate_input", "programmed_withdrawal_real_zero_input",
     "titrp_real_zero_input", 20),
    ("TITRP", "technical_rate_input", "programmed_withdrawal_prescribed_vector_rate",
     "titrp_prescribed_rate_vector", 20),
    ("TITRP", "technical_rate", "programmed_withdrawal_technical_rate",
     "programmed_withdrawal_technical_rate", None),
)
REGULATORY_PAIRINGS = (
    ("VTD_CMF", "published_zero_rate"),
    ("VTD_CMF", "regulatory_discount_rate"),
    ("NCG_209", "asset_sufficiency_irr"),
    ("TITRP", "technical_rate_input"),
    ("TITRP", "technical_rate"),
)
PRODUCT_STATISTICS = (
    ("annuity_new_business_mean_rate", "rate", "1 / year"),
    ("annuity_policy_count", "count", "event"),
    ("annuity_single_premium", "amount", "UF"),
    ("annuity_average_premium", "amount", "UF"),
    ("intermediation_commission_rate", "index", "percent"),
    ("intermediation_commission_amount", "amount", "UF"),
    ("scomp_selected_pension_count", "count", "event"),
    ("scomp_selected_pension_share", "index", "percent"),
)
# term code: role, shape, unit, integral, maximum, most rows per set
PRODUCT_TERMS = {
    "guarantee_years": ("contract_term", "scalar", "year", True, None, None),
    "guarantee_years_band": ("published_aggregate_grouping", "interval", "year", True, None, 1),
    "survivor_percentage": ("contract_term", "scalar", "dimensionless", False, 1.0, None),
    "survivor_percentage_band": (
        "published_aggregate_grouping", "interval", "dimensionless", False, 1.0, 1),
    "temporary_increase_months": ("contract_term", "scalar", "month", True, None, None),
    "temporary_increase_months_band": (
        "published_aggregate_grouping", "interval", "month", True, None, 1),
    "temporary_increase_percentage": ("contract_term", "scalar", "dimensionless", False, 1.0, None),
    "temporary_increase_percentage_band": (
        "published_aggregate_grouping", "interval", "dimensionless", False, 1.0, 1),
}

# --- fixed values: layouts ------------------------------------------------------

ENVELOPE = layout(
    *texts("fact_id", "observation_id", "release_id", "domain", "variable"),
    ("value", D),
    *texts("semantic_kind", "unit", "population_basis", "observation_role", "parity_scope"),
    ("period_start", DT),
    ("period_end", DT),
    *texts("source_key", "vintage"),
    ("released_at", DT),
    ("release_missingness_reason", S),
    ("available_at", TS),
    ("provisional", B),
    *texts(
        "transformation_id",
        "transformation_version",
        "aggregation_rule",
        "missingness_reason",
        "source_status_code",
    ),
)
ENVELOPE_COLUMNS = tuple(ENVELOPE.fieldNames())
ID_COLUMNS = ("fact_id", "observation_id", "release_id")
NONBLANK_ENVELOPE = (
    "fact_id",
    "observation_id",
    "release_id",
    "domain",
    "variable",
    "semantic_kind",
    "unit",
    "population_basis",
    "observation_role",
    "parity_scope",
    "source_key",
    "vintage",
    "aggregation_rule",
    "missingness_reason",
)

DOMAIN_LAYOUT = {
    "demographic": layout(
        ("age_lower", D),
        ("age_upper", D),
        ("age_open", B),
        *texts("sex", "region", "cause", "date_basis", "age_role", "age_measure_unit"),
        ("age_quantity", D),
        *texts(
            "sex_role",
            "commune",
            "geography_basis",
            "geography_vintage",
            "cause_code_system",
            "cause_role",
            "external_cause",
        ),
        ("registration_start", NTZ),
        ("registration_end", NTZ),
        ("birth_order", D),
        *texts(
            "nationality",
            "nationality_role",
            "country_of_birth",
            "education_level",
            "residence_five_years_ago",
            "migration_status",
        ),
    ),
    "environmental": layout(
        *texts(
            "station",
            "region",
            "commune",
            "geography_basis",
            "geography_vintage",
            "pollutant",
            "environmental_measure",
            "averaging_interval",
            "validation_status",
        )
    ),
    "health_system": layout(
        *texts(
            "facility",
            "health_service",
            "region",
            "commune",
            "geography_basis",
            "geography_vintage",
            "service_measure",
            "capacity_measure",
            "event_measure",
            "reporting_grain",
        )
    ),
    "market_quote": layout(
        *texts("source_series_id", "quote_type"),
        ("tenor_years", D),
        *texts(
            "currency",
            "indexation",
            "instrument_type",
            "compounding",
            "day_count",
            "date_basis",
        ),
    ),
    "regulatory_rate": layout(
        *texts("regulatory_basis", "regulatory_use", "quote_type"),
        ("effective_start", DT),
        ("effective_end", DT),
        ("maximum_effective_end", DT),
        ("tenor_years", D),
        *texts(
            "financial_entity_id",
            "financial_entity_type",
            "currency",
            "indexation",
            "instrument_type",
            "compounding",
            "day_count",
        ),
    ),
    "regulatory_mortality_table": layout(
        *texts("regulatory_basis", "mortality_table_id"),
        ("age", D),
        *texts("sex", "population_segment"),
        ("reference_year", D),
        ("improvement_year", D),
        ("effective_start", DT),
        ("effective_end", DT),
        ("maximum_effective_end", DT),
    ),
    "pension_product_statistic": layout(
        *texts(
            "financial_entity_id",
            "financial_entity_type",
            "pension_type",
            "modality",
            "offer_type",
            "intermediation_type",
            "contract_state",
            "aggregation_grain",
            "product_term_set_id",
        )
    ),
}

SHARED_KEY = (
    "variable",
    "semantic_kind",
    "unit",
    "population_basis",
    "observation_role",
    "parity_scope",
    "period_start",
    "period_end",
    "aggregation_rule",
)
DOMAIN_KEY = {
    domain: (*SHARED_KEY, *fields.fieldNames()) for domain, fields in DOMAIN_LAYOUT.items()
}
# keys on which two demographic tables are compared
COMPARISON_KEY = (
    "variable",
    "semantic_kind",
    "unit",
    "population_basis",
    "period_start",
    "period_end",
    *DOMAIN_LAYOUT["demographic"].fieldNames(),
)
DISPLAY_DIMENSIONS = {
    "demographic": ("age_lower", "age_upper", "age_open", "sex", "region", "commune", "cause"),
    "environmental": ("station", "region", "commune", "pollutant", "environmental_measure"),
    "health_system": ("facility", "health_service", "region", "commune", "reporting_grain"),
    "market_quote": (
        "source_series_id",
        "quote_type",
        "tenor_years",
        "currency",
        "indexation",
        "instrument_type",
    ),
    "regulatory_rate": (
        "regulatory_basis",
        "regulatory_use",
        "quote_type",
        "effective_start",
        "effective_end",
        "maximum_effective_end",
        "tenor_years",
        "financial_entity_id",
        "financial_entity_type",
        "currency",
        "indexation",
        "instrument_type",
    ),
    "regulatory_mortality_table": tuple(
        DOMAIN_LAYOUT["regulatory_mortality_table"].fieldNames()
    ),
    "pension_product_statistic": tuple(DOMAIN_LAYOUT["pension_product_statistic"].fieldNames()),
}

OPTIONAL_DEMOGRAPHIC_TEXT = (
    "date_basis",
    "age_role",
    "age_measure_unit",
    "sex_role",
    "commune",
    "geography_basis",
    "geography_vintage",
    "cause_code_system",
    "cause_role",
    "external_cause",
    "nationality",
    "nationality_role",
    "country_of_birth",
    "education_level",
    "residence_five_years_ago",
    "migration_status",
)

ASSETS = layout(
    ("release_id", S),
    ("source_key", S),
    ("sha256", S),
    ("available_at", TS),
    ("released_at", DT),
    ("release_missingness_reason", S),
)


def domain_schema(domain: str) -> T.StructType:
    """Envelope columns followed by the domain's own dimensions."""
    return T.StructType([*ENVELOPE.fields, *DOMAIN_LAYOUT[domain].fields])
