"""Rule sets of the envelope and of the seven domains.

Rules are data: a list of ``Rule`` per table. Key uniqueness is a table rule and is
checked by ``domain_report`` together with the row rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan import contracts as C
from factspan.functions import dates, text
from factspan.functions.identity import DEFAULT, Scheme
from factspan.functions.numbers import finite, integral, known
from factspan.operators.rules import (
    Rule,
    check,
    check_absent,
    check_constant,
    check_not_empty,
    check_unique,
    report,
    require,
    require_schema,
)

col = F.col


def nonblank(name: str) -> Column:
    return F.coalesce(col(name).rlike(r"\S"), F.lit(False))


def blank_or_text(name: str) -> Column:
    return col(name).isNull() | nonblank(name)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _listed(names: Sequence[str], rows: Sequence[tuple[str, ...]]) -> Column:
    """Tuple membership in a fixed list; a null part is never a member."""
    mark = "\u001f"
    return F.concat_ws(mark, *names).isin(*[mark.join(row) for row in rows])


def _implies(condition: Column, then: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(then, F.lit(False))


def _null_or(value: Column, then: Column) -> Column:
    return value.isNull() | F.coalesce(then, F.lit(False))


def semantics_ok() -> Column:
    """(semantic_kind, unit, population_basis) is one of the allowed combinations."""
    return _listed(("semantic_kind", "unit", "population_basis"), C.SEMANTIC_TRIPLES)


def payload_rules() -> list[Rule]:
    """Envelope rules that can be checked before identifiers exist."""
    value = known(col("value"))
    return [
        Rule("domain_known", col("domain").isin(*C.DOMAINS)),
        Rule("role_known", col("observation_role").isin(*C.ROLES)),
        Rule("parity_known", col("parity_scope").isin(*C.PARITY_SCOPES)),
        Rule("semantics_compatible", semantics_ok()),
        Rule("value_finite_or_missing", value.isNull() | finite(value)),
        Rule(
            "missing_value_explained",
            value.isNotNull()
            | (
                nonblank("missingness_reason")
                & (col("missingness_reason") != "not_applicable_observed")
            ),
        ),
        Rule("period_half_open", col("period_start") < col("period_end")),
        Rule("available_at_present", col("available_at").isNotNull()),
        Rule(
            "release_date_or_reason",
            (col("released_at").isNotNull() & col("release_missingness_reason").isNull())
            | (
                col("released_at").isNull()
                & col("release_missingness_reason").isin(*C.RELEASE_REASONS)
            ),
        ),
        Rule(
            "transformation_paired",
            (col("transformation_id").isNull() & col("transformation_version").isNull())
            | (nonblank("transformation_id") & nonblank("transformation_version")),
        ),
        *[
            Rule(f"{name}_nonblank", nonblank(name))
            for name in C.NONBLANK_ENVELOPE
            if name not in C.ID_COLUMNS
        ],
        Rule("source_key_snake_case", col("source_key").rlike(r"^[a-z0-9][a-z0-9_]*$")),
        Rule("source_status_code_text", blank_or_text("source_status_code")),
    ]


def envelope_rules(scheme: Scheme = DEFAULT) -> list[Rule]:
    return [
        Rule("fact_id_form", col("fact_id").rlike(scheme.pattern("fact"))),
        Rule("observation_id_form", col("observation_id").rlike(scheme.pattern("observation"))),
        Rule("release_id_form", col("release_id").rlike(scheme.pattern("release"))),
        *payload_rules(),
    ]


def _texts(required: Sequence[str], optional: Sequence[str]) -> list[Rule]:
    return [Rule(f"{n}_nonblank", nonblank(n)) for n in required] + [
        Rule(f"{n}_text_or_null", blank_or_text(n)) for n in optional
    ]


def _vocabulary(name: str, values: Sequence[str], optional: bool = False) -> Rule:
    member = col(name).isin(*values)
    return Rule(f"{name}_known", _null_or(col(name), member) if optional else member)


def _positive_or_null(name: str) -> Rule:
    value = known(col(name))
    return Rule(f"{name}_positive", _null_or(value, finite(value) & (value > 0)))


def _value_ranges() -> Column:
    """Counts, prices, amounts and probabilities are bounded; rates may be negative."""
    value, kind = known(col("value")), col("semantic_kind")
    return _null_or(
        value,
        _implies(kind.isin("count", "price", "amount", "probability"), value >= 0)
        & _implies(kind == "count", value == F.floor(value))
        & _implies(kind == "probability", value <= 1)
        & _implies(kind == "discount_factor", value > 0),
    )


def _effective_interval() -> Rule:
    start, end, limit = col("effective_start"), col("effective_end"), col("maximum_effective_end")
    return Rule(
        "effective_interval_ordered",
        start.isNotNull()
        & _null_or(end, end > start)
        & _null_or(limit, limit > start)
        & (end.isNull() | limit.isNull() | (end <= limit)),
    )


def _regulatory_envelope(role: str) -> Rule:
    return Rule(
        "role_parity_basis",
        (col("parity_scope") == "not_applicable")
        & (col("observation_role") == role)
        & (col("population_basis") == "not_applicable"),
    )


def demographic_rules() -> list[Rule]:
    lower, upper, is_open = known(col("age_lower")), known(col("age_upper")), col("age_open")
    low_ok, high_ok = finite(lower) & (lower >= 0), finite(upper) & (upper >= 0)
    births, parity, order = col("variable") == "births", col("parity_scope"), col("birth_order")
    start, end = col("registration_start"), col("registration_end")
    return [
        Rule("domain_demographic", col("domain") == "demographic"),
        Rule(
            "age_state",
            (lower.isNull() & upper.isNull() & ~is_open)
            | (low_ok & high_ok & ~is_open & (upper > lower))
            | (low_ok & upper.isNull() & is_open),
        ),
        Rule(
            "age_quantity_range",
            _null_or(known(col("age_quantity")), finite(col("age_quantity"))
                     & (col("age_quantity") >= 0)),
        ),
        *_texts(("sex", "region", "cause"), C.OPTIONAL_DEMOGRAPHIC_TEXT),
        Rule("registration_paired", (start.isNull() & end.isNull()) | (end > start)),
        Rule(
            "parity_state",
            (~births & (parity == "not_applicable") & order.isNull())
            | (births & parity.isin("all_orders", "unknown_order") & order.isNull())
            | (births & (parity == "known_order") & integral(order) & (order >= 1)),
        ),
    ]


def environmental_rules() -> list[Rule]:
    pollutant = col("pollutant").isNotNull()
    concentration = (
        (col("semantic_kind") == "index")
        & (col("unit") == "microgram / meter ** 3")
        & (col("population_basis") == "not_applicable")
    )
    return [
        Rule("domain_environmental", col("domain") == "environmental"),
        *_texts(
            ("region", "environmental_measure", "averaging_interval", "validation_status"),
            ("station", "commune", "geography_basis", "geography_vintage", "pollutant"),
        ),
        Rule("pollutant_measured_at_station", _implies(pollutant, nonblank("station"))),
        Rule("pollutant_semantics", _implies(pollutant, concentration)),
        Rule(
            "concentration_names_pollutant",
            _implies(col("environmental_measure") == "concentration", pollutant),
        ),
    ]


def health_system_rules() -> list[Rule]:
    return [
        Rule("domain_health_system", col("domain") == "health_system"),
        *_texts(
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
    ]


def market_quote_rules() -> list[Rule]:
    quote, kind, unit = col("quote_type"), col("semantic_kind"), col("unit")
    curve = quote.isin(*C.RATE_QUOTE_TYPES)
    unit_fixing = (col("variable") == "uf_fixing_clp") | (col("instrument_type") == "uf_fixing")
    return [
        Rule("domain_market_quote", col("domain") == "market_quote"),
        _vocabulary("quote_type", C.MARKET_QUOTE_TYPES),
        _vocabulary("compounding", C.COMPOUNDING, optional=True),
        _vocabulary("day_count", C.DAY_COUNTS, optional=True),
        *_texts(
            ("source_series_id", "currency", "indexation", "instrument_type", "date_basis"),
            ("compounding", "day_count"),
        ),
        Rule(
            "role_parity_basis",
            (col("parity_scope") == "not_applicable")
            & (col("population_basis") == "not_applicable")
            & (col("observation_role") == F.when(curve, "market_quote").otherwise("covariate")),
        ),
        _positive_or_null("tenor_years"),
        Rule(
            "quote_semantics",
            (curve & (kind == "rate") & (unit == "1 / year"))
            | ((quote == "fixing") & (kind == "price"))
            | (
                (quote == "published_index")
                & (col("variable") == "consumer_price_index")
                & (kind == "index")
                & (unit == "dimensionless")
            )
            | (
                (quote == "published_change")
                & (col("variable") == "consumer_price_change")
                & (kind == "index")
                & (unit == "percent")
            ),
        ),
        Rule(
            "instrument_grain",
            _implies(
                curve,
                _listed(
                    ("variable", "quote_type", "currency", "indexation", "instrument_type"),
                    C.QUOTED_INSTRUMENTS,
                ),
            ),
        ),
        Rule("value_range", _value_ranges()),
        Rule(
            "unit_fixing_shape",
            _implies(
                unit_fixing,
                (col("variable") == "uf_fixing_clp")
                & (quote == "fixing")
                & (kind == "price")
                & (unit == "CLP")
                & (col("currency") == "CLP")
                & (col("indexation") == "UF")
                & (col("instrument_type") == "uf_fixing")
                & col("tenor_years").isNull()
                & col("compounding").isNull()
                & col("day_count").isNull(),
            ),
        ),
    ]


def regulatory_rate_rules() -> list[Rule]:
    tenor = known(col("tenor_years"))
    no_entity = col("financial_entity_id").isNull() & col("financial_entity_type").isNull()
    published = (
        (col("currency") == "UF")
        & (col("indexation") == "UF")
        & (col("compounding") == "annual_compounded")
        & col("day_count").isNull()
        & no_entity
    )
    curves = [
        _listed(
            ("regulatory_basis", "quote_type", "variable", "instrument_type"),
            [(basis, quote, variable, instrument)],
        )
        & published
        & (
            tenor.isNull()
            if longest is None
            else (integral(tenor) & (tenor > 0) & (tenor <= longest))
        )
        for basis, quote, variable, instrument, longest in C.REGULATORY_CURVES
    ]
    insurer = (
        (col("regulatory_basis") == "NCG_209")
        & (col("quote_type") == "asset_sufficiency_irr")
        & (col("variable") == "insurer_asset_sufficiency_irr")
        & (col("currency") == "not_applicable")
        & (col("indexation") == "not_applicable")
        & (col("instrument_type") == "insurer_asset_sufficiency_irr")
        & col("compounding").isNull()
        & col("day_count").isNull()
        & tenor.isNull()
        & col("financial_entity_id").isNotNull()
        & (col("financial_entity_type") == "insurer")
    )
    return [
        Rule("domain_regulatory_rate", col("domain") == "regulatory_rate"),
        _vocabulary("regulatory_basis", C.REGULATORY_RATE_BASES),
        _vocabulary("quote_type", C.REGULATORY_QUOTE_TYPES),
        _vocabulary("financial_entity_type", C.ENTITY_TYPES, optional=True),
        _vocabulary("compounding", C.COMPOUNDING, optional=True),
        _vocabulary("day_count", C.DAY_COUNTS, optional=True),
        _regulatory_envelope("regulatory_input"),
        *_texts(
            ("regulatory_use", "currency", "indexation", "instrument_type"),
            ("financial_entity_id", "financial_entity_type", "compounding", "day_count"),
        ),
        Rule(
            "entity_paired",
            col("financial_entity_id").isNull() == col("financial_entity_type").isNull(),
        ),
        Rule(
            "rate_semantics",
            (col("semantic_kind") == "rate")
            & (col("unit") == "1 / year")
            & (col("population_basis") == "not_applicable"),
        ),
        Rule(
            "basis_matches_quote",
            _listed(("regulatory_basis", "quote_type"), C.REGULATORY_PAIRINGS),
        ),
        Rule("published_grain", _any([*curves, insurer])),
        Rule("value_range", _value_ranges()),
        _positive_or_null("tenor_years"),
        _effective_interval(),
    ]


def regulatory_mortality_rules() -> list[Rule]:
    base_year, step = known(col("reference_year")), known(col("improvement_year"))
    probability = (
        (col("variable") == "regulatory_mortality_probability")
        & (col("semantic_kind") == "probability")
        & (col("unit") == "dimensionless")
        & (col("population_basis") == "pensioner")
        & step.isNull()
    )
    factor = (
        (col("variable") == "regulatory_mortality_improvement_factor")
        & (col("semantic_kind") == "index")
        & (col("unit") == "dimensionless")
        & (col("population_basis") == "not_applicable")
        & step.isNotNull()
        & _null_or(known(col("value")), col("value") >= 0)
    )
    return [
        Rule("domain_mortality", col("domain") == "regulatory_mortality_table"),
        Rule("regulatory_basis_known", col("regulatory_basis") == C.MORTALITY_BASIS),
        Rule(
            "role_and_parity",
            (col("parity_scope") == "not_applicable")
            & (col("observation_role") == "regulatory_input"),
        ),
        *_texts(("mortality_table_id", "sex", "population_segment"), ()),
        Rule("age_integral", integral(col("age")) & (col("age") >= 0)),
        Rule("reference_year_integral", integral(base_year) & (base_year >= 0)),
        Rule("improvement_year_integral", _null_or(step, integral(step) & (step >= 0))),
        Rule("mortality_semantics", (probability | factor) & _value_ranges()),
        Rule(
            "table_vintage",
            (base_year == 2020)
            & (col("population_segment") == "pensioner")
            & (col("effective_start") == F.lit(date(2023, 7, 1)))
            & (col("maximum_effective_end") == F.lit(date(2029, 7, 1))),
        ),
        _effective_interval(),
    ]


def pension_product_rules() -> list[Rule]:
    signed = col("semantic_kind") == "signed_amount"
    ordinary = (col("observation_role") == "product_statistic") & _listed(
        ("variable", "semantic_kind", "unit"), C.PRODUCT_STATISTICS
    )
    neutral = (
        "pension_type",
        "modality",
        "offer_type",
        "intermediation_type",
        "contract_state",
    )
    return [
        Rule("domain_pension_product", col("domain") == "pension_product_statistic"),
        _vocabulary("financial_entity_type", C.ENTITY_TYPES),
        _vocabulary("pension_type", C.PENSION_TYPES),
        _vocabulary("modality", C.MODALITIES),
        _vocabulary("offer_type", C.OFFER_TYPES),
        _vocabulary("intermediation_type", C.INTERMEDIATION_TYPES),
        _vocabulary("contract_state", C.CONTRACT_STATES),
        _vocabulary("aggregation_grain", C.ENTITY_TYPES),
        *_texts(("financial_entity_id",), ("product_term_set_id",)),
        Rule("entity_matches_grain", col("financial_entity_type") == col("aggregation_grain")),
        Rule(
            "statistic_semantics",
            (col("parity_scope") == "not_applicable")
            & (col("population_basis") == "not_applicable")
            & (ordinary | signed)
            & _value_ranges(),
        ),
        Rule(
            "signed_amount_shape",
            _implies(
                signed,
                (col("variable") == "asset_sufficiency_balance")
                & (col("unit") == "UF")
                & (col("observation_role") == "regulatory_input")
                & (col("financial_entity_type") == "insurer")
                & (col("aggregation_grain") == "insurer")
                & _all([col(n) == "not_applicable" for n in neutral])
                & col("product_term_set_id").isNull(),
            ),
        ),
    ]


DOMAIN_RULES = {
    "demographic": demographic_rules,
    "environmental": environmental_rules,
    "health_system": health_system_rules,
    "market_quote": market_quote_rules,
    "regulatory_rate": regulatory_rate_rules,
    "regulatory_mortality_table": regulatory_mortality_rules,
    "pension_product_statistic": pension_product_rules,
}


def domain_report(
    df: DataFrame, domain: str, scheme: Scheme = DEFAULT, extra: Sequence[Rule] = ()
) -> DataFrame:
    """Every row, table and key rule of a domain: one line per rule."""
    require_schema(df, C.domain_schema(domain))
    rules = {r.id: r for r in [*envelope_rules(scheme), *DOMAIN_RULES[domain](), *extra]}
    return report(
        check_not_empty(df),
        check(df, list(rules.values())),
        check_unique(df, ("release_id", "fact_id"), "fact_unique_in_release"),
        check_unique(df, C.DOMAIN_KEY[domain], "domain_key_unique"),
    )


def validate(
    df: DataFrame, domain: str, scheme: Scheme = DEFAULT, extra: Sequence[Rule] = ()
) -> DataFrame:
    """The table itself when it meets its domain contract, an error otherwise."""
    require(domain_report(df, domain, scheme, extra))
    return df


def one_release_report(df: DataFrame) -> DataFrame:
    """A batch holds one domain, one release and one clock."""
    return check_constant(df, ("domain", "release_id", "available_at"), "one_release_batch")


# --- side tables ---------------------------------------------------------------


def asset_rules() -> list[Rule]:
    return [
        Rule("source_key_snake_case", col("source_key").rlike(r"^[a-z0-9][a-z0-9_]*$")),
        Rule("sha256_form", col("sha256").rlike("^[0-9a-f]{64}$")),
        Rule("available_at_present", col("available_at").isNotNull()),
        Rule(
            "release_date_or_reason",
            (col("released_at").isNotNull() & col("release_missingness_reason").isNull())
            | (
                col("released_at").isNull()
                & col("release_missingness_reason").isin(*C.RELEASE_REASONS)
            ),
        ),
    ]


def asset_report(assets: DataFrame, primary: str | None = None) -> DataFrame:
    parts = [
        check(assets, asset_rules()),
        check_unique(assets, ("release_id", "source_key"), "source_key_unique"),
    ]
    if primary is not None:
        without = (
            assets.groupBy("release_id")
            .agg(F.count_if(col("source_key") == primary).alias("n"))
            .agg(
                F.lit("primary_asset_present").alias("rule_id"),
                F.count_if(col("n") != 1).alias("failed"),
                F.lit(None).cast("string").alias("sample_key"),
            )
        )
        parts.append(without)
    return report(*parts)


def provenance_rules() -> list[Rule]:
    def each_nonblank(name: str) -> Column:
        return F.forall(col(name), lambda x: x.rlike(r"\S"))

    return [
        Rule("has_source", F.size("sources") >= 1),
        Rule(
            "observation_dates_ordered",
            col("observation_start") < col("observation_end"),
        ),
        Rule(
            "dimensions_unique",
            each_nonblank("dimensions")
            & (F.size("dimensions") == F.size(F.array_distinct("dimensions"))),
        ),
        Rule("rules_nonblank", (F.size("aggregation_rules") >= 1)
             & each_nonblank("aggregation_rules")),
        Rule("reason_nonblank", nonblank("missingness_reason")),
    ]


def alias_rules() -> list[Rule]:
    label = col("label")
    return [
        Rule("entity_id_canonical", text.entity_rut(col("entity_id")) == col("entity_id")),
        Rule("label_trimmed", nonblank("label") & (text.strip(label) == label)
             & ~label.rlike(r"\p{C}")),
        Rule("source_key_snake_case", col("source_key").rlike(r"^[a-z0-9][a-z0-9_]*$")),
        Rule("interval_ordered", col("valid_start").isNotNull()
             & _null_or(col("valid_end"), col("valid_start") < col("valid_end"))),
    ]


def entity_rules() -> list[Rule]:
    """Entity type and identifier agree: the market total, or a canonical tax number."""
    total = col("entity_type") == "market_total"
    return [
        Rule("entity_type_known", col("entity_type").isin(*C.ENTITY_TYPES)),
        Rule(
            "entity_id_matches_type",
            F.when(total, col("entity_id") == "market:total").otherwise(
                text.entity_rut(col("entity_id")) == col("entity_id")
            ),
        ),
    ]


def bin_rules() -> list[Rule]:
    return [
        Rule("lower_finite", finite(col("age_lower")) & (col("age_lower") >= 0)),
        Rule("upper_above_lower", _null_or(known(col("age_upper")),
                                           col("age_upper") > col("age_lower"))),
    ]


def term_rules(source: str = "scomp", version: int = 1) -> list[Rule]:
    """Row rules of product terms: scalar or interval, as the vocabulary asks."""
    value, low, high = col("numeric_value"), col("lower_bound"), col("upper_bound")
    scalar = value.isNotNull() & low.isNull() & high.isNull()
    interval = value.isNull() & low.isNotNull() & high.isNotNull()
    fits = []
    for code, (role, shape, unit, whole, limit, _) in C.PRODUCT_TERMS.items():
        ok = (col("term_code") == code) & (col("term_role") == role) & (col("unit") == unit)
        if shape == "scalar":
            ok = ok & scalar & finite(value) & (value > 0)
            if whole:
                ok = ok & integral(value)
            if limit is not None:
                ok = ok & (value <= limit)
        else:
            ok = ok & interval & finite(low) & finite(high) & (low >= 0)
            if whole:
                ok = ok & integral(low) & integral(high)
            if limit is not None:
                ok = ok & (high <= limit)
        fits.append(ok)
    return [
        Rule("scalar_or_interval", scalar | (interval & (low < high))),
        Rule("ordinal_nonnegative", col("term_ordinal") >= 0),
        Rule("label_nonblank", nonblank("source_label")),
        Rule("set_matches_vocabulary", col("product_term_set_id").rlike(
            rf"^{source}:v{version}:[a-z0-9][a-z0-9_]*$")),
        Rule("term_in_vocabulary", _any(fits)),
    ]


def term_report(terms: DataFrame) -> DataFrame:
    """Row rules, contiguous ordinals from zero, and at most one row per band code."""
    by_set = terms.groupBy("product_term_set_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("term_ordinal").alias("distinct"),
        F.min("term_ordinal").alias("low"),
        F.max("term_ordinal").alias("high"),
    )
    gaps = by_set.where(
        (col("low") != 0) | (col("high") != col("n") - 1) | (col("distinct") != col("n"))
    )
    bands = [code for code, rule in C.PRODUCT_TERMS.items() if rule[5] == 1]
    repeated = (
        terms.where(col("term_code").isin(*bands))
        .groupBy("product_term_set_id", "term_code")
        .count()
        .where("count > 1")
    )
    return report(
        check(terms, term_rules()),
        check_absent(gaps, "ordinals_contiguous"),
        check_absent(repeated, "band_cardinality"),
    )


def release_rules() -> list[Rule]:
    """Release metadata: coverage ordered, published after its cutoff, dated or explained."""
    return [
        Rule("coverage_ordered", col("observation_start") <= col("observation_cutoff")),
        Rule(
            "released_after_cutoff",
            _null_or(col("released_at"), col("released_at") >= col("observation_cutoff")),
        ),
        Rule("vintage_nonblank", nonblank("vintage")),
        Rule("provisional_declared", col("provisional").isNotNull()),
    ]


def control_report(controls: DataFrame) -> DataFrame:
    """Control rows (audit, key, expected): whole, nonnegative, one per key."""
    return report(
        check(controls, [Rule("expected_nonnegative", col("expected") >= 0)]),
        check_unique(controls, ("audit", "key"), "control_key_unique"),
    )


def operator_report(weights: DataFrame) -> DataFrame:
    """Weight table (out, node, weight): finite weights, one per cell."""
    return report(
        check(weights, [Rule("weight_finite", finite(col("weight")))]),
        check_unique(weights, ("out", "node"), "weight_cell_unique"),
    )


def grouped_count_rules(value: str = "count") -> list[Rule]:
    """Bins with counts, before a rate or density is fitted to them."""
    return [*bin_rules(), Rule("count_nonnegative", finite(col(value)) & (col(value) >= 0))]


def curated_type_rules(logical: Sequence[tuple[str, str]], optional: Sequence[str] = ()
                       ) -> list[Rule]:
    """Raw text cells of a curated table against their logical type."""
    def fits(name: str, kind: str) -> Column:
        cell = col(name)
        if kind == "integer":
            return cell.rlike(r"^-?\d+$") & cell.try_cast("bigint").isNotNull()
        if kind == "float64":
            return finite(cell.try_cast("double"))
        if kind == "date":
            return dates.strict_iso(cell).isNotNull()
        if kind == "timestamp_utc":
            return cell.rlike(r"(?:Z|[+-]\d{2}:\d{2})$") & cell.try_cast("timestamp").isNotNull()
        if kind == "string":
            return cell.isNotNull()
        raise ValueError(f"unknown logical type {kind!r}")

    return [
        Rule(f"{name}_{kind}", _null_or(col(name), fits(name, kind))
             if name in optional else fits(name, kind))
        for name, kind in logical
    ]


LOGICAL_TYPES = {
    "integer": T.LongType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp_utc": T.TimestampType(),
}
