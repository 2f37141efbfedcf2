"""Display-only union of all domains."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.contracts import (
    DISPLAY_DIMENSIONS,
    DOMAIN_LAYOUT,
    ENVELOPE_COLUMNS,
    domain_schema,
)
from factspan.functions.structures import display_json
from factspan.operators.rules import require_schema

LONG_COLUMNS = (*ENVELOPE_COLUMNS, "projected_domain", "display_dimensions")


def _display(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, T.DoubleType):
        finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        stop = F.raise_error(F.lit(f"display dimension {name} is not finite")).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.lit(None)).when(finite, value).otherwise(stop)
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    return value


def project_domain(df: DataFrame, domain: str) -> DataFrame:
    """Envelope columns, the domain name, and its display dimensions as JSON.

    The exact domain schema is required, so an already projected table is refused.
    """
    require_schema(df, domain_schema(domain))
    kinds = {f.name: f.dataType for f in DOMAIN_LAYOUT[domain].fields}
    shown = {n: _display(n, kinds[n]) for n in DISPLAY_DIMENSIONS[domain]}
    return df.select(
        *ENVELOPE_COLUMNS,
        F.lit(domain).alias("projected_domain"),
        display_json(shown).alias("display_dimensions"),
    )


def project_long(batches: Mapping[str, DataFrame]) -> DataFrame:
    """All domains in one long table (unsorted; see ``report_order``)."""
    return reduce(DataFrame.unionAll, [project_domain(df, d) for d, df in batches.items()])


def report_order(long: DataFrame) -> DataFrame:
    return long.orderBy("projected_domain", "release_id", "observation_id")


def repeated_observations(long: DataFrame) -> DataFrame:
    """Observation ids that appear more than once across the inputs."""
    return long.groupBy("observation_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def projection_metadata(long: DataFrame) -> DataFrame:
    """Per domain: shown and left-out dimensions and the number of releases and rows."""
    shown = {d: list(DISPLAY_DIMENSIONS[d]) for d in DISPLAY_DIMENSIONS}
    omitted = {
        d: [c for c in DOMAIN_LAYOUT[d].fieldNames() if c not in DISPLAY_DIMENSIONS[d]]
        for d in DOMAIN_LAYOUT
    }

    def per_domain(values: Mapping[str, list[str]]) -> Column:
        pairs = []
        for d, names in values.items():
            listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
            pairs += [F.lit(d), listed]
        return F.element_at(F.create_map(*pairs), F.col("projected_domain"))

    return (
        long.groupBy("projected_domain", "release_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("projected_domain")
        .agg(F.count(F.lit(1)).alias("releases"), F.sum("rows").alias("rows"))
        .withColumns(
            {"selected_dimensions": per_domain(shown), "omitted_dimensions": per_domain(omitted)}
        )
    )


def source_releases(long: DataFrame) -> DataFrame:
    """Distinct (domain, release) pairs behind a projection."""
    return long.select("projected_domain", "release_id").distinct()
