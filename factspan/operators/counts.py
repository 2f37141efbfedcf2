"""Event counts at chosen grains, audits and control checks.

Every count is a plain grouped aggregation, so Spark combines rows before the shuffle
and a hot key costs one row per input task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.operators.reconcile import null_safe_join


def count_cube(df: DataFrame, dims: Mapping[str, Column], name: str = "value") -> DataFrame:
    """One row per combination of the dimension expressions with its event count.

    A collapsed grain is a literal; literals stay out of the grouping key.
    """
    return df.select(*[c.alias(n) for n, c in dims.items()]).groupBy(*dims).agg(
        F.count(F.lit(1)).alias(name)
    )


def count_then_parse(
    df: DataFrame,
    raw: Sequence[str],
    dims: Mapping[str, Column],
    name: str = "value",
) -> DataFrame:
    """Count by raw columns, parse each distinct combination once, sum by parsed key.

    Catalyst never moves a projection above an aggregate, so this is written out: label
    parsing then runs per distinct raw combination instead of per event.
    """
    distinct = df.groupBy(*raw).agg(F.count(F.lit(1)).alias("__n"))
    return distinct.select("__n", *[c.alias(n) for n, c in dims.items()]).groupBy(*dims).agg(
        F.sum("__n").alias(name)
    )


def sum_by_key(partials: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Merge partial counts over their full key; null keys are equal."""
    return partials.groupBy(*key).agg(F.sum(value).alias(value))


def audit_cells(cells: DataFrame, dims: Mapping[str, Column], weight: str) -> DataFrame:
    """Audit lines (audit, key, n) out of counted cells: each dimension on its own."""
    lines = [
        F.struct(F.lit(n).alias("audit"), key.cast("string").alias("key"))
        for n, key in dims.items()
    ]
    return (
        cells.select(F.col(weight).alias("__n"), F.inline(F.array(*lines)))
        .groupBy("audit", "key")
        .agg(F.sum("__n").alias("n"))
    )


def audit_counts(df: DataFrame, dims: Mapping[str, Column]) -> DataFrame:
    """Counts by each dimension on its own: (audit, key, n), in one pass over the events."""
    return audit_cells(count_cube(df, dims, "__count"), {n: F.col(n) for n in dims}, "__count")


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Any number of counted conditions as one row, in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def occurrence_bounds(
    df: DataFrame, day: Column, year: Column, cutoff: date | Column
) -> DataFrame:
    """First and last occurrence day; blank days count as their whole year up to the cutoff."""
    last = F.lit(cutoff) if isinstance(cutoff, date) else cutoff
    jan, dec = (
        lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1)),
        lambda y: F.make_date(y.cast("int"), F.lit(12), F.lit(31)),
    )
    blank = F.when(day.isNull(), year)
    bounds = df.agg(
        F.min(day).alias("d0"),
        F.max(day).alias("d1"),
        F.min(year).alias("y0"),
        F.max(year).alias("y1"),
        F.min(blank).alias("b0"),
        F.max(blank).alias("b1"),
    )
    start = F.coalesce(F.col("d0"), jan(F.col("y0")))
    end = F.coalesce(F.col("d1"), F.least(dec(F.col("y1")), last))
    return bounds.select(
        F.least(start, jan(F.col("b0"))).alias("first_day"),
        F.greatest(end, F.when(F.col("b1").isNotNull(), F.least(dec(F.col("b1")), last))).alias(
            "last_day"
        ),
    )


def control_differences(controls: DataFrame, audit: DataFrame) -> DataFrame:
    """Controls (audit, key, expected) against an audit; unlisted audit rows are allowed.

    Returns every control with the observed count and whether it agrees.
    """
    key = ["audit", "key"]
    observed = audit.select(*key, F.col("n").alias("observed"))
    return null_safe_join(controls.select(*key, "expected"), observed, key, "left").withColumn(
        "agrees", F.col("expected").eqNullSafe(F.col("observed"))
    )


def scalars_as_audit(scalars: DataFrame) -> DataFrame:
    """One row of named counts as (audit, key, n) lines, so controls compare in one way."""
    lines = [
        F.struct(
            F.lit("scalar").alias("audit"),
            F.lit(n).alias("key"),
            F.col(n).cast("bigint").alias("n"),
        )
        for n in scalars.columns
    ]
    return scalars.select(F.inline(F.array(*lines)))


def same_total(left: DataFrame, right: DataFrame, left_n: str, right_n: str) -> DataFrame:
    """Two tables must add up to the same total: one report line."""
    a = left.agg(F.coalesce(F.sum(left_n), F.lit(0)).cast("bigint").alias("n"))
    b = right.agg((-F.coalesce(F.sum(right_n), F.lit(0))).cast("bigint").alias("n"))
    return (
        a.unionAll(b)
        .agg(F.sum("n").alias("d"))
        .select(
            F.lit("count_conserved").alias("rule_id"),
            F.abs("d").alias("failed"),
            F.lit(None).cast("string").alias("sample_key"),
        )
    )


def conservation(facts: DataFrame, events: DataFrame, value: str = "value") -> DataFrame:
    """The counted total must equal the number of events."""
    return same_total(facts, events.select(F.lit(1).alias("n")), value, "n")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count (nulls are equal)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
