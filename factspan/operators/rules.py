"""Data quality rules checked in one pass.

A rule is a Boolean column that must hold on every row; null counts as a failure.
``check`` evaluates any number of rules in a single aggregation over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    id: str
    holds: Column


class ContractViolation(ValueError):
    """Raised by ``enforce``; carries (rule id, failed rows) pairs, never row content."""

    def __init__(self, failures: Sequence[tuple[str, int]]):
        self.failures = tuple(failures)
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in self.failures))


REPORT = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("failed", T.LongType()),
        T.StructField("sample_key", T.StringType()),
    ]
)


def _breaks(rule: Rule) -> Column:
    return ~F.coalesce(rule.holds, F.lit(False))


def check(df: DataFrame, rules: Sequence[Rule], key: Column | None = None) -> DataFrame:
    """Failure count per rule, one row per rule, in one pass.

    ``key`` adds one sample key per broken rule (the smallest); leave it out for
    person-level input.
    """
    if not rules:
        return df.sparkSession.createDataFrame([], REPORT)
    sample = F.lit(None).cast("string") if key is None else key.cast("string")
    marked = df.select(
        *[_breaks(rule).alias(f"b{position}") for position, rule in enumerate(rules)],
        sample.alias("key"),
    )
    totals = []
    for position in range(len(rules)):
        totals.append(F.count_if(f"b{position}").alias(f"n{position}"))
        if key is not None:
            totals.append(F.min(F.when(F.col(f"b{position}"), F.col("key"))).alias(f"k{position}"))
    lines = [
        F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.col(f"n{position}").alias("failed"),
            (F.col(f"k{position}") if key is not None else sample).alias("sample_key"),
        )
        for position, rule in enumerate(rules)
    ]
    return marked.agg(*totals).select(F.inline(F.array(*lines)))


def check_unique(
    df: DataFrame, columns: Sequence[str], rule_id: str, key: Column | None = None
) -> DataFrame:
    """Rows that share their key with another row (nulls are equal)."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    shared = F.col("rows") > 1
    return groups.agg(
        F.lit(rule_id).alias("rule_id"),
        F.coalesce(F.sum(F.when(shared, F.col("rows"))), F.lit(0)).cast("bigint").alias("failed"),
        F.min(F.when(shared, key)).cast("string").alias("sample_key")
        if key is not None
        else F.lit(None).cast("string").alias("sample_key"),
    )


def check_not_empty(df: DataFrame, rule_id: str = "not_empty") -> DataFrame:
    return df.agg(
        F.lit(rule_id).alias("rule_id"),
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("failed"),
        F.lit(None).cast("string").alias("sample_key"),
    )


def check_absent(violations: DataFrame, rule_id: str) -> DataFrame:
    """Rule over a table of violations: it must hold no row."""
    return violations.agg(
        F.lit(rule_id).alias("rule_id"),
        F.count(F.lit(1)).alias("failed"),
        F.lit(None).cast("string").alias("sample_key"),
    )


def check_constant(df: DataFrame, columns: Sequence[str], rule_id: str) -> DataFrame:
    """Columns that must hold one single value over the table."""
    spread = [
        F.coalesce(F.min(c) != F.max(c), F.lit(False))
        | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
        for c in columns
    ]
    return df.agg(
        F.lit(rule_id).alias("rule_id"),
        sum((F.when(s, 1).otherwise(0) for s in spread), F.lit(0)).cast("bigint").alias("failed"),
        F.lit(None).cast("string").alias("sample_key"),
    )


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def require(*reports: DataFrame) -> None:
    """Raise when any reported rule is broken. Reads one row per rule."""
    broken = report(*reports).where("failed > 0").orderBy("rule_id").collect()
    if broken:
        raise ContractViolation([(row["rule_id"], row["failed"]) for row in broken])


def enforce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The table itself when every rule holds, an error otherwise."""
    require(check(df, rules))
    return df


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold every rule, and the others with the ids of the rules they break."""
    broken = F.filter(
        F.array(*[F.when(_breaks(rule), F.lit(rule.id)) for rule in rules]),
        lambda rule_id: rule_id.isNotNull(),
    )
    marked = df.withColumn("broken_rules", broken)
    good = marked.where(F.size("broken_rules") == 0).drop("broken_rules")
    return good, marked.where(F.size("broken_rules") > 0)


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exact columns in exact order with exact types."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in schema.fields]
    if have != want:
        differing = [w for w in want if w not in have] + [h for h in have if h not in want]
        names = ", ".join(dict.fromkeys(name for name, _ in differing)) or "column order"
        raise ContractViolation([(f"schema: {names}", 1)])
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that must be there; others may be."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractViolation([(f"missing column {c}", 1) for c in missing])
    return df


def enforce_each(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``, failing the query on the first row for which ``holds`` is not true.

    The condition decides about rows, so no later selection or count prunes it. It is given
    through a row generator, which the optimizer neither evaluates early nor moves over joins.
    """
    failed = F.raise_error(F.lit(message)).cast("array<boolean>")
    once = F.when(F.coalesce(holds, F.lit(False)), F.array(F.lit(True))).otherwise(failed)
    return df.select("*", F.explode(once).alias("__holds")).drop("__holds")
