"""Null-safe comparison of two or three tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.operators.rules import check_absent, check_unique, enforce_each, require

# fixed values: (matched, different) status per release kind
STATUSES = {
    "final_annual": ("reconciled_final", "different_final"),
    "provisional_annual": ("matched_provisional", "different_provisional"),
    "coyuntural_monthly": ("matched_coyuntural", "different_coyuntural"),
}


def release_kind(kind: str) -> tuple[bool, bool]:
    """(provisional, monthly) of a release kind."""
    if kind not in STATUSES:
        raise ValueError(f"unknown release kind {kind!r}")
    return kind != "final_annual", kind == "coyuntural_monthly"


def null_safe_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on key columns with nulls equal.

    The key columns of the result come from whichever side holds the row; all other
    columns must have distinct names.
    """
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in key})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in key])
    joined = left.join(other, same, how)
    rest = [c for c in joined.columns if c not in key and not c.startswith("__right_")]
    keys = [
        F.coalesce(F.col(k), F.col(f"__right_{k}")).alias(k) if how != "inner" else F.col(k)
        for k in key
    ]
    return joined.select(*keys, *rest)


def status(difference: Column, kind: str) -> Column:
    matched, different = STATUSES[kind]
    return F.when(difference == 0, matched).otherwise(different)


def compare_values(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    kind: str,
    value: str = "value",
    names: tuple[str, str] = ("left_value", "right_value"),
) -> DataFrame:
    """One-to-one comparison of two tables with unique keys: difference and status.

    Both sides grow with the input and a written one packs repeated cells far below their size in
    memory, so neither is ever sent whole to the driver: the sides are shuffled and merged.
    """
    provisional, _ = release_kind(kind)
    a, b = (
        side.select(*key, F.col(value).alias(name))
        for side, name in zip((left, right), names, strict=True)
    )
    difference = F.col(names[0]) - F.col(names[1])
    return null_safe_join(a, b.hint("merge"), key).select(
        *key,
        *names,
        difference.alias("difference"),
        status(difference, kind).alias("status"),
        F.lit(kind).alias("control_release_kind"),
        F.lit(provisional).alias("control_provisional"),
    )


def key_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held a different number of times on the two sides, nulls equal.

    Both directions in one grouped pass over the union, combined before the shuffle.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(*key, one.alias("in_left"), zero.alias("in_right")).unionAll(
        right.select(*key, zero.alias("in_left"), one.alias("in_right"))
    )
    return (
        both.groupBy(*key)
        .agg(F.sum("in_left").alias("in_left"), F.sum("in_right").alias("in_right"))
        .where("in_left <> in_right")
    )


def reconcile(
    left: DataFrame, right: DataFrame, key: Sequence[str], kind: str, value: str = "value"
) -> DataFrame:
    """``compare_values`` after the contract: unique keys, and the same keys on both sides."""
    require(
        check_unique(left, key, "left_key_unique"),
        check_unique(right, key, "right_key_unique"),
        check_absent(key_difference(left, right, key), "same_key_set"),
    )
    return compare_values(left, right, key, kind, value)


def set_status(
    left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Full outer comparison: equal, different, only_left or only_right per key."""
    a = left.select(*key, F.struct(*columns).alias("__a"))
    b = right.select(*key, F.struct(*columns).alias("__b"))
    return null_safe_join(a, b, key, "full_outer").select(
        *key,
        F.when(F.col("__b").isNull(), "only_left")
        .when(F.col("__a").isNull(), "only_right")
        .when(F.col("__a").eqNullSafe(F.col("__b")), "equal")
        .otherwise("different")
        .alias("status"),
    )


def same_rows(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows on one side only, counted with repetition (empty when the tables are equal)."""
    return key_difference(left, right, columns)


def three_way(
    public: DataFrame,
    workbook: DataFrame,
    published: DataFrame,
    key: Sequence[str] = ("table_id", "age"),
    mode: str = "report",
) -> DataFrame:
    """``public - workbook = published delta`` for exposed and deaths on a complete grid.

    A cell that one side lacks stays, with nulls for that side, and holds no relation.
    ``mode="enforce"`` fails on the first broken relation; ``report`` keeps all rows.
    """
    p, w = (
        side.select(*key, F.col("exposed").alias(f"{name}_exposed"), F.col("deaths").alias(f"{name}_deaths"))
        for side, name in ((public, "public"), (workbook, "workbook"))
    )
    d = published.select(*key, "delta_exposed", "delta_deaths")
    joined = null_safe_join(null_safe_join(p, w, key, "full_outer"), d, key, "full_outer")
    p_exposed, p_deaths = F.col("public_exposed"), F.col("public_deaths")
    w_exposed, w_deaths = F.col("workbook_exposed"), F.col("workbook_deaths")
    no = F.lit(False)
    exposed_ok = F.coalesce(p_exposed - w_exposed == F.col("delta_exposed"), no)
    deaths_ok = F.coalesce(p_deaths - w_deaths == F.col("delta_deaths"), no)
    sound = F.coalesce((p_exposed >= 0) & (p_deaths >= 0) & (p_deaths <= p_exposed), no)
    rows = joined.select(
        *key,
        p_exposed,
        p_deaths,
        crude_probability(p_deaths, p_exposed).alias("public_qx"),
        w_exposed,
        w_deaths,
        crude_probability(w_deaths, w_exposed).alias("workbook_qx"),
        F.col("delta_exposed").alias("published_delta_exposed"),
        F.col("delta_deaths").alias("published_delta_deaths"),
        exposed_ok.alias("exposed_relation_ok"),
        deaths_ok.alias("deaths_relation_ok"),
        (exposed_ok & deaths_ok).alias("qx_reconciled"),
        sound.alias("counts_sound"),
    )
    if mode == "enforce":
        ok = F.col("qx_reconciled") & F.col("counts_sound")
        rows = enforce_each(rows, ok, "aggregate reconciliation failed")
    return rows.drop("counts_sound")


def crude_probability(deaths: Column, exposed: Column) -> Column:
    """Deaths over exposed, null without exposure."""
    return F.try_divide(deaths.cast("double"), exposed.cast("double"))


def totals_check(
    observed: DataFrame, totals: Mapping[str, Column], expected: Mapping[str, int]
) -> DataFrame:
    """Named totals of a table against their expected values: (name, expected, observed, agrees)."""
    row = observed.agg(*[c.cast("bigint").alias(n) for n, c in totals.items()])
    lines = [
        F.struct(
            F.lit(n).alias("name"),
            F.lit(expected[n]).cast("bigint").alias("expected"),
            F.col(n).alias("observed"),
            F.col(n).eqNullSafe(F.lit(expected[n]).cast("bigint")).alias("agrees"),
        )
        for n in totals
    ]
    return row.select(F.inline(F.array(*lines)))
