"""Ordered passes over series of any length: carried rows, running sums, as-of merges.

Rows are dealt into ranges of (series, order) and written once with the number of their range, so a
series of any length lies in as many tasks as it needs. Inside a range a window sees at most the
range; what a range hands on (its last row, its sums) is one row per series and range, and only
those are scanned across ranges. Rows that agree in series and order lie in one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspan.operators.reconcile import null_safe_join
from factspan.session import stage

SEGMENT = "__segment"


def in_ranges(df: DataFrame, series: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of (series, order), their number in ``__segment``."""
    by = [F.col(c) for c in (*series, *order)]
    dealt = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return stage(dealt.withColumn(SEGMENT, F.spark_partition_id()), "ranges")


def _inside(series: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*series, SEGMENT).orderBy(*order)


def _across(series: Sequence[str]):
    return Window.partitionBy(*series).orderBy(SEGMENT)


def carried_previous(cut: DataFrame, series: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the preceding row as ``previous``, for rows that have a ``__segment``."""
    carried = F.struct(*columns)
    ends = cut.groupBy(*series, SEGMENT).agg(F.max_by(carried, F.struct(*order)).alias("__last"))
    edges = ends.withColumn("__carried", F.lag("__last").over(_across(series))).drop("__last")
    inside = cut.withColumn("__inside", F.lag(carried).over(_inside(series, order)))
    return (
        null_safe_join(inside, edges, [*series, SEGMENT])
        .withColumn("previous", F.coalesce("__inside", "__carried"))
        .drop(SEGMENT, "__inside", "__carried")
    )


def sums_before(
    df: DataFrame, series: Sequence[str], order: Sequence[str], values: Mapping[str, Column], parts: int | None = None
) -> DataFrame:
    """``df`` with, per name in ``values``, the sum of its column over all earlier rows of the series.

    The first row of a series has sums of 0; null values add nothing. ``order`` tells all rows of a
    series apart.
    """
    cut = in_ranges(df.withColumns({f"__{n}": v for n, v in values.items()}), series, order, parts)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = cut.groupBy(*series, SEGMENT).agg(*[F.sum(f"__{n}").alias(f"__total_{n}") for n in values])
    earlier = _across(series).rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(*series, SEGMENT, *[zero(F.sum(f"__total_{n}").over(earlier)).alias(f"__edge_{n}") for n in values])
    before = _inside(series, order).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumns({f"__in_{n}": zero(F.sum(f"__{n}").over(before)) for n in values})
    joined = null_safe_join(inside, edges, [*series, SEGMENT])
    return joined.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__edge_{n}")).alias(n) for n in values])


def merge_as_of(
    events: DataFrame, states: DataFrame, key: Sequence[str], at: str, start: str, parts: int | None = None
) -> DataFrame:
    """Events with the columns of the newest state of their key that starts at or before them.

    Both are read once, as one ordered sequence in which each event takes the last state before it,
    in its range or handed on by an earlier one. A state that starts when an event happens comes
    first. Events without a state are left out; null keys are equal; null times match nothing.
    """
    kept = [c for c in events.columns if c not in key]
    added = [c for c in states.columns if c not in key]
    none = lambda frame, names: F.lit(None).cast(frame.select(F.struct(*names)).schema[0].dataType)
    keys = lambda frame: [F.col(c) for c in key]
    asks = events.where(F.col(at).isNotNull()).select(
        *keys(events), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*kept).alias("__event"),
        none(states, added).alias("__state"),
    )
    held = states.where(F.col(start).isNotNull()).select(
        *keys(states), F.col(start).alias("__at"), F.lit(0).alias("__kind"), none(events, kept).alias("__event"),
        F.struct(*added).alias("__state"),
    )
    order = ["__at", "__kind"]
    cut = in_ranges(held.unionByName(asks), key, order, parts)
    ends = cut.groupBy(*key, SEGMENT).agg(F.max_by("__state", F.when(F.col("__kind") == 0, F.col("__at"))).alias("__last"))
    earlier = _across(key).rowsBetween(Window.unboundedPreceding, -1)
    edges = ends.withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier)).drop("__last")
    here = F.last("__state", ignorenulls=True).over(_inside(key, order).rowsBetween(Window.unboundedPreceding, 0))
    found = null_safe_join(cut.withColumn("__here", here), edges, [*key, SEGMENT])
    found = found.where("__kind = 1").withColumn("__found", F.coalesce("__here", "__carried")).where("__found is not null")
    return found.select(*key, *[F.col(f"__event.{c}") for c in kept], *[F.col(f"__found.{c}") for c in added])
