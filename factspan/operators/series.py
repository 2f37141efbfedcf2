"""Ordered series: neighbours, running values, projections.

Functions that use a window take a *grid table*: one row per (series, step), where the
steps are calendar periods, ages or ordinals. Events are counted onto the grid first, so
a window holds a calendar, never the events of a hot key. For series without such a grid
``previous_row``, ``trapezoid``, ``rolling_trend`` and ``archive_row_numbers`` work range by range.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from factspan.operators import prefix
from factspan.operators.reconcile import null_safe_join
from factspan.operators.rules import enforce_each


def _order(series: Sequence[str], step: str):
    return Window.partitionBy(*series).orderBy(step)


def previous_row(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    segment: Column | None = None,
) -> DataFrame:
    """Columns of the preceding row of the series as ``previous`` (null on the first row).

    Rows are ordered within their segment only; the last row of each segment is carried to the next
    non-empty one through a table with one row per segment. Without ``segment`` the rows are dealt
    into ranges of (series, order); a given one must rise with the order (a day, a block).
    """
    cut = prefix.in_ranges(df, series, order) if segment is None else df.withColumn(prefix.SEGMENT, segment)
    return prefix.carried_previous(cut, series, order, columns)


def block_offsets(rows: DataFrame, archive: str, block: str, scan_order: str) -> DataFrame:
    """Rows before each file block of an archive: one row per block.

    ``block`` tells where a row was read from (file and byte offset) and ``scan_order``
    rises by one per row inside a block.
    """
    blocks = rows.groupBy(archive, block).agg(
        F.count(F.lit(1)).alias("__n"), F.min(scan_order).alias("__first")
    )
    before = Window.partitionBy(archive).orderBy(block).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return blocks.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnRenamed(
        "__n", "__rows"
    )


def archive_row_numbers(
    rows: DataFrame, offsets: DataFrame, archive: str, block: str, scan_order: str
) -> DataFrame:
    """Contiguous one-based row numbers per archive from the offsets of its blocks."""
    number = F.col("__offset") + F.col(scan_order) - F.col("__first") + 1
    return (
        enforce_each(
            null_safe_join(rows, offsets, [archive, block], "left"),
            F.col(scan_order).between(F.col("__first"), F.col("__first") + F.col("__rows") - 1),
            "a row lies outside the blocks that were counted",
        )
        .withColumn("archive_row_number", number.cast("bigint"))
        .drop("__first", "__offset", "__rows", block, scan_order)
    )


def shard_bounds(numbered: DataFrame, archive: str, shard: str) -> DataFrame:
    """First and last archive row of every shard."""
    return numbered.groupBy(archive, shard).agg(
        F.min("archive_row_number").alias("first_row"),
        F.max("archive_row_number").alias("last_row"),
    )


def missing_years(grid: DataFrame, series: Sequence[str], year: str = "year") -> DataFrame:
    """Steps of a series whose successor is not the next year."""
    following = F.lead(year).over(_order(series, year))
    return grid.withColumn("next_year", following).where(
        F.col("next_year").isNotNull() & (F.col("next_year") - F.col(year) != 1)
    )


def gaps(grid: DataFrame, series: Sequence[str], ordinal: str, start: int = 0) -> DataFrame:
    """Series whose ordinals are not contiguous from ``start``; counted, not sorted."""
    facts = grid.groupBy(*series).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(ordinal).alias("ordinals"),
        F.min(ordinal).alias("first"),
        F.max(ordinal).alias("last"),
    )
    return facts.where(
        (F.col("first") != start)
        | (F.col("ordinals") != F.col("rows"))
        | (F.col("last") - F.col("first") + 1 != F.col("rows"))
    )


def falls(grid: DataFrame, series: Sequence[str], step: str, value: str) -> DataFrame:
    """Steps where the value is below its predecessor."""
    before = F.lag(value).over(_order(series, step))
    return grid.withColumn("previous_value", before).where(F.col(value) < F.col("previous_value"))


def running_total(grid: DataFrame, series: Sequence[str], step: str, value: str, out: str
                  ) -> DataFrame:
    frame = _order(series, step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.withColumn(out, F.sum(value).over(frame))


def second_differences(grid: DataFrame, series: Sequence[str], step: str, value: str
                       ) -> DataFrame:
    """Second difference ending at each step (null on the first two)."""
    w = _order(series, step)
    return grid.withColumn(
        "second_difference",
        F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w),
    )


def curvature(grid: DataFrame, series: Sequence[str], step: str, value: str) -> DataFrame:
    """Largest second difference / 8 relative to the largest value, and the root mean square."""
    tiny = 2.2250738585072014e-308
    marked = second_differences(grid, series, step, value)
    return marked.groupBy(*series).agg(
        (
            F.coalesce(F.max(F.abs("second_difference")), F.lit(0.0))
            / 8
            / F.greatest(F.max(F.abs(F.col(value))), F.lit(tiny))
        ).alias("curvature_indicator"),
        F.sqrt(F.avg(F.col("second_difference") * F.col("second_difference"))).alias(
            "innovation_scale"
        ),
    )


def index_to_last(grid: DataFrame, series: Sequence[str], step: str, value: str, out: str
                  ) -> DataFrame:
    """Value relative to the last value of its series."""
    last = grid.groupBy(*series).agg(F.max_by(value, step).alias("__last"))
    return null_safe_join(grid, last, list(series)).withColumn(out, F.col(value) / F.col("__last")).drop(
        "__last"
    )


def trapezoid(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    x: str,
    y: str,
    segment: Column | None = None,
) -> DataFrame:
    """Trapezoid integral of y over x per series, over any number of points."""
    linked = previous_row(df, series, order, [x, y], segment)
    piece = (F.col(x) - F.col(f"previous.{x}")) * (F.col(y) + F.col(f"previous.{y}")) * 0.5
    return linked.groupBy(*series).agg(F.sum(piece).alias("integral"))


def yearly_sums(grid: DataFrame, series: Sequence[str], ordinal: str, value: str,
                per_year: int = 12) -> DataFrame:
    """Sums of complete years; the steps left over form a last, shorter bucket."""
    return grid.groupBy(*series, F.floor(F.col(ordinal) / per_year).alias("year_index")).agg(
        F.sum(value).alias(value), F.count(F.lit(1)).alias("steps")
    )


def trend_band(
    grid: DataFrame,
    series: Sequence[str],
    step: str,
    log_level: str,
    scale: str,
    horizon: int,
    confidence: float = 0.95,
) -> DataFrame:
    """Continue each series along its last slope with a widening band.

    Only the last two points matter; they are picked by aggregation.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    steps = F.max(step)
    ends = grid.groupBy(*series).agg(
        steps.alias("__t1"),
        F.max_by(log_level, step).alias("__l1"),
        F.max_by(scale, step).alias("__scale"),
    )
    before = null_safe_join(grid, ends.select(*series, "__t1"), list(series)).where(F.col(step) < F.col("__t1"))
    second = before.groupBy(*series).agg(F.max_by(log_level, step).alias("__l0"))
    base = null_safe_join(ends, second, list(series), "left")
    h = F.col("horizon")
    slope = F.coalesce(F.col("__l1") - F.col("__l0"), F.lit(0.0))
    spread = F.greatest(F.col("__scale"), F.lit(0.03)) * F.sqrt(h * (1 + h / 2))
    level = F.col("__l1") + slope * h
    return base.withColumn(
        "horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    ).select(
        *series,
        "horizon",
        F.exp(level).alias("mean"),
        F.exp(level - z * spread).alias("lower"),
        F.exp(level + z * spread).alias("upper"),
    )


def rolling_origins(
    grid: DataFrame, series: Sequence[str], ordinal: str, value: str, minimum: int = 8
) -> DataFrame:
    """Training summary before every forecast origin: rows, mean and the actual value.

    Running totals over the grid give each origin its past; no origin repeats the rows
    before it.
    """
    past = _order(series, ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return grid.select(
        *series,
        F.col(ordinal).alias("origin"),
        F.count(F.lit(1)).over(past).alias("training_rows"),
        F.avg(value).over(past).alias("training_mean"),
        F.col(value).alias("actual"),
    ).where(F.col("training_rows") >= minimum)


def rolling_trend(
    grid: DataFrame, series: Sequence[str], step: str, value: str, minimum: int = 8, parts: int | None = None
) -> DataFrame:
    """Straight-line trend of all steps before every origin, and its error at the origin.

    Sums of n, t, t * t, y and t * y over the earlier steps come from one ordered pass over any
    number of series of any length; they give slope, intercept and forecast in closed form. Steps
    are counted from the first of their series. An origin needs ``minimum`` earlier steps (two at
    least) that are not all the same; null values are not trained on and have no error.
    """
    if minimum < 2:
        raise ValueError("a trend needs two earlier steps")
    first = grid.groupBy(*series).agg(F.min(step).alias("__first"))
    placed = null_safe_join(grid, first, list(series)).withColumn("__t", (F.col(step) - F.col("__first")).cast("double"))
    placed = placed.select(*series, step, "__t", F.col(value).cast("double").alias("actual"))
    y, t = F.col("actual"), F.when(F.col("actual").isNotNull(), F.col("__t"))
    sums = {"n": t.isNotNull().cast("bigint"), "st": t, "stt": t * t, "sy": y, "sty": t * y}
    past = prefix.sums_before(placed, series, [step], {f"__{name}": column for name, column in sums.items()}, parts)
    n, st, stt, sy, sty = (F.col(f"__{name}") for name in sums)
    spread = n * stt - st * st
    slope = (n * sty - st * sy) / spread
    rows = past.where((n >= minimum) & (spread > 0)).select(
        *series, F.col(step).alias("origin"), n.alias("training_rows"), slope.alias("slope"),
        ((sy - slope * st) / n + slope * F.col("__t")).alias("forecast"), "actual",
    )
    return rows.withColumn("error", F.col("actual") - F.col("forecast"))


def series_bounds(df: DataFrame, series: Sequence[str], start: str, end: str) -> DataFrame:
    return df.groupBy(*series).agg(
        F.min(start).alias("first_observation"),
        F.max(start).alias("last_observation"),
        F.max(end).alias("period_end"),
    )
