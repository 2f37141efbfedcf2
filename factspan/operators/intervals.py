"""Bins, interval joins and linear operators on grids.

Spark joins intervals only by comparing every pair, so intervals are first cut into
buckets of a fixed width and joined on the bucket; the exact condition is applied inside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspan.functions.numbers import choose, close_bin
from factspan.operators import prefix
from factspan.operators.reconcile import null_safe_join
from factspan.operators.rules import enforce_each
from factspan.session import stage


def _buckets(low: Column, high: Column, width: float) -> Column:
    """Buckets touched by [low, high)."""
    first = F.floor(low / width)
    return F.sequence(first, F.greatest(first, F.ceil(high / width) - 1))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: float,
    on: Sequence[str] = (),
) -> DataFrame:
    """Inner join of overlapping half-open intervals, each pair once; null ``on`` keys are equal.

    A pair is kept in the first bucket both sides touch. Choose ``width`` near the length
    of the shorter side, so an interval touches few buckets.
    """
    a_lo, a_hi = left_range
    b_lo, b_hi = right_range
    a = left.withColumn("__bucket", F.explode(_buckets(F.col(a_lo), F.col(a_hi), width)))
    b = right.withColumn("__bucket", F.explode(_buckets(F.col(b_lo), F.col(b_hi), width)))
    joined = null_safe_join(a, b, [*on, "__bucket"])
    first = F.greatest(F.floor(F.col(a_lo) / width), F.floor(F.col(b_lo) / width))
    return joined.where(
        (F.col(a_lo) < F.col(b_hi)) & (F.col(b_lo) < F.col(a_hi)) & (F.col("__bucket") == first)
    ).drop("__bucket")


def point_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    interval: tuple[str, str],
    width: float,
    on: Sequence[str] = (),
) -> DataFrame:
    """Inner join of points with the half-open intervals that hold them; null ``on`` keys are equal."""
    lo, hi = interval
    a = points.withColumn("__bucket", F.floor(F.col(point) / width))
    b = intervals.withColumn("__bucket", F.explode(_buckets(F.col(lo), F.col(hi), width)))
    return (
        null_safe_join(a, b, [*on, "__bucket"])
        .where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi)))
        .drop("__bucket")
    )


def alias_as_of(
    events: DataFrame,
    aliases: DataFrame,
    entity: str = "entity_id",
    day: str = "day",
) -> DataFrame:
    """Events joined with the alias of their entity that is valid on the event's day.

    An ordered merge of events and alias starts: every row is read once, an open interval costs one
    row, and an entity with very many events lies in as many tasks as it needs. The intervals of an
    entity do not overlap (``overlapping_bins`` and the alias rules check that); null entities are
    equal.
    """
    merged = prefix.merge_as_of(events, aliases, [entity], day, "valid_start")
    return merged.where(F.col("valid_end").isNull() | (F.col(day) < F.col("valid_end")))


def rebin(
    df: DataFrame,
    dims: Sequence[str],
    bins: Sequence[tuple[float, float | None]],
    value: str,
    maximum_age: float = 105.0,
) -> DataFrame:
    """Move source bins (age_lower, age_upper) into target bins by midpoint, then sum.

    Source bins are summed first, so the target bin is looked up once per distinct bin.
    A midpoint that is not in exactly one target bin fails the query.
    """
    source = df.groupBy(*dims, "age_lower", "age_upper").agg(F.sum(value).alias(value))
    middle = (F.col("age_lower") + close_bin(F.col("age_upper"), maximum_age)) * 0.5
    edges = [(lo, maximum_age if hi is None else hi) for lo, hi in bins]
    index = F.coalesce(
        choose(middle, edges),
        F.raise_error(F.lit("source bin is not in exactly one target bin")).cast("int"),
    )
    return source.groupBy(*dims, index.alias("bin")).agg(F.sum(value).alias(value))


def bin_table(df: DataFrame, bins: Sequence[tuple[float, float | None]]) -> DataFrame:
    """Attach bounds to the ``bin`` index of a fixed bin list."""
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for index, (lo, hi) in enumerate(bins):
        low = F.when(F.col("bin") == index, float(lo)).otherwise(low)
        if hi is not None:
            high = F.when(F.col("bin") == index, float(hi)).otherwise(high)
    return df.withColumns({"age_lower": low, "age_upper": high})


def overlapping_bins(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bins that start before the previous bin of their group ends, or follow an open one.

    One row per distinct bin of a group: the window holds a published age scale.
    """
    order = Window.partitionBy(*group).orderBy("age_lower", F.col("age_upper").asc_nulls_last())
    following = F.lead("age_lower").over(order)
    return (
        df.withColumn("next_lower", following)
        .where(
            F.col("next_lower").isNotNull()
            & (F.col("age_upper").isNull() | (F.col("next_lower") < F.col("age_upper")))
        )
    )


def open_not_last(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Open bins that are followed by another bin of their group."""
    order = Window.partitionBy(*group).orderBy("age_lower")
    return (
        df.withColumn("next_lower", F.lead("age_lower").over(order))
        .where(F.col("age_open") & F.col("next_lower").isNotNull())
    )


def grid_cells(nodes: DataFrame, node: str, on: Sequence[str] = ()) -> DataFrame:
    """Consecutive distinct nodes as cells (x0, x1), one row per cell."""
    distinct = nodes.select(*on, F.col(node).cast("double").alias("x0")).distinct()
    order = Window.partitionBy(*on).orderBy("x0")
    return distinct.withColumn("x1", F.lead("x0").over(order)).where(F.col("x1").isNotNull())


def linear_weights(
    bins: DataFrame,
    cells: DataFrame,
    label: Sequence[str],
    width: float,
    on: Sequence[str] = (),
    interval: tuple[str, str] = ("age_lower", "age_upper"),
) -> DataFrame:
    """Weights that integrate a piecewise linear function over each bin.

    Every overlap of a bin with a grid cell gives two weights: for the cell's left and
    right node. Weights of a node are summed, giving one row per (bin, node).
    """
    lo, hi = interval
    pairs = overlap_join(bins, cells, (lo, hi), ("x0", "x1"), width, on)
    start, end = F.greatest(lo, "x0"), F.least(hi, "x1")
    z0, z1 = start - F.col("x0"), end - F.col("x0")
    right = (z1 * z1 - z0 * z0) / (2 * (F.col("x1") - F.col("x0")))
    ends = F.array(
        F.struct(F.col("x0").alias("node"), ((z1 - z0) - right).alias("weight")),
        F.struct(F.col("x1").alias("node"), right.alias("weight")),
    )
    return (
        pairs.select(*on, *label, F.inline(ends))
        .groupBy(*on, *label, "node")
        .agg(F.sum("weight").alias("weight"))
    )


def apply_operator(
    weights: DataFrame,
    surface: DataFrame,
    out: Sequence[str],
    node: str,
    dims: Sequence[str],
    value: str = "value",
    on: Sequence[str] = (),
) -> DataFrame:
    """Contract one dimension of a surface with a weight table, keeping the others.

    Both sides must have the same nodes (null ones are equal); the query fails otherwise.
    """
    return (
        _same_nodes(weights, surface, [*on, node])
        .groupBy(*on, *out, *dims)
        .agg(F.sum(F.col("weight") * F.col(value)).alias(value))
    )


def uncovered_nodes(weights: DataFrame, surface: DataFrame, node: Sequence[str]) -> DataFrame:
    """Coordinates on one side only: (node, side)."""
    sides = weights.select(*node, F.lit("weights").alias("side")).unionAll(
        surface.select(*node, F.lit("surface").alias("side"))
    )
    return sides.groupBy(*node).agg(
        F.min("side").alias("side"), F.max("side").alias("__other")
    ).where("side = __other").drop("__other")


def _same_nodes(weights: DataFrame, surface: DataFrame, node: Sequence[str]) -> DataFrame:
    """Inner join on ``node`` that fails on a node of one side only.

    The check is a grouped pass of its own, so the join may still send a small side to all tasks.
    The weights, which both passes read, are written once.
    """
    weights = stage(weights, "weights")
    joined = null_safe_join(weights, surface, node)
    alone = uncovered_nodes(weights, surface, node)
    alone = enforce_each(alone, F.col("side").isNull(), "operator and surface have different nodes")
    return joined.unionByName(alone.drop("side"), allowMissingColumns=True)


def compose_operators(
    outer: DataFrame, inner: DataFrame, on: Sequence[str] = ()
) -> DataFrame:
    """Sparse product of two weight tables (out, node, weight): outer after inner.

    The nodes of ``outer`` must be the outputs of ``inner``; the query fails otherwise.
    """
    a = outer.select(*on, "out", F.col("node").alias("mid"), F.col("weight").alias("w1"))
    b = inner.select(*on, F.col("out").alias("mid"), "node", F.col("weight").alias("w2"))
    return (
        _same_nodes(a, b, [*on, "mid"])
        .groupBy(*on, "out", "node")
        .agg(F.sum(F.col("w1") * F.col("w2")).alias("weight"))
    )


def interpolate(
    points: DataFrame,
    nodes: DataFrame,
    on: Sequence[str],
    at: str,
    node: str,
    value: str,
    width: float,
) -> DataFrame:
    """Linear interpolation of a grid at requested coordinates; null outside its range.

    Points meet only the grid cell of their bucket, so no group of points is ever sorted.
    """
    grid = nodes.select(*on, F.col(node).cast("double").alias("x0"), F.col(value).alias("y0"))
    order = Window.partitionBy(*on).orderBy("x0")
    cells = grid.withColumns(
        {"x1": F.lead("x0").over(order), "y1": F.lead("y0").over(order)}
    )
    # the last node becomes a closed point of its own
    cells = cells.withColumn("last", F.col("x1").isNull())
    end = F.when(F.col("last"), F.col("x0") + width).otherwise(F.col("x1"))
    cut = cells.withColumn("__bucket", F.explode(_buckets(F.col("x0"), end, width)))
    asked = points.withColumn("__bucket", F.floor(F.col(at).cast("double") / width))
    x = F.col(f"__p.{at}").cast("double")
    condition = F.col("__p.__bucket") == F.col("__c.__bucket")
    for key in on:
        condition = condition & F.col(f"__p.{key}").eqNullSafe(F.col(f"__c.{key}"))
    condition = condition & F.when(F.col("__c.last"), x == F.col("__c.x0")).otherwise(
        (x >= F.col("__c.x0")) & (x < F.col("__c.x1"))
    )
    joined = asked.alias("__p").join(cut.alias("__c"), condition, "left")
    share = (x - F.col("__c.x0")) / (F.col("__c.x1") - F.col("__c.x0"))
    line = F.when(F.col("__c.last"), F.col("__c.y0")).otherwise(
        F.col("__c.y0") + share * (F.col("__c.y1") - F.col("__c.y0"))
    )
    return joined.select(*[F.col(f"__p.{c}").alias(c) for c in points.columns], line.alias(value))
