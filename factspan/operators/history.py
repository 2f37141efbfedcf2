"""Release histories and point-in-time selection.

A history holds every published state of every fact. Questions about it are grouped
aggregations: a fact revised a billion times is combined inside the map tasks and never
collected into one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factspan.operators import release_log
from factspan.operators.reconcile import null_safe_join
from factspan.operators.rules import ContractViolation, enforce_each, require_schema


def _instant(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def newest_states(
    history: DataFrame,
    as_of: datetime | Column,
    fact: Sequence[str] = ("fact_id",),
    clock: str = "available_at",
    observation: str = "observation_id",
) -> DataFrame:
    """Newest known state of every fact with an ``ambiguous`` flag.

    The newest clock per fact has a fixed width, so it is found by hashing in the map tasks from
    two columns, whatever else a row holds. One null-safe join fetches the rows that hold it. Only
    those are compared by observation id: the greatest is returned (once, if repeated), and the fact
    is ambiguous if there are several.
    """
    known = history.where(F.col(clock) <= _instant(as_of))
    newest = known.groupBy(*fact).agg(F.max(clock).alias(clock))
    rows = null_safe_join(known, newest, [*fact, clock]).distinct()
    states = Window.partitionBy(*fact)
    ambiguous = F.min(observation).over(states) != F.max(observation).over(states)
    place = F.row_number().over(states.orderBy(F.desc(observation)))
    return (
        rows.select(*history.columns, ambiguous.alias("ambiguous"), place.alias("__place"))
        .where("__place = 1").drop("__place")
    )


def latest_as_of(
    history: DataFrame,
    as_of: datetime | Column,
    fact: Sequence[str] = ("fact_id",),
    clock: str = "available_at",
    observation: str = "observation_id",
    mode: str = "enforce",
) -> DataFrame:
    """Rows known at ``as_of``, reduced to the newest state of every fact.

    A tie between different observations fails the query; ``mode="report"`` keeps the greatest of
    them and flags its fact as ``ambiguous``. The same observation repeated gives one row.
    """
    states = newest_states(history, as_of, fact, clock, observation)
    if mode == "report":
        return states
    message = "several observations of one fact share the newest clock"
    return enforce_each(states, ~F.col("ambiguous"), message).drop("ambiguous")


def ambiguous_revisions(
    history: DataFrame,
    as_of: datetime | Column,
    fact: Sequence[str] = ("fact_id",),
    clock: str = "available_at",
    observation: str = "observation_id",
) -> DataFrame:
    """Facts whose newest clock at ``as_of`` holds several observations, and how many."""
    known = history.where(F.col(clock) <= _instant(as_of))
    per_clock = (
        known.groupBy(*fact, clock, observation)
        .agg(F.lit(1).alias("one"))
        .groupBy(*fact, clock)
        .agg(F.count(F.lit(1)).alias("observations"))
    )
    newest = per_clock.groupBy(*fact).agg(
        F.max(F.struct(clock, "observations")).alias("top")
    )
    return newest.where("top.observations > 1").select(*fact, "top.*")


def selection_order(selection: DataFrame) -> DataFrame:
    return selection.orderBy("fact_id", "observation_id")


def release_order(manifests: DataFrame) -> DataFrame:
    return manifests.orderBy("available_at", "release_id")


def manifests(assets: DataFrame) -> DataFrame:
    """One row per release: its clock is the latest of its assets."""
    return assets.groupBy("release_id").agg(
        F.max("available_at").alias("available_at"),
        F.count(F.lit(1)).alias("assets"),
    )


def contributing_releases(
    selection: DataFrame, releases: DataFrame, key: str = "release_id"
) -> DataFrame:
    """Releases that supplied at least one selected row."""
    used = selection.select(key).distinct()
    return releases.join(used, key, "left_semi")


def minimal_identities(selection: DataFrame, identities: DataFrame) -> DataFrame:
    """Identity records needed to explain the selected rows."""
    used = selection.select(
        F.explode(F.array("fact_id", "observation_id", "release_id")).alias("id")
    ).distinct()
    return identities.join(used, "id", "left_semi")


def strict_union(*frames: DataFrame) -> DataFrame:
    """Union of tables with the same columns, order and types; anything else is an error."""
    first, *others = frames
    for other in others:
        require_schema(other, first.schema)
        first = first.unionAll(other)
    return first


def content_digests(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit digests of some columns, which tell nulls and their places apart."""
    cells, missing = [], []
    for name in columns:
        nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        cells.append(F.to_json(F.struct(name), {"ignoreNullFields": "false"}) if nested else F.col(name))
        missing.append(F.col(name).isNull())
    return [F.xxhash64(F.lit(seed), *missing, *cells) for seed in (1, 2)]


_APART = "min(d1) <> max(d1) OR min(d2) <> max(d2)"


def inconsistent(df: DataFrame, identifier: str, payload: Sequence[str]) -> DataFrame:
    """Identifiers that stand for more than one payload.

    The least and greatest digests of the payload differ exactly when there are two (payloads that
    agree in both 64-bit digests aside), so the check hashes in the map tasks and needs neither a
    sort of whole rows nor a distinct set per identifier.
    """
    one, two = content_digests(df, payload)
    marked = df.select(identifier, one.alias("d1"), two.alias("d2"))
    return marked.groupBy(identifier).agg(F.expr(_APART).alias("apart")).where("apart").select(identifier)


def history_conflicts(history: DataFrame, key: Sequence[str]) -> DataFrame:
    """Observation ids with two contents, and fact ids with two keys, in one scan."""
    rest = [c for c in history.columns if c != "observation_id"]
    kinds = {history.schema[c].dataType.simpleString() for c in ("observation_id", "fact_id")}
    as_one = (lambda c: F.col(c)) if len(kinds) == 1 else (lambda c: F.col(c).cast("string"))
    sides = []
    for identifier, payload in (("observation_id", rest), ("fact_id", key)):
        one, two = content_digests(history, payload)
        sides.append(
            F.struct(F.lit(identifier).alias("conflict"), as_one(identifier).alias("id"), one.alias("d1"), two.alias("d2"))
        )
    marked = history.select(F.explode(F.array(*sides)).alias("m")).select("m.*")
    return marked.groupBy("conflict", "id").agg(F.expr(_APART).alias("apart")).where("apart").select("conflict", "id")


def merge_identities(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of identity records (id, payload); a conflict fails the query."""
    both = strict_union(left, right)
    grouped = both.groupBy("id").agg(F.min("payload").alias("payload"), F.max("payload").alias("p"))
    return enforce_each(grouped, F.col("payload").eqNullSafe(F.col("p")), "one identity has two payloads").drop("p")


def append_release(batch: DataFrame, path: str) -> None:
    """Add a batch to a history table; see ``release_log.append``.

    Observations that their release already holds are skipped, so a retried append adds nothing,
    a release may come in several parts, and what a killed append wrote is never read.
    """
    release_log.append(batch, path)


def read_history(
    spark: SparkSession, path: str, schema: T.StructType, releases: DataFrame | None = None, upto: int | None = None
) -> DataFrame:
    """History table, of all commits or up to one; ``releases`` limits the scan to their partitions."""
    history = release_log.read(spark, path, schema, upto)
    if releases is not None:
        history = history.join(releases.select("release_id"), "release_id", "left_semi")
    return history.select(*schema.fieldNames())


def create_history(batches: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Several one-release batches as one history; conflicting content is an error."""
    history = strict_union(*batches)
    broken = history_conflicts(history, key).groupBy("conflict").count().collect()
    if broken:
        raise ContractViolation([(row["conflict"], row["count"]) for row in broken])
    return history
