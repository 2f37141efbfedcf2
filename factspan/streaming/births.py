"""Birth and count streams over a growing folder of files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factspan.operators.counts import same_total
from factspan.operators.history import append_release
from factspan.operators.rules import require
from factspan.plans import births
from factspan.plans.batch import Release, complete
from factspan.session import new_path, stage
from factspan.sources.files import BIRTH_PROFILES, scan_births, text_schema

Sink = Callable[[DataFrame, int], None]


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    source: str = "csv",
    files_per_batch: int = 1,
    name_filter: str | None = None,
    **options: object,
) -> DataFrame:
    """Stream over the files of a folder with an explicit schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.format(source).load(path)


def birth_stream(
    spark: SparkSession, path: str, profile: int = 25, files_per_batch: int = 1
) -> DataFrame:
    columns = BIRTH_PROFILES[profile]
    raw = file_stream(
        spark,
        path,
        text_schema(columns),
        files_per_batch=files_per_batch,
        header=True,
        enforceSchema=False,
        sep=";",
    )
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def run_shards(
    raw: DataFrame,
    release: Release,
    geography_vintage: str,
    shards: str,
    checkpoint: str,
    sidecar: Sink | None = None,
) -> None:
    """Normalise each micro-batch and write it under its batch id.

    A batch that is retried rewrites its own folder, so shards are written exactly once.
    ``sidecar`` receives the raw rows of the same batch.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        facts = births.count_facts(batch)
        payload = births.payload(
            facts,
            release,
            geography_vintage,
            births.SHARD_TRANSFORMATION,
            f"partial DEIS birth stream shard {batch_id}; requires global aggregation",
        )
        payload.write.mode("overwrite").parquet(f"{shards}/batch={batch_id}")
        if sidecar is not None:
            sidecar(batch, batch_id)

    query = (
        raw.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_shards(spark: SparkSession, shards: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{shards}/batch=*")


def two_pass(
    spark: SparkSession,
    path: str,
    release: Release,
    geography_vintage: str,
    span: tuple[date, date],
    totals: dict[str, int] | None = None,
    pairs: dict[str, dict[str, int]] | None = None,
    profile: int = 25,
    sidecar: Sink | None = None,
) -> DataFrame:
    """Check the whole folder first, then stream it shard by shard, then merge.

    No shard is written before every rule and control holds; the merged total must equal
    the first pass.
    """
    groups = births.checked_groups(scan_births(spark, path, profile), *span, totals, pairs)
    shards, checkpoint = new_path(spark, "birth-shards"), new_path(spark, "birth-checkpoint")
    run_shards(
        birth_stream(spark, path, profile), release, geography_vintage, shards, checkpoint, sidecar
    )
    schema = complete(spark.range(0), "demographic", {}).schema
    merged = births.aggregate_shards(read_shards(spark, shards, schema))
    require(same_total(merged, groups, "value", "value"))
    return merged


# --- running counts ------------------------------------------------------------


def running_counts(
    events: DataFrame, key: Sequence[str], value: str | None = None
) -> DataFrame:
    """Streaming count (or sum) by a full, nullable key. State is one row per key."""
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    return events.groupBy(*key).agg(total.alias("value"))


@dataclass(frozen=True)
class CountTable:
    """Counts kept by a stream under one folder: changes per micro-batch and compacted snapshots.

    ``updates/batch=n`` holds the keys that micro-batch n changed, with their new values; a batch
    that is retried rewrites its folder. Every ``compact_every`` batches the last snapshot and the
    changes since become ``snapshots/upto=n``, so a reader never merges more than that many batches.
    A snapshot counts once it is complete (its success mark is written last); one that was cut off is
    written anew by the retried batch.
    """

    path: str
    key: tuple[str, ...]
    compact_every: int = 8

    def follow(self, events: DataFrame, value: str | None = None) -> None:
        """Take in the files that are new since the last run, from the checkpoint kept in the folder."""
        counted = running_counts(events, self.key, value)
        schema = counted.schema

        def one(changed: DataFrame, batch_id: int) -> None:
            changed.write.mode("overwrite").parquet(f"{self.path}/updates/batch={batch_id}")
            if (batch_id + 1) % self.compact_every == 0:
                state = self._merged(changed.sparkSession, schema, batch_id)
                state.write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={batch_id}")

        query: StreamingQuery = (
            counted.writeStream.outputMode("update")
            .foreachBatch(one)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """State after the last finished batch; ``schema`` is that of key and value."""
        return self._merged(spark, schema, None).select(*schema.fieldNames())

    def numbers(self, spark: SparkSession, folder: str) -> list[int]:
        """Numbers of the complete batches or snapshots in a folder."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        found = [s.getPath() for s in system.listStatus(at)]
        done = [p for p in found if "=" in p.getName() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _merged(self, spark: SparkSession, schema: T.StructType, upto: int | None) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        snapshots = [n for n in self.numbers(spark, "snapshots") if upto is None or n < upto]
        start = snapshots[-1] if snapshots else -1
        updates = [n for n in self.numbers(spark, "updates") if n > start and (upto is None or n <= upto)]
        rows = spark.createDataFrame([], whole)
        if snapshots:
            rows = spark.read.schema(whole).parquet(f"{self.path}/snapshots/upto={start}")
        if updates:
            folders = [f"{self.path}/updates/batch={n}" for n in updates]
            fresh = spark.read.schema(whole).option("basePath", f"{self.path}/updates").parquet(*folders)
            rows = rows.unionAll(fresh.select(*whole.fieldNames()))
        newest = rows.groupBy(*self.key).agg(F.max_by("value", "batch").alias("value"), F.max("batch").alias("batch"))
        return newest.select(*whole.fieldNames())


def run_counts(
    events: DataFrame,
    key: Sequence[str],
    value: str | None = None,
    name: str = "running-counts",
    path: str | None = None,
    compact_every: int = 8,
) -> DataFrame:
    """Run a count stream over the files available now and return its state.

    With the ``path`` of an earlier run it goes on from there: files already counted are not read
    again, and the state holds all runs.
    """
    spark = events.sparkSession
    table = CountTable(path or new_path(spark, name), tuple(key), compact_every)
    table.follow(events, value)
    return table.read(spark, running_counts(events, key, value).schema)


def stream_releases(batches: DataFrame, path: str, checkpoint: str) -> None:
    """Append every release of a stream of complete batches to a history table.

    Releases already present are skipped, so a repeated micro-batch adds nothing.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        append_release(stage(batch, f"release-{batch_id}"), path)

    query = (
        batches.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
