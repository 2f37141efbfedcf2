"""Written intermediate tables, running positions and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from factspan.session import new_path, stage

# Arrow batches for tasks that hold whole texts: at most so many rows, and about so many bytes.
BATCH_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("2147483647", str(8 << 20)),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def batches(df: DataFrame) -> DataFrame:
    """``df``, once its session has small Arrow batches; what the user has set stays."""
    conf = df.sparkSession.conf
    for key, (default, own) in BATCH_LIMITS.items():
        if conf.get(key, default) == default:
            conf.set(key, own)
    return df


def stage_small(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for large columns: written with the stronger codec, read back with its schema."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(column: str, parts: int):
    """crc32 of the decimal text of an id, modulo ``parts``; null ids go to part 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def in_shares(asks: DataFrame, held: DataFrame, key: str, rows: int) -> DataFrame:
    """Both sides in groups (key, block, share) of about ``rows`` held and ``rows`` asking rows each.

    ``held`` rows go to one block of their key by id and are repeated per share of its asking rows,
    which go to one share by id and are repeated per block. A key of any size is so cut into tasks
    of bounded size. Both need (key, id) and the same further columns.
    """
    blocks = held.groupBy(key).agg(F.ceil(F.count("*") / rows).alias("blocks"))
    shares = asks.groupBy(key).agg(F.ceil(F.count("*") / rows).alias("shares"))
    cuts = blocks.join(shares, key)
    none = F.lit(0).cast("long")
    left = (
        held.join(cuts, key).withColumn("block", F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")))
        .withColumn("share", F.explode(F.sequence(none, F.col("shares") - 1))).withColumn("asks", F.lit(False))
    )
    right = (
        asks.join(cuts, key).withColumn("share", F.pmod(F.xxhash64("id", F.lit(13)), F.col("shares")))
        .withColumn("block", F.explode(F.sequence(none, F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    )
    return left.unionByName(right).drop("blocks", "shares")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (id, component) per id that has a link.

    ``component`` is the smallest id reachable. Every round hooks each component to its smallest
    neighbour, follows the hooks to their ends and contracts the links, so their number at least
    halves; each round's tables are written, so no lineage grows and a lost executor costs one
    round. A hub with very many links is a plain minimum that combines in the map tasks.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    label = stage(
        edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")),
        "labels",
    )
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(
            both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("id"), F.least("a", "to").alias("to")),
            "hooks",
        )
        while True:
            ahead = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
            jumped = stage(hooks.join(ahead, "to").select("id", "to", "next"), "jumps")
            moved = not jumped.where("`to` <> next").isEmpty()
            hooks = jumped.select("id", F.col("next").alias("to"))
            if not moved:
                break
        label = stage(
            label.join(hooks.select(F.col("id").alias("component"), "to"), "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")
            ),
            "labels",
        )
        left = hooks.select(F.col("id").alias("a"), F.col("to").alias("x"))
        right = hooks.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = stage(
            edges.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    return label


def bounded_sample(df: DataFrame, label: str, per_label: int, seed: int, id_column: str) -> DataFrame:
    """At most ``per_label`` rows of every label, the same on every run: the smallest seeded hashes.

    A first cut by the label's count keeps all rows that can be among them (but for a chance of
    about 1e-9, which only makes the sample smaller), so the ranking sorts few rows. Adds
    ``__share``, the part of the label's rows that was taken.
    """
    counts = stage(df.groupBy(label).agg(F.count("*").alias("__n")), "label_counts")
    hashed = F.xxhash64(F.col(id_column), F.lit(seed))
    unit = (hashed.cast("double") / F.lit(2.0**63) + 1) / 2
    loose = per_label + 6 * per_label**0.5 + 10
    near = df.join(counts, label).withColumn("__u", unit).where(F.col("__u") * F.col("__n") <= loose)
    order = Window.partitionBy(label).orderBy("__u", id_column)
    return (
        near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_label)
        .withColumn("__share", F.least(F.lit(1.0), F.lit(float(per_label)) / F.col("__n")))
        .drop("__u", "__r", "__n")
    )
