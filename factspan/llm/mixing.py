"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A budget of words is shared among the sources by weight. No source gives more than ``epochs``
times its words; what it cannot give is shared again by weight until no target is above its cap.
In the fixed point the capped sources are those with the least cap per weight, so one ordered
pass over the source table finds it.

A source's target is met by whole repetitions of all its documents and one fractional
repetition: its documents in the order of a seeded digest, until the target is reached; the
document on which it is reached gives its first words only. The order is never sorted as a whole:
counts per source and digest bucket find the bucket where the target falls, and only that
bucket's documents are ranked.

Defined cases: a null text has size 0, null sources are one source and rank last, repeated rows
are separate documents. Sizes are all 0 or the table is empty: every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """(source, source_size, target) from rows (source, size); ``weights`` repeat over the ranked sources."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    weighed = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    # in order of cap per weight, what the sources before this one cannot exceed, and the weight from here on
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = (
        weighed.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    )
    # the level of the first source that its cap does not stop is everybody's
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return filled.withColumn("target", target).select("source", "source_size", "target")


def _rows(docs: DataFrame, seed: str, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """The columns of ``docs`` as one struct, and (id, source, size, digest, bucket)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return (
        docs.select(
            F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
            docs[id_column].cast("long").alias("id"), docs[source_column].alias("source"),
            word_count(docs[text_column]).alias("size"),
        )
        .withColumn("digest", digest)
        .withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    )


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, epochs: int) -> DataFrame:
    """One row per source (s): its target, whole copies, the rest beyond them, and where that ends in
    the order of the digests: the last bucket it takes whole, the bucket it cuts, what comes before that."""
    cells = stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "mix_cells")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = (
        targets(cells, weights, share, epochs).withColumn("copies", whole.cast("int"))
        .withColumn("rest", F.floor("target") - F.col("copies") * F.col("source_size")).withColumnRenamed("source", "s")
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    full = F.col("before") + F.col("size") <= F.col("rest")
    cut = ~full & (F.col("before") < F.col("rest"))
    return stage(
        before.join(goals, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s", "source_size", "target", "copies", "rest")
        .agg(
            F.coalesce(F.max(F.when(full, F.col("bucket"))), F.lit(-1)).alias("upto"),
            F.coalesce(F.max(F.when(cut, F.col("bucket"))), F.lit(-1)).alias("cut"),
            F.coalesce(F.max(F.when(cut, F.col("before"))), F.lit(0)).alias("before"),
        ),
        "mix_plan",
    )


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target, copies, part and taken."""
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    split = F.col("bucket") == F.col("cut")
    order = Window.partitionBy("source", "bucket").orderBy("digest", "id", "size", F.xxhash64("row"))
    reached = F.col("before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = joined.where(split).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - reached)))
    clear = joined.where(~split).withColumn("part", F.when(F.col("bucket") <= F.col("upto"), F.col("size")).otherwise(0))
    both = ranked.withColumn("part", F.col("part").cast("long")).unionByName(clear.withColumn("part", F.col("part").cast("long")))
    return both.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """(id, size, source, source_size, target, copies, part, taken) of every row of ``docs``.

    ``copies`` whole repetitions and the first ``part`` words of one more make ``taken`` words.
    """
    rows = _rows(docs.select(id_column, text_column, source_column), seed, id_column, text_column, source_column)
    sized = stage(rows.withColumn("row", F.col("id")), "mix_sizes")
    return _placed(sized, _plan(sized, weights, share, epochs)).select(
        "id", "size", "source", "source_size", "target", "copies", "part", "taken"
    )


def sample(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    epochs: int = 2,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The mix itself in the columns of ``docs``: every row as often as taken whole, and where a
    repetition is cut, a row with its first words. Texts meet only the small plan, never each other.
    """
    rows = _rows(docs, seed, id_column, text_column, source_column)
    placed = _placed(rows, _plan(rows, weights, share, epochs))
    text = F.col("row")[text_column]
    whole = F.col("copies") + ((F.col("part") == F.col("size")) & (F.col("size") > 0)).cast("int")
    units = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each word with the gap after it
    lead = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    first = F.array_join(F.slice(units, F.lit(1), (F.col("part") + lead).cast("int")), "")
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(first))
    texts = F.concat(F.array_repeat(text, whole), F.coalesce(cut, F.array().cast("array<string>")))
    taken = placed.withColumn("__text", F.explode(texts))
    return taken.select(
        *(F.col("__text").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns)
    )
