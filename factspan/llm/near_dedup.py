"""Near-duplicate documents by min-max hashing.

Every permutation is evaluated once and gives two signature values, the least and the greatest
hash of a document's shingles; each agrees between two documents with the probability of their
Jaccard similarity. Bands of consecutive values name buckets. Texts with equal shingle sets are
one class and only classes are banded. Buckets then yield links in two steps, neither of which
writes out the pairs of a bucket:

1. every class is compared with the first class (in one seeded order) of each of its buckets;
2. where a bucket still holds several components, its classes outside the largest of them are
   compared with all of that component and with each other, block by block inside tasks.

After step 2 every two classes that share a bucket are compared or already in one component, so
nothing is lost to large buckets. A pair at similarity s shares no bucket with probability
(1 - s ** rows) ** bands: 3e-6 for the least similar pair at the default 0.8, 5 rows, 32 bands,
and 7e-9 at 0.85. Links are confirmed on the full sets of 64-bit shingle hashes.

Defined cases: without words (null, empty, blank) a document has size 0, no links, and is kept.
A null id has null component and is kept. Rows that repeat an id with the same text are one
document; an id with several texts is one document linked by any of them. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches, components, in_shares
from factspan.llm.words import mix, shingles, slices, word_hashes
from factspan.session import stage

BLOCK = 256
SEED = 7


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(2 * count, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
    drawn = mix(base + np.uint64(1))
    return drawn[:count, None] | np.uint64(1), drawn[count:, None]


def signature(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least then greatest hash under every permutation."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(values), 4096):
        hashes = (values[None, at : at + 4096] ^ offsets) * factors
        low = np.minimum(low, hashes.min(axis=1))
        high = np.maximum(high, hashes.max(axis=1))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = values[: bands * rows].reshape(bands, rows)
    keys = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return keys.view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for start, part in slices(batch.column("text")):
        words, bounds = word_hashes(part)
        for i in range(len(part)):
            yield start + i, np.unique(shingles(words[bounds[i] : bounds[i + 1]], width))


def _print(values: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit digests of a set."""
    first = mix(values).sum(dtype=np.uint64)
    second = mix(values + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def sketch(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, size, print1, print2, keys): set size, digest of the set, and one key per band."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _permutations(-(-bands * rows // 2), seed)
        for batch in batches_:
            out: dict[str, list] = {"size": [], "print1": [], "print2": [], "keys": []}
            for _, values in _sets(batch, width):
                first, second = _print(values)
                out["size"].append(len(values))
                out["print1"].append(first)
                out["print2"].append(second)
                out["keys"].append(
                    band_keys(signature(values, factors, offsets), bands, rows) if len(values) else None
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out["size"], pa.int64()), pa.array(out["print1"], pa.int64()),
                 pa.array(out["print2"], pa.int64()), pa.array(out["keys"], pa.list_(pa.int64()))],
                names=["id", "size", "print1", "print2", "keys"],
            )

    return batches(docs.select("id", "text")).mapInArrow(
        run, "id bigint, size bigint, print1 bigint, print2 bigint, keys array<bigint>"
    )


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): sorted distinct shingle hashes."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            sets = [np.sort(values.view(np.int64)) for _, values in _sets(batch, width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
            )

    return batches(docs.select("id", "text")).mapInArrow(run, "id bigint, shingles array<bigint>")


def _similar(shared, size_a, size_b, percent: int):
    """``100 * shared >= percent * union`` in whole numbers."""
    return 100 * shared >= percent * (size_a + size_b - shared)


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    return (
        pairs.join(left, "a").join(right, "b")
        .where(_similar(shared, F.size("of_a").cast("long"), F.size("of_b").cast("long"), percent))
        .select("a", "b")
    )


def confirm_blocks(asks: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between asking and held rows (group, id, component) of a group, across components.

    Groups are compared in blocks of at most about ``BLOCK`` held and asking rows, and a block
    gives no more links than connect what it found, so neither a task nor the result grows with
    the pairs of a group.
    """

    def run(group: pa.Table) -> pa.Table:
        links = []
        asking = group.column("asks").combine_chunks()
        left, right = group.filter(asking), group.filter(pc.invert(asking))
        if len(left) and len(right):
            ids, own = right["id"].to_numpy(), right["component"].to_numpy()
            lists = right["shingles"].combine_chunks()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy()
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            columns = (left["id"].to_pylist(), left["component"].to_pylist(), left["shingles"].combine_chunks())
            for a, component, shingle_list in zip(*columns, strict=True):
                mine = shingle_list.values.to_numpy()
                at = np.searchsorted(mine, flat)
                at[at == len(mine)] = 0
                shared = np.add.reduceat((mine[at] == flat).astype(np.int64), bounds[:-1])
                for j in np.flatnonzero(_similar(shared, len(mine), sizes, percent) & (own != component)).tolist():
                    x, y = root(component), root(int(own[j]))
                    if x != y:
                        up[x] = y
                        links.append((a, int(ids[j])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    both = in_shares(asks, held, "group", BLOCK).join(sets, "id")
    return both.groupBy("group", "block", "share").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row (id, size, component, kept) per row of ``docs``.

    ``size`` is the number of distinct ``width``-word shingles, ``component`` the smallest id
    reachable over links of at least ``percent`` per cent Jaccard similarity, ``kept`` whether
    that is the row's own id.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    every = stage(sketch(source, width, bands, rows, seed), "sketches")
    named = every.where("size > 0 and id is not null")
    same = ("print1", "print2", "size")
    classes = stage(named.groupBy(*same).agg(F.min("id").alias("rep")), "classes")

    banded = (
        named.join(classes.withColumnRenamed("rep", "id"), ["id", *same], "left_semi")
        .select("id", "size", F.explode("keys").alias("key"))
        .distinct()
    )
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("rank"), "id", "size")
    hubs = banded.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("hub")).where("n > 1")
    shared = stage(banded.join(hubs.select("key", "hub"), "key"), "buckets")
    sizes_fit = F.expr(f"100 * least(size, hub.size) >= {percent} * greatest(size, hub.size)")
    pairs = (
        shared.where("id <> hub.id").where(sizes_fit).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
    )

    needed = stage(shared.select("id").distinct(), "needed")
    sets = stage(full_sets(source.join(needed, "id", "left_semi"), width).distinct(), "sets")
    links = stage(confirm_pairs(pairs, sets, percent), "confirmed")
    first = components(links)

    placed = shared.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    members = needed.join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    counts = members.groupBy("component").agg(F.count("*").alias("members"))
    open_ = stage(placed.join(mixed.select("key"), "key").join(counts, "component"), "open")
    largest = open_.groupBy("key").agg(F.max(F.struct("members", "component")).alias("largest"))
    rest = stage(
        open_.join(largest, "key").where("component <> largest.component")
        .select("key", "id", "component", F.col("largest.component").alias("target")),
        "rest",
    )
    # the rest of a bucket against its largest component, each component once, and against each other
    whole, within = F.xxhash64(F.lit(0), "target"), F.xxhash64(F.lit(1), "key")
    asks = rest.select(whole.alias("group"), "id", "component").distinct()
    held = members.join(rest.select("target").distinct(), F.col("component") == F.col("target")).select(
        whole.alias("group"), "id", "component"
    )
    several = rest.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    among = rest.join(several.select("key"), "key").select(within.alias("group"), "id", "component")
    late = confirm_blocks(asks.unionAll(among), held.unionAll(among), sets, percent)
    final = components(links.unionAll(late))

    labelled = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component")
    )
    plain = every.select("id", *same)
    linked = plain.where("size > 0 and id is not null").join(labelled, list(same)).select("id", "size", "component")
    alone = plain.where("size = 0 or id is null").select("id", "size", F.col("id").alias("component"))
    return linked.unionAll(alone).select(
        "id", "size", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near copies: of every component the row of the smallest id stays.

    Rows that repeat an id are copies, and one of them stays; rows without id all stay. Only ids
    that go or repeat are joined with ``docs``, never its texts with each other.
    """
    id_column = options.get("id_column", "doc_id")
    found = stage(near_duplicates(docs, **options), "found")
    named = found.where("id is not null")
    gone = stage(named.where(~F.col("kept")).select("id").distinct(), "gone")
    again = stage(named.where("kept").groupBy("id").count().where("count > 1").select("id"), "again")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    single = rows.join(gone.unionAll(again), "id", "left_anti")
    one = rows.join(again, "id", "left_semi").dropDuplicates(["id"])
    return single.unionByName(one).select("row.*")
