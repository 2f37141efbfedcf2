"""Token sequences written in training order: a keyed permutation gives each a global slot.

Documents become token ids, each with ``end`` last; every task cuts its run of ids into sequences
of ``length``, the last of a task filled up with ``end``. Sequences are numbered through all
tasks, and a keyed Feistel network over the least even number of bits that holds them, walked on
until it falls below their count, maps the numbers one to one onto slots: no shuffle of keys, no
table, and the same key gives the same order. Slots are cut into shards of ``per_shard`` by range.
A shard is one file of fixed-stride records, so record i of shard s is slot s * per_shard + i, and
a reader goes on at any slot by seeking.

Tokens are shuffled once, as compressed blocks of the records one task has for one shard. A shard
is made in one task from at most ``per_shard`` records (16 MB by default). Files are written under
a name of the attempt and renamed, so a lost or doubled task leaves whole files of equal content.

Defined cases: a null text is empty and is its ``end`` alone; null ids and repeated rows are
documents like others; an empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factspan.llm.packing import id_type, tokenise
from factspan.llm.shared import batches, stage_small
from factspan.llm.words import mix
from factspan.session import new_path, stage

LENGTH = 1024
PER_SHARD = 8192
ROUNDS = 6


def permuted(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """Slot of every number below ``count``: a bijection of range(count) chosen by ``key``."""
    half = np.uint64(max(1, (max(1, count - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key], np.uint64)))
    out = np.array(numbers, np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme: a bare path is on Spark's default file system, as everywhere in Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_in_order(
    docs: DataFrame,
    tokenizer: str,
    *,
    folder: str | None = None,
    key: int = 1,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    end: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Writes the shards and returns their index: (slot, sequence, shard, byte_offset, tokens,
    ids_crc32, path), one row per sequence; ``tokens`` are those before the filling.

    ``folder`` is a URI or path that all tasks reach; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_path(spark, "training-order"))
    chosen = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.lit(None).cast("string").alias("source")
    )
    kind = id_type(tokenizer)
    written = stage_small(tokenise(chosen, tokenizer, end).drop("queue"), "ordered_tokens")
    parts = written.groupBy("part").agg(F.ceil(F.sum("tokens") / length).alias("sequences"), F.sum("tokens").alias("held"))
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    bases = stage(
        parts.withColumn("base", F.coalesce(F.sum("sequences").over(until), F.lit(0))).withColumnRenamed("part", "p"), "bases"
    )
    count = bases.agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0]

    def records(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches_:
            slots, starts, blobs, numbers, fills = [], [], [], [], []
            columns = (batch[c].to_pylist() for c in ("base", "before", "tokens"))
            for row, (base, before, tokens) in enumerate(zip(*columns, strict=True)):
                ids = batch["ids"][row].as_buffer()
                cuts = [0, *range(length - before % length, tokens, length), tokens]
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    numbers.append(base + (before + low) // length)
                    starts.append((before + low) % length)
                    fills.append(high - low)
                    blobs.append(ids[low * kind.itemsize : high * kind.itemsize])
            slots = permuted(np.array(numbers, np.int64), count, key)
            of = slots // per_shard
            out = []
            for shard in np.unique(of):
                own = np.flatnonzero(of == shard)
                head = np.stack([slots[own], np.array(numbers)[own], np.array(starts)[own], np.array(fills)[own]])
                out.append((int(shard), head.astype("<i8").tobytes(), squeeze(b"".join(bytes(blobs[i]) for i in own))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()),
                 pa.array([o[2] for o in out], pa.binary())],
                names=["shard", "head", "body"],
            )

    def shards(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        expand = zstandard.ZstdDecompressor().decompress

        def close(shard: int, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            held = min(per_shard, count - shard * per_shard)
            table = np.full((held, length), end, kind)
            number, tokens = np.zeros(held, np.int64), np.zeros(held, np.int64)
            for head, body in rows:
                slots, numbers, starts, fills = np.frombuffer(head, "<i8").reshape(4, -1)
                ids, at = np.frombuffer(expand(body), kind), 0
                for slot, sequence, start, fill in zip(slots, numbers, starts, fills, strict=True):
                    record = slot - shard * per_shard
                    table[record, start : start + fill] = ids[at : at + fill]
                    number[record] = sequence
                    tokens[record] += fill
                    at += fill
            name = f"{root}/{shard_name(shard)}"
            with store.open_output_stream(draft := f"{name}.{uuid.uuid4().hex}") as sink:
                sink.write(table.tobytes())
            store.move(draft, name)
            checks = [zlib.crc32(r.astype("<u4").tobytes()) for r in table]
            index = np.arange(held, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(index + shard * per_shard), pa.array(number), pa.array(np.full(held, shard, np.int64)),
                 pa.array(index * length * kind.itemsize), pa.array(tokens), pa.array(checks, pa.int64()),
                 pa.array([f"{folder}/{shard_name(shard)}"] * held, pa.string())],
                names=["slot", "sequence", "shard", "byte_offset", "tokens", "ids_crc32", "path"],
            )

        now, rows = None, []
        for batch in batches_:
            for shard, head, body in zip(*(batch[c].to_pylist() for c in ("shard", "head", "body")), strict=True):
                if rows and shard != now:
                    yield close(now, rows)
                    rows = []
                now = shard
                rows.append((head, body))
        if rows:
            yield close(now, rows)

    placed = batches(written.join(bases, F.col("part") == F.col("p"))).select("base", "before", "tokens", "ids")
    blocks = placed.mapInArrow(records, "shard bigint, head binary, body binary")
    pieces = max(1, min(-(-count // per_shard), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = blocks.repartitionByRange(pieces, "shard").sortWithinPartitions("shard")
    index = ordered.mapInArrow(
        shards,
        "slot bigint, sequence bigint, shard bigint, byte_offset bigint, tokens bigint, ids_crc32 bigint, path string",
    )
    return stage(index, "training_index")


def read_from(folder: str, shard: int, record: int, records: int, *, kind: np.dtype, length: int = LENGTH) -> np.ndarray:
    """``records`` consecutive records of a shard from ``record`` on, fewer at its end."""
    store, root = _open(folder)
    stride = length * kind.itemsize
    with store.open_input_file(f"{root}/{shard_name(shard)}") as source:
        source.seek(record * stride)
        return np.frombuffer(source.read(records * stride), kind).reshape(-1, length)


def sequences(spark: SparkSession, folder: str, *, kind: np.dtype, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, ids) of every record of the shards in ``folder``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                table = np.frombuffer(content.as_buffer(), kind).reshape(-1, length).astype(np.int32)
                first = int(path.rsplit("shard-", 1)[1][:8]) * per_shard
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + len(table))), pa.array(list(table), pa.list_(pa.int32()))],
                    names=["slot", "ids"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    return files.select("path", "content").mapInArrow(run, "slot bigint, ids array<int>")
