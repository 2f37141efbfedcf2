"""What the two vector searches share: sound vectors, rows in blocks, and the best of a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def takes_part(vector: Column, nonzero: bool = False) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite, and (``nonzero``) not only zeros."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(vector, lambda x: x != 0) if nonzero else F.lit(True)
    return F.coalesce((F.size(vector) > 0) & whole & some, F.lit(False))


def sound(df: DataFrame, id_column: str, vector_column: str, nonzero: bool) -> DataFrame:
    """(id, v) of the rows with an id whose vectors take part, of any length."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return rows.where(F.col("id").isNotNull() & takes_part(F.col("v"), nonzero))


def whole(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x); one that 64 bits cannot hold fails by name."""

    def one(x: Column) -> Column:
        large = F.raise_error(F.lit("a scaled vector component is beyond 64 bits")).cast("bigint")
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled)).otherwise(large)

    return F.transform(vector, one)


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.empty((0, 0), dtype)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(lists), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest finite scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    near = near[scores[near] > -np.inf]
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def hits_table(queries: list, ids: list, scores: list, kind: pa.DataType) -> pa.Table:
    return pa.table({
        "query_id": pa.array(np.concatenate(queries) if queries else [], pa.int64()),
        "vec_id": pa.array(np.concatenate(ids) if ids else [], pa.int64()),
        "score": pa.array(np.concatenate(scores) if scores else [], kind),
    })


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct partners of every query, numbered from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def split_group(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(asking, held) rows of a group."""
    asking = group.column("asks").combine_chunks()
    return group.filter(asking), group.filter(pc.invert(asking))


def chunks(count: int, size: int) -> Iterator[slice]:
    for at in range(0, count, size):
        yield slice(at, at + size)
