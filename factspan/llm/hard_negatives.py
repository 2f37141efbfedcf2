"""Hard negatives by exact whole-number products, several candidates multiplied at once.

Kronecker packing: components are biased to be non-negative, and those of several candidates stand
in separate fields of one wide integer. One multiplication and addition per component of an
anchor then carries on the products of all of them; a field is as wide as the largest sum it can
hold, so no field runs into the next, and taking the biases' share from each field leaves the exact
scores. Wide integers of up to 53 bits are whole numbers in double precision, on which the
multiplication runs as a matrix product; where one field needs more, integers of any width are used.

An anchor's positives are its ``positives`` best other rows of the same label. For each of them the
negatives are the best ``negatives`` rows of other labels whose score is between ``low`` and
``high`` hundredths of the positive's. Rows of a label (for the positives) and rows of all labels
(for the negatives) are cut into blocks, anchors into shares, so a task holds a bounded number of
either however many rows a label has; each returns a few rows per anchor, of which the best stay.

Defined cases: rows without id or label and vectors that are null, empty, or with null or
non-finite components take no part. Vectors of different lengths have no product, so anchors are
compared with rows of their own length. Of rows that share an id the least (label, vector) counts.
Ties go to the smaller id. A positive with a score below 0 has no negatives. A component or score
that 64 bits cannot hold fails by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspan.llm.shared import in_shares
from factspan.llm.vectors import best, chunks, matrix, split_group, takes_part, whole
from factspan.session import stage

ROWS = 4096  # of either side in one task
ANCHORS = 256  # multiplied at a time
EXACT = 53  # bits of a whole number in double precision
WIDE = 64  # candidates in one integer where doubles are too narrow


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products of every anchor with every row; both hold 64-bit whole numbers."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), np.int64)
    left, right = [int(anchors.min()), int(rows.min())], [int(anchors.max()), int(rows.max())]
    dims = anchors.shape[1]
    width = max(1, (dims * (right[0] - left[0]) * (right[1] - left[1])).bit_length())
    fields, kind = (EXACT // width, np.float64) if width <= EXACT else (WIDE, object)
    if kind is object:
        anchors, rows = anchors.astype(object), rows.astype(object)
    plus, others = anchors - left[0], rows - left[1]
    room = -(-len(rows) // fields) * fields
    others = np.concatenate([others, np.zeros((room - len(rows), dims), others.dtype)]).reshape(-1, fields, dims)
    wide = others[:, 0].copy()
    for field in range(1, fields):
        wide += others[:, field] * (1 << width * field)
    if kind is object:
        sums = plus.dot(wide.T)
    else:
        sums = (plus.astype(kind) @ wide.astype(kind).T).astype(np.int64)
    mask = (1 << width) - 1
    out = np.stack([(sums >> (width * field)) & mask for field in range(fields)], axis=2)
    out = out.reshape(len(anchors), room)[:, : len(rows)]
    out = out + left[1] * anchors.sum(axis=1)[:, None] + left[0] * rows.sum(axis=1)[None, :] - dims * left[0] * left[1]
    if kind is object:
        if max(abs(out.min()), abs(out.max())) >= 1 << 63:
            raise OverflowError("hard negatives: a score is beyond 64 bits")
        out = out.astype(np.int64)
    return out


def mine(
    vectors: DataFrame,
    asking: Column,
    *,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors
    for which ``asking`` holds over ``id``."""
    known = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).alias("v"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & takes_part(F.col("v")))
    one = known.groupBy("id").agg(F.min(F.struct("label", whole(F.col("v"), scale).alias("v"))).alias("row"))
    rows = stage(one.select("id", "row.label", "row.v", F.size("row.v").cast("string").alias("length")), "mined_rows")
    anchors = rows.where(asking)

    def alike(group: pa.Table) -> pa.Table:
        ask, own = split_group(group)
        ids, names = own["id"].to_numpy(), ask["id"].to_numpy()
        points, queries = matrix(own["v"], np.int64), matrix(ask["v"], np.int64)
        found = []
        for part in chunks(len(names), ANCHORS):
            for id_, scores in zip(names[part], packed_scores(queries[part], points), strict=True):
                others = np.flatnonzero(ids != id_)
                top = others[best(scores[others], ids[others], positives)]
                found.append((np.full(len(top), id_), ids[top], scores[top]))
        return _table(("anchor_id", "positive_id", "positive_score"), found)

    key = F.concat_ws(":", "length", "label").alias("key")
    groups = in_shares(anchors.select(key, "id", "v"), rows.select(key, "id", "v"), "key", ROWS)
    hits = groups.groupBy("key", "block", "share").applyInArrow(
        alike, "anchor_id bigint, positive_id bigint, positive_score bigint"
    )
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = stage(
        hits.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives).drop("at"), "positives"
    )

    def unlike(group: pa.Table) -> pa.Table:
        ask, own = split_group(group)
        order = np.argsort(own["id"].to_numpy())  # ids rise, so of equal scores the first stands first
        ids, names = own["id"].to_numpy()[order], ask["id"].to_numpy()
        both = pa.concat_arrays([*own["label"].chunks, *ask["label"].chunks]).dictionary_encode()
        codes = both.indices.to_numpy()
        labels, own_labels = codes[: len(own)][order], codes[len(own) :]
        points, queries = matrix(own["v"], np.int64)[order], matrix(ask["v"], np.int64)
        limits = ask["scores"].to_pylist()
        found = []
        for part in chunks(len(names), ANCHORS):
            rows_ = zip(names[part], own_labels[part], limits[part], packed_scores(queries[part], points), strict=True)
            for id_, label_, bounds, scores in rows_:
                other = np.flatnonzero((labels != label_) & (ids != id_))
                near = scores[other]
                for bound in bounds:
                    # whole-number limits: low * bound <= 100 * score <= high * bound
                    held = other[(near >= -(-low * bound // 100)) & (near <= high * bound // 100)]
                    top = held[best(scores[held], ids[held], negatives)]
                    found.append((np.full(len(top), id_), np.full(len(top), bound), ids[top], scores[top]))
        return _table(("anchor_id", "positive_score", "negative_id", "negative_score"), found)

    bounds = pairs.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    nothing = F.lit(None).cast("array<bigint>").alias("scores")
    length = F.col("length").alias("key")
    groups = in_shares(
        anchors.join(bounds, "id").select(length, "id", "label", "v", "scores"),
        rows.select(length, "id", "label", "v", nothing), "key", ROWS,
    )
    hits = groups.groupBy("key", "block", "share").applyInArrow(
        unlike, "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    )
    first = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    chosen = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return pairs.join(chosen, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _table(names: tuple[str, ...], found: list[tuple[np.ndarray, ...]]) -> pa.Table:
    columns = zip(*found, strict=True) if found else [[] for _ in names]
    return pa.table({
        name: pa.array(np.concatenate(parts) if len(parts) else [], pa.int64())
        for name, parts in zip(names, columns, strict=True)
    })
