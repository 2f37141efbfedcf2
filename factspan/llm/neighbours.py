"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component so that all have the length of the longest; the nearest by
distance are then those of the largest inner product. Centroids come from a bounded sample
(documented: ``SAMPLE`` rows, or 16 per list), halved again and again at the median between two
means, so lists are balanced. A vector goes to its nearest centroid and, near a boundary, to
others up to ``spread`` times as far, ``copies`` in all. Centroids are searched by a best-first
walk on their neighbour graph, held in memory by every task: at most ``MAX_LISTS`` of them. A
query reads every list whose centroid is at most ``ratio`` times as far as the nearest: distance
ratio prunes, nothing else does. Should those lists hold too few rows, the next nearest follow.

Neighbouring lists make a region; regions are read in bounded blocks against bounded shares of
the queries, so a vector that fills a third of the table fills many blocks, not one task. The
region of a query's nearest list is read first, and the others return only what reaches the kth
score found there. Scores are inner products of the original vectors in double precision.

Defined cases: rows without id, and vectors that are null, empty, all zero, or with null or
non-finite components take no part. Vectors of different lengths have no product: each length has
an index of its own. Repeated ids count once, with their best score. A query is no candidate of its
own id. Ties go to the smaller id.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches, in_shares
from factspan.llm.vectors import best, chunks, hits_table, matrix, ranked, sound, split_group
from factspan.session import stage

SAMPLE = 20_000
MAX_LISTS = 4096
REGION_ROWS = 8192


def lengthened(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(0, longest**2 - (v**2).sum(axis=1))
    return np.column_stack([v, np.sqrt(rest)])


def query_form(v: np.ndarray, longest: float) -> np.ndarray:
    norms = np.sqrt((v**2).sum(axis=1, keepdims=True))
    return np.column_stack([v * (longest / norms), np.zeros(len(v))])


def balanced_centroids(points: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of equal parts, in tree order: neighbours in the order are near in space."""
    random = np.random.default_rng(seed)
    out, open_ = [], [(np.arange(len(points)), min(lists, len(points)))]
    while open_:
        rows, parts = open_.pop()
        own = points[rows]
        if parts <= 1:
            out.append(own.mean(axis=0))
            continue
        a = own[random.integers(len(own))]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        at = len(own) * (parts // 2) // parts
        for _ in range(6):
            order = np.argsort(((own - a) ** 2).sum(axis=1) - ((own - b) ** 2).sum(axis=1), kind="stable")
            a, b = own[order[:at]].mean(axis=0), own[order[at:]].mean(axis=0)
        open_ += [(rows[order[at:]], parts - parts // 2), (rows[order[:at]], parts // 2)]
    return np.array(out)


@dataclass(frozen=True)
class Graph:
    """Centroids, the neighbours of each, and the norm of the longest vector."""

    centroids: np.ndarray
    neighbours: np.ndarray
    longest: float

    @staticmethod
    def over(centroids: np.ndarray, longest: float, degree: int = 16) -> Graph:
        near = []
        for part in chunks(len(centroids), 512):
            gaps = (centroids[part] ** 2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * centroids[part] @ centroids.T
            near.append(np.argsort(gaps, axis=1, kind="stable")[:, : degree + 1])
        return Graph(centroids, np.concatenate(near), longest)

    def reach(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids met on the walk, infinite for others; all within ``ratio`` of
        the nearest that the graph connects are among them."""
        lists = len(self.centroids)
        norms, own = (self.centroids**2).sum(axis=1), (points**2).sum(axis=1)
        found = np.full((len(points), lists), np.inf)
        entries = np.arange(0, lists, max(1, lists // 16))
        apart = lambda rows, dots, to: np.sqrt(np.maximum(0, own[rows, None] + norms[to] - 2 * dots))
        everyone = np.arange(len(points))
        found[:, entries] = apart(everyone, points @ self.centroids[entries].T, entries[None, :])
        ahead = found.copy()
        while True:
            at = ahead.argmin(axis=1)
            rows = np.flatnonzero(ahead[everyone, at] <= ratio * found.min(axis=1) + 1e-12)
            if not len(rows):
                return found
            ahead[rows, at[rows]] = np.inf
            to = self.neighbours[at[rows]]
            new = np.isinf(found[rows[:, None], to])
            gaps = apart(rows, np.einsum("rd,rkd->rk", points[rows], self.centroids[to]), to)
            r, c = np.nonzero(new)
            found[rows[r], to[r, c]] = gaps[r, c]
            ahead[rows[r], to[r, c]] = gaps[r, c]


def fit(rows: DataFrame, total: int, seed: int) -> Graph:
    """Centroid graph of (id, v) rows, about as many lists as the root of ``total``."""
    longest = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0])
    lists = max(1, min(MAX_LISTS, math.isqrt(total)))
    wanted = max(SAMPLE, 16 * lists)
    unit = (F.xxhash64("id", F.lit(seed)).cast("double") / F.lit(2.0**63) + 1) / 2
    sample = rows.where(unit <= wanted / total) if wanted < total else rows

    def centroids(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["id"].to_numpy(), kind="stable")))
        found = balanced_centroids(lengthened(matrix(group["v"]), longest), lists, seed)
        return pa.table({"n": pa.array([len(found)], pa.int32()), "c": pa.array([found.tobytes()], pa.binary())})

    got = sample.groupBy(F.lit(0).alias("all")).applyInArrow(centroids, "n int, c binary").first()
    return Graph.over(np.frombuffer(got["c"]).reshape(got["n"], -1), longest)


def postings(rows: DataFrame, graph: Graph, spread: float, copies: int) -> DataFrame:
    """(list, id, v): every row in its nearest list and, at boundaries, in others."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in chunks(batch.num_rows, 256):
                own = batch.slice(part.start, part.stop - part.start)
                found = graph.reach(lengthened(matrix(own["v"]), graph.longest), min(spread, 1.05))
                order = np.argsort(found, axis=1, kind="stable")[:, :copies]
                gaps = np.take_along_axis(found, order, axis=1)
                row, place = np.nonzero(gaps <= spread * gaps[:, :1] + 1e-12)
                taken = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[row, place].astype(np.int32)), taken["id"], taken["v"]], names=["list", "id", "v"]
                )

    kind = rows.schema["v"].dataType.simpleString()
    return batches(rows.select("id", "v")).mapInArrow(run, f"list int, id bigint, v {kind}")


def probes(queries: DataFrame, graph: Graph, ratio: float, sizes: np.ndarray, least: int) -> DataFrame:
    """(id, v, lists): the lists each query reads, nearest first, and more by distance until they hold ``least`` rows."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in chunks(batch.num_rows, 256):
                own = batch.slice(part.start, part.stop - part.start)
                points = query_form(matrix(own["v"]), graph.longest)
                found = graph.reach(points, ratio)
                near = found <= ratio * found.min(axis=1, keepdims=True) + 1e-12
                for i in np.flatnonzero(near @ sizes < least):
                    order = np.argsort(((graph.centroids - points[i]) ** 2).sum(axis=1), kind="stable")
                    more = order[: int(np.searchsorted(np.cumsum(sizes[order]), least)) + 1]
                    near[i, more] = True
                    found[i, more] = np.minimum(found[i, more], np.finfo(float).max)
                found[~near] = np.inf
                order = np.argsort(found, axis=1, kind="stable").astype(np.int32)
                lists = [o[: n.sum()] for o, n in zip(order, near, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own["id"], own["v"], pa.array(lists, pa.list_(pa.int32()))], names=["id", "v", "lists"]
                )

    kind = queries.schema["v"].dataType.simpleString()
    return batches(queries.select("id", "v")).mapInArrow(run, f"id bigint, v {kind}, lists array<int>")


def nearest(
    vectors: DataFrame,
    asking: Column,
    *,
    k: int = 20,
    ratio: float = 1.15,
    spread: float = 1.1,
    copies: int = 4,
    seed: int = 17,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``asking`` holds over ``id``.

    Each length of vector is an index of its own, as the rows of a table are of one length or a few.
    """
    known = stage(sound(vectors, id_column, vector_column, nonzero=True), "vectors")
    lengths = sorted(r["n"] for r in known.select(F.size("v").alias("n")).distinct().collect())
    found = [_nearest(known.where(F.size("v") == n), asking, k, ratio, spread, copies, seed) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.unionAll, found)


def _nearest(
    rows: DataFrame, asking: Column, k: int, ratio: float, spread: float, copies: int, seed: int
) -> DataFrame:
    total = rows.count()
    graph = fit(rows, total, seed)
    lists = len(graph.centroids)
    regions = max(1, min(lists, -(-total * copies // (2 * REGION_ROWS))))
    held = stage(postings(rows, graph, spread, copies), "postings")
    sizes = np.zeros(lists, np.int64)
    for r in held.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    region = lambda c: F.floor(c * F.lit(regions) / F.lit(lists)).cast("int")
    nothing = F.lit(None).cast("double")
    held = held.select(
        region(F.col("list")).alias("region"), "id", "v", F.array("list").alias("lists"), nothing.alias("floor")
    )
    asked = stage(probes(rows.where(asking), graph, ratio, sizes, copies * (k + 1)), "probes")
    asked = asked.withColumn("home", region(F.element_at("lists", 1)))
    asked = asked.withColumn("region", F.explode(F.array_distinct(F.transform("lists", region))))

    def run(group: pa.Table) -> pa.Table:
        ask, own = split_group(group)
        queries, ids, scores = [], [], []
        if len(ask) and len(own):
            place = own["lists"].combine_chunks().flatten().to_numpy()
            names, entry = np.unique(own["id"].to_numpy(), return_inverse=True)
            v, q = matrix(own["v"]), matrix(ask["v"])
            wants = ask["lists"].combine_chunks()
            reads = np.zeros((len(q), lists), bool)
            reads[np.repeat(np.arange(len(q)), np.diff(wants.offsets.to_numpy())), wants.flatten().to_numpy()] = True
            asked_ids = ask["id"].to_numpy()
            floors = np.nan_to_num(ask["floor"].to_numpy().astype(float), nan=-np.inf)
            members = {int(n): np.flatnonzero(place == n) for n in np.unique(place)}
            for part in chunks(len(q), 256):
                table = np.full((len(q[part]), len(names)), -np.inf)
                for n, rows_ in members.items():
                    readers = np.flatnonzero(reads[part, n])
                    if len(readers):
                        table[np.ix_(readers, entry[rows_])] = q[part][readers] @ v[rows_].T
                table[asked_ids[part][:, None] == names] = -np.inf
                for i, line in enumerate(table):
                    top = best(line, names, k)
                    top = top[line[top] >= floors[part][i]]
                    queries.append(np.full(len(top), asked_ids[part][i]))
                    ids.append(names[top])
                    scores.append(line[top])
        return hits_table(queries, ids, scores, pa.float64())

    def search(asks: DataFrame) -> DataFrame:
        both = in_shares(asks.select("region", "id", "v", "lists", "floor"), held, "region", REGION_ROWS)
        return both.groupBy("region", "block", "share").applyInArrow(run, "query_id bigint, vec_id bigint, score double")

    # the region of the nearest list first: its kth score is where the others start
    first = stage(search(asked.where("region = home").withColumn("floor", nothing)), "first_hits")
    partners = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = (
        ranked(partners, k).groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("floor"))
        .where(F.col("n") >= k).select("id", "floor")
    )
    others = asked.where("region <> home").join(kth, "id", "left")
    return ranked(first.unionAll(search(others)), k)
