"""Exact top-k inner products of whole-number vectors by ball-tree branch and bound.

Rows are dealt to shards by space, to the nearest of some centroids of a bounded sample; a shard is
cut into blocks of bounded size. Each block builds a ball tree; a query takes its nodes
in the order of their upper bound, centre product plus query norm times radius, until the bound
falls below its kth score. The kth score is shared: every query is first searched in its own shard,
and the score found there is where all others start. A query is only sent to the shards whose own
ball (centroid and distance of the farthest row, a small table) has a bound that reaches that score.
Queries come in shares of bounded size.

Components become floor(256 * x) in double precision; products of such vectors are whole numbers
and exact in double precision up to 2 ** 53. A node is passed over only if its bound is below the
kth score by more than the rounding of the bound, so ties are never lost.

Defined cases: rows without id and vectors that are null, empty, or with null or non-finite
components take no part; zero vectors do. Vectors of different lengths have no product: each length
is searched among its own. Repeated ids count once with their best score. A query is no candidate of
its own id. Ties go to the smaller id. Products that may not be exact fail by name.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.llm.neighbours import balanced_centroids
from factspan.llm.shared import batches, in_shares
from factspan.llm.vectors import best, chunks, hits_table, matrix, ranked, sound, split_group, whole
from factspan.session import stage

SHARD_ROWS = 8192
MAX_SHARDS = 1024
SAMPLE = 20_000
LEAF = 128


@dataclass
class BallTree:
    """Nodes in arrays; ``rows`` of a leaf are a slice of ``order``."""

    centres: np.ndarray
    radii: np.ndarray
    children: list[tuple[int, int] | None]
    spans: list[tuple[int, int]]
    order: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> BallTree:
        order = np.arange(len(points))
        centres, radii, children, spans = [], [], [], []

        def node(low: int, high: int) -> int:
            own = points[order[low:high]]
            centre = own.mean(axis=0)
            gaps = np.sqrt(((own - centre) ** 2).sum(axis=1))
            at = len(spans)
            centres.append(centre)
            radii.append(gaps.max())
            spans.append((low, high))
            children.append(None)
            if high - low > LEAF and gaps.max() > 0:
                a = own[gaps.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                middle = (low + high) // 2
                order[low:high] = order[low:high][np.argsort(own @ (a - b), kind="stable")]
                children[at] = (node(low, middle), node(middle, high))  # depth is the logarithm of the shard
            return at

        node(0, len(points))
        return BallTree(np.array(centres), np.array(radii), children, spans, order)

    def search(self, points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> tuple:
        """(ids, scores) of rows among the best ``k`` of this tree that reach ``floor``."""
        bounds = self.centres @ query + np.sqrt((query**2).sum()) * self.radii
        bounds += 1e-9 * (1 + np.abs(bounds))
        heap = [(-bounds[0], 0)]
        names, scores = np.empty(0, np.int64), np.empty(0)
        while heap and -heap[0][0] >= floor:
            at = heapq.heappop(heap)[1]
            if self.children[at]:
                for child in self.children[at]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            low, high = self.spans[at]
            rows = self.order[low:high]
            got = points[rows] @ query
            use = (got >= floor) & (ids[rows] != own)
            if use.any():
                names = np.concatenate([names, ids[rows][use]])
                scores = np.concatenate([scores, got[use]])
                high = np.argsort(-scores, kind="stable")
                names, first = np.unique(names[high], return_index=True)  # of a repeated id the best
                scores = scores[high][first]
                top = best(scores, names, k)
                names, scores = names[top], scores[top]
                if len(top) == k:
                    floor = max(floor, scores[-1])
        return names, scores


def top_products(
    vectors: DataFrame,
    asking: Column,
    *,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    seed: int = 19,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``asking`` holds over ``id``."""
    known = sound(vectors, id_column, vector_column, nonzero=False)
    scaled = stage(known.select("id", whole(F.col("v"), scale).alias("v")).distinct(), "scaled")
    lengths = sorted(r["n"] for r in scaled.select(F.size("v").alias("n")).distinct().collect())
    found = [_top(scaled.where(F.size("v") == n), asking, k, seed) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return functools.reduce(DataFrame.unionAll, found)


def _centroids(rows: DataFrame, total: int, seed: int) -> np.ndarray:
    """About one centroid per ``SHARD_ROWS`` rows, at most ``MAX_SHARDS``, from at most about ``SAMPLE`` rows."""
    parts = max(1, min(MAX_SHARDS, -(-total // SHARD_ROWS)))
    unit = (F.xxhash64("id", F.lit(seed)).cast("double") / F.lit(2.0**63) + 1) / 2
    sample = rows.where(unit <= SAMPLE / total) if SAMPLE < total else rows

    def fit(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["id"].to_numpy(), kind="stable")))
        made = balanced_centroids(matrix(group["v"]), parts, seed)
        return pa.table({"n": pa.array([len(made)], pa.int32()), "c": pa.array([made.tobytes()], pa.binary())})

    got = sample.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "n int, c binary").first()
    return np.frombuffer(got["c"]).reshape(got["n"], -1)


def _top(scaled: DataFrame, asking: Column, k: int, seed: int) -> DataFrame:
    """The best ``k`` of every query among vectors of one length."""
    centroids = _centroids(scaled, scaled.count(), seed)

    def deal(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            homes, gaps = [], []
            for part in chunks(batch.num_rows, 64):
                points = matrix(batch["v"].slice(part.start, part.stop - part.start))
                apart = np.sqrt(((points[:, None, :] - centroids) ** 2).sum(axis=2))
                homes.append(apart.argmin(axis=1))
                gaps.append(apart.min(axis=1))
            none = [np.empty(0)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], pa.array(np.concatenate(homes or none), pa.int32()), pa.array(np.concatenate(gaps or none))],
                names=["id", "v", "shard", "gap"],
            )

    rows = stage(batches(scaled.select("id", "v")).mapInArrow(deal, "id bigint, v array<bigint>, shard int, gap double"), "shards")
    radii = np.full(len(centroids), -np.inf)
    for r in rows.groupBy("shard").agg(F.max("gap").alias("radius")).collect():  # one row per shard
        radii[r["shard"]] = r["radius"]
    queries = rows.where(asking).select("id", "v", F.col("shard").alias("home"))

    def run(group: pa.Table) -> pa.Table:
        ask, own = split_group(group)
        names, found, scores = [], [], []
        if len(ask) and len(own):
            points, ids = matrix(own["v"]), own["id"].to_numpy()
            tree = BallTree.build(points)
            floors, asked = ask["floor"].to_pylist(), matrix(ask["v"])
            if np.abs(points).max() * np.abs(asked).sum(axis=1).max() >= 2.0**53:
                raise OverflowError("ball tree: products of these vectors may be beyond 53 bits")
            for query, id_, floor in zip(asked, ask["id"].to_pylist(), floors, strict=True):
                got = tree.search(points, ids, query, id_, k, -np.inf if floor is None else float(floor))
                names.append(np.full(len(got[0]), id_))
                found.append(got[0])
                scores.append(got[1].astype(np.int64))
        return hits_table(names, found, scores, pa.int64())

    def search(asks: DataFrame) -> DataFrame:
        held = rows.select("shard", "id", "v", F.lit(None).cast("bigint").alias("floor"))
        groups = in_shares(asks, held, "shard", SHARD_ROWS).groupBy("shard", "block", "share")
        return groups.applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")

    nothing = F.lit(None).cast("bigint")
    first = stage(search(queries.select(F.col("home").alias("shard"), "id", "v", nothing.alias("floor"))), "first_hits")
    # with fewer than k candidates at home there is no kth score to share
    kth = ranked(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    known = queries.join(kth.select(F.col("query_id").alias("id"), "floor"), "id", "left")

    def send(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in chunks(batch.num_rows, 256):
                own = batch.slice(part.start, part.stop - part.start)
                asked = matrix(own["v"])
                reaches = np.sqrt((asked**2).sum(axis=1))[:, None] * np.maximum(radii, 0)
                bounds = asked @ centroids.T + reaches
                bounds += 1e-9 * (1 + np.abs(bounds) + reaches)
                floors = np.array([-np.inf if f is None else float(f) for f in own["floor"].to_pylist()])
                reach = (bounds >= floors[:, None]) & np.isfinite(radii)
                reach[np.arange(len(asked)), own["home"].to_numpy()] = False
                row, shard = np.nonzero(reach)
                taken = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), taken["id"], taken["v"], taken["floor"]], names=["shard", "id", "v", "floor"]
                )

    others = batches(known.select("id", "v", "home", "floor")).mapInArrow(send, "shard int, id bigint, v array<bigint>, floor bigint")
    return ranked(first.unionAll(search(others)), k)
