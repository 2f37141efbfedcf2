"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Words here are runs of letters and digits, lowered. A text's features are which words, words cut
to four letters (for inflected forms), pairs of neighbours, and pairs with one or two words
between them occur in it, hashed to ``DIMENSIONS`` places. Every coordinate has its own learning
rate and an L1 threshold, so few weights differ from zero; only those travel to the tasks. A feature
enters with a value in proportion to how surely its shares among the two labels differ (their
difference over its standard error), so what occurs by chance in a small sample stays below the
threshold and a rare word needs more rows than a telling one. The learner reads a bounded sample, at
most ``per_label`` rows of either label (documented limit), each weighted by the rows it stands for.

Defined cases: a null or wordless text gets the score of no evidence (the bias alone). Rows with
a null id or label, or a label other than 0 and 1, teach nothing; several labels of one document
count as its greatest, several texts of one id as the first in order. With no labelled row every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches, bounded_sample
from factspan.llm.words import hashed, mix, plain, slices, split_words
from factspan.session import stage

DIMENSIONS = 1 << 20
PER_LABEL = 5000
LIMIT = 0.3
STEM = 4
GAPS = (1, 2, 3)  # neighbours, then skip-grams over one and two words


def _places(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(44)).astype(np.int32)


def all_places(texts: pa.Array) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(gap, places) by kind of feature, and where each text's words begin.

    With a gap above 0, entry i pairs word i with word i + gap, also across texts.
    """
    flat, bounds = split_words(plain(texts))
    words = hashed(flat)
    out = [(0, _places(words)), (0, _places(hashed(pc.utf8_slice_codeunits(flat, 0, STEM)) + np.uint64(1)))]
    for gap in GAPS:
        out.append((gap, _places(words[:-gap] * np.uint64(2 * gap + 1) + mix(words[gap:] + np.uint64(gap)))))
    return out, bounds


def feature_lists(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature places of every text."""
    for _, part in slices(texts):
        kinds, bounds = all_places(part)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(np.concatenate([found[low : max(low, high - gap)] for gap, found in kinds]))


@dataclass(frozen=True)
class Model:
    """Non-zero weights and the bias; at most ``DIMENSIONS`` of them, in practice a few thousand."""

    places: np.ndarray
    weights: np.ndarray
    bias: float | None

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        dense = np.zeros(DIMENSIONS, np.float32)
        dense[self.places] = self.weights
        out = np.full(len(texts), self.bias)
        for start, part in slices(texts):
            kinds, bounds = all_places(part)
            docs, places = [], []
            for gap, found in kinds:
                hit = np.flatnonzero(dense[found])
                doc = np.searchsorted(bounds, hit, "right") - 1
                inside = hit + gap < bounds[doc + 1]  # no pair across two texts
                docs.append(doc[inside])
                places.append(found[hit[inside]])
            pair = np.unique(np.concatenate(docs) * DIMENSIONS + np.concatenate(places))
            np.add.at(out, start + pair // DIMENSIONS, dense[pair % DIMENSIONS])
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def values(rows: list[np.ndarray], labels: np.ndarray, *, unit: float = 4.0, most: float = 3.0) -> np.ndarray:
    """Value of every place: the standard errors by which its shares among the labels differ, in ``unit``s."""
    held = np.zeros((2, DIMENSIONS))
    for at, label in zip(rows, labels, strict=True):
        held[int(label), at] += 1
    clean, toxic = np.maximum(1, np.sum(labels == 0)), np.maximum(1, np.sum(labels == 1))
    share = held.sum(axis=0) / max(1, len(rows))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / clean + 1 / toxic))
    return np.minimum(np.abs(held[1] / toxic - held[0] / clean) / error / unit, most)


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, *, seed: int = 5, epochs: int = 4,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0,
) -> Model:
    """FTRL-proximal over the rows in seeded orders; the bias carries no L1."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    threshold = np.full(DIMENSIONS + 1, l1)
    threshold[-1] = 0.0
    value = np.append(values(rows, labels), 1.0)

    def weights(at: np.ndarray) -> np.ndarray:
        held = z[at]
        over = np.maximum(np.abs(held) - threshold[at], 0)
        return -np.sign(held) * over / ((beta + np.sqrt(n[at])) / alpha + l2)

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at = np.append(rows[i], DIMENSIONS)
            w, x = weights(at), value[at]
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * importance[i] * x
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    final = weights(np.arange(DIMENSIONS + 1)) * value
    places = np.flatnonzero(final[:-1])
    return Model(places.astype(np.int32), final[places].astype(np.float32), float(final[-1]))


def fit(labelled: DataFrame, texts: DataFrame | None = None, *, per_label: int = PER_LABEL, seed: int = 5) -> Model:
    """Model from rows (id, label) and the ``texts`` (id, text) they mean; by default ``labelled`` has both.

    The sample is drawn over ids alone. Only its texts, at most ``2 * per_label``, are ever moved.
    """
    known = labelled.where("id is not null and label in (0, 1)")
    marks = known.groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = stage(bounded_sample(marks, "label", per_label, seed, "id"), "toxicity_ids")
    rows = (
        (labelled if texts is None else texts).select("id", "text").join(chosen, "id")
        .groupBy("id", "label", "__share").agg(F.min("text").alias("text"))
    )

    def vectors(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            found = pa.array(list(feature_lists(batch["text"])), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], found, batch["label"], batch["__share"]], names=["id", "at", "label", "share"]
            )

    kind = f"id {rows.schema['id'].dataType.simpleString()}, at array<int>, label int, share double"
    sample = stage(batches(rows).mapInArrow(vectors, kind), "toxicity_sample")

    def train(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group["id"]).to_numpy()
        lists = group["at"].combine_chunks()
        flat, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        rows = [flat[bounds[i] - bounds[0] : bounds[i + 1] - bounds[0]] for i in order]
        stands = 1 / group["share"].to_numpy()[order]
        model = ftrl(rows, group["label"].to_numpy()[order].astype(float), stands / stands.mean(), seed=seed)
        return pa.table({
            "places": pa.array([model.places], pa.list_(pa.int32())),
            "weights": pa.array([model.weights], pa.list_(pa.float32())), "bias": pa.array([model.bias], pa.float64()),
        })

    kind = "places array<int>, weights array<float>, bias double"
    got = sample.groupBy(F.lit(0).alias("all")).applyInArrow(train, kind).collect()  # one group of at most 2 * per_label rows
    if not got:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), None)
    return Model(np.array(got[0]["places"], np.int32), np.array(got[0]["weights"], np.float32), got[0]["bias"])


def score(docs: DataFrame, model: Model, columns: dict[str, Column], schema: str) -> DataFrame:
    """``columns`` of every row (``__text`` among them) with ``score`` in place of ``__text``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rest = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in rest), pa.array(model.scores(batch["__text"]), pa.float64())],
                names=[*rest, "score"],
            )

    chosen = docs.select(*(c.alias(n) for n, c in columns.items()))
    return batches(chosen).mapInArrow(run, f"{schema}, score double")


def accepted(docs: DataFrame, model: Model, *, limit: float = LIMIT, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``limit``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            yield batch.filter(pa.array(model.scores(batch[text_column]) < limit))

    return batches(docs).mapInArrow(run, docs.schema)


def marked(
    docs: DataFrame, labels: DataFrame, learn: Column, *, id_column: str = "doc_id", label_column: str = "toxic",
) -> DataFrame:
    """(id, label) of the labelled documents in ``docs`` for which ``learn`` holds over ``id``."""
    marks = labels.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(label_column).alias("label"))
    held = docs.select(F.col(id_column).cast("long").alias("id"))
    return marks.where("label is not null").where(learn).join(held, "id", "left_semi")
