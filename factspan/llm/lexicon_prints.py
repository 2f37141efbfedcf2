"""Document fingerprints by I-Match over randomised lexicon subsets.

Terms are words (A to Z lowered). The lexicon is the band of terms that neither too many nor too few
documents hold: at most ``common`` of all documents, and so many at least that the lexicon has at
most ``lexicon`` terms whatever the corpus (a term held by r documents or more takes r of all
postings, so there are at most postings / r of them). Frequencies are counted over all documents.
A document's terms in the lexicon, distinct and sorted, are hashed as a whole and within ``SUBSETS``
random subsets of the lexicon at three dyadic rates. A subset of rate 2 ** -s holds a term if the
first s bits of the term's product with the subset's odd number are 0; s is chosen so that a
document has about one term in each. A document with less than a quarter of its words in the
lexicon (very short ones, members of a group of copies that is a large part of the corpus, unique
codes) is taken by all its words instead.

A subset's hashes agree where none of the terms in which two documents differ is in the subset, so
the share that agrees is (1 - 2 ** -s) ** d for d such terms; ``likeness`` solves it for d and
returns the share of their terms that both hold, 1 - d / (n + m). Where the numbers of terms are
more than about four times apart no subset rate is in both prints, and it is 0.

Fingerprint, in hexadecimal: the hash of all terms (16 digits), their number (8), the first rate
(2), and one byte per subset and rate. Equal sets of terms have equal fingerprints.

Defined cases: null texts are empty; texts without words share the fingerprint of no terms. The
next document of a row is that of the next larger id (of several texts of an id the least), after
the largest id that of the smallest; a single document follows itself. Rows without id have a
fingerprint, but no next document: the columns on the edited text and ``near_next`` are null.
Repeated rows are each answered. Texts move once, by id, in ranges whose bounds come from all ids;
rows of one id lie in one range, those without id are spread. A task streams its rows and holds one
batch and one text more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches
from factspan.llm.words import mix, slices, word_hashes
from factspan.session import stage

COMMON = 0.125
LEXICON = 1 << 18
SUBSETS = 64
RATES = 3
PARTS = 4  # ranges per shuffle partition
_ODD = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOLD = np.uint64(0x94D049BB133111EB)


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of every text, one after the other, and how many each has."""
    words, bounds = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((words, text))
    words, text = words[order], text[order]
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    return words[first], np.bincount(text[first], minlength=len(texts))


def lexicon(docs: DataFrame, *, text_column: str = "text", common: float = COMMON, size: int = LEXICON) -> np.ndarray:
    """Sorted hashes of the terms in the band; at most ``size`` of them."""

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            held = [distinct_terms(part)[0] for _, part in slices(batch["text"])]
            terms, docs_ = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            # the row without a term counts all postings
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *terms.view(np.int64).tolist()], pa.int64()), pa.array(np.append(docs_.sum(), docs_), pa.int64())],
                names=["term", "docs"],
            )

    total = docs.count()
    texts = batches(docs.select(F.col(text_column).alias("text")))
    counted = texts.mapInArrow(count, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    table = stage(counted.where("term is null or docs >= 2"), "document_frequencies")
    postings = table.where("term is null").agg(F.sum("docs")).first()[0] or 0
    rare = max(2, -(-postings // size))
    band = table.where(F.col("term").isNotNull() & F.col("docs").between(rare, int(common * total))).select("term")
    return np.sort(band.toArrow()["term"].to_numpy().view(np.uint64))


@dataclass(frozen=True)
class Prints:
    """Fingerprints of several texts."""

    whole: np.ndarray
    counts: np.ndarray
    rates: np.ndarray
    codes: np.ndarray  # texts x RATES x SUBSETS bytes

    def row(self, at: int) -> Prints:
        return Prints(*(part[at : at + 1] for part in (self.whole, self.counts, self.rates, self.codes)))

    def take(self, at: np.ndarray) -> Prints:
        return Prints(self.whole[at], self.counts[at], self.rates[at], self.codes[at])

    @staticmethod
    def joined(parts: list[Prints]) -> Prints:
        return Prints(*(np.concatenate(p) for p in zip(*((x.whole, x.counts, x.rates, x.codes) for x in parts), strict=True)))

    def texts(self) -> list[str]:
        head = np.column_stack([
            self.whole.astype(">u8")[:, None].view(np.uint8), self.counts.astype(">u4")[:, None].view(np.uint8),
            self.rates.astype(np.uint8), self.codes.reshape(len(self.codes), -1),
        ])
        return [row.tobytes().hex() for row in np.ascontiguousarray(head)]

    @staticmethod
    def parse(texts: list[str]) -> Prints:
        raw = np.array([list(bytes.fromhex(t)) for t in texts], np.uint8).reshape(len(texts), 13 + RATES * SUBSETS)
        return Prints(
            np.ascontiguousarray(raw[:, :8]).view(">u8")[:, 0].astype(np.uint64),
            np.ascontiguousarray(raw[:, 8:12]).view(">u4")[:, 0].astype(np.int64),
            raw[:, 12].astype(np.int64), raw[:, 13:].reshape(len(texts), RATES, SUBSETS),
        )


def _folded(groups: np.ndarray, terms: np.ndarray, count: int) -> np.ndarray:
    """One hash per group of the terms that follow each other in it; ``groups`` rise."""
    out = np.zeros(count, np.uint64)
    sizes = np.bincount(groups, minlength=count)
    at = np.cumsum(sizes) - sizes
    left = np.flatnonzero(sizes)
    step = 0
    while len(left):
        out[left] = mix(out[left] * _FOLD + terms[at[left] + step] + np.uint64(1))
        step += 1
        left = left[sizes[left] > step]
    return out


def prints(texts: pa.Array, held: np.ndarray) -> Prints:
    """Fingerprints of ``texts`` under the lexicon ``held`` (sorted)."""
    parts = []
    for _, part in slices(texts):
        terms, sizes = distinct_terms(part)
        text = np.repeat(np.arange(len(part)), sizes)
        at = np.minimum(np.searchsorted(held, terms), max(0, len(held) - 1))
        known = held[at] == terms if len(held) else np.zeros(len(terms), bool)
        few = 4 * np.bincount(text[known], minlength=len(part)) < sizes
        use = known | few[text]
        terms, text = terms[use], text[use]
        counts = np.bincount(text, minlength=len(part))
        rates = np.maximum(1, np.rint(np.log2(np.maximum(counts, 1)))).astype(np.int64)
        limit = (np.uint64(1) << (np.uint64(64) - rates.astype(np.uint64)))[text]
        codes = np.zeros((len(part), RATES, SUBSETS), np.uint8)
        for k, odd in enumerate(_ODD):
            drawn = terms * odd
            inside = np.flatnonzero(drawn < limit)
            for rate in range(RATES):
                if rate:
                    inside = inside[drawn[inside] < limit[inside] >> np.uint64(rate)]
                codes[:, rate, k] = _folded(text[inside], terms[inside], len(part)) >> np.uint64(56)
        ends = np.cumsum(counts)
        whole = [xxhash.xxh64_intdigest(terms[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        parts.append(Prints(np.array(whole, np.uint64), counts, rates, codes))
    none = np.zeros(0, np.int64)
    return Prints.joined(parts) if parts else Prints(none.astype(np.uint64), none, none, np.zeros((0, RATES, SUBSETS), np.uint8))


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Share of their terms that the texts of ``a`` and ``b`` have in common, row by row."""
    rate = np.maximum(a.rates, b.rates)
    rows = np.arange(len(rate))
    both = (rate - a.rates < RATES) & (rate - b.rates < RATES)
    left = a.codes[rows, np.minimum(rate - a.rates, RATES - 1)]
    right = b.codes[rows, np.minimum(rate - b.rates, RATES - 1)]
    agree = (left == right).mean(axis=1)
    agree = np.maximum((256 * agree - 1) / 255, 0.5 / SUBSETS)  # one byte agrees by chance once in 256
    differ = np.log(agree) / np.log1p(-(0.5**rate))
    differ = np.maximum(differ, np.abs(a.counts - b.counts))
    out = np.clip(1 - differ / np.maximum(a.counts + b.counts, 1), 0, 1)
    same = (a.whole == b.whole) & (a.counts == b.counts)
    return np.where(same, 1.0, np.where(both, out, 0.0))


def fingerprints(docs: DataFrame, held: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row under the lexicon ``held``."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(prints(batch["text"], held).texts(), pa.string())], names=["id", "fingerprint"]
            )

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return batches(chosen).mapInArrow(run, "id bigint, fingerprint string")


def in_id_order(docs: DataFrame) -> DataFrame:
    """(part, lent, id, text) rows of (id, text), ids falling within a part, led by the rows of the next id after the part.

    Rows without an id are spread over negative parts.
    """
    spark = docs.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(parts))
    loose = docs.where("id is null").select((-1 - spread).cast("int").alias("part"), F.lit(False).alias("lent"), "id", "text")
    known = docs.where("id is not null").withColumn("at", F.col("id").cast("double"))
    cuts = known.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0]
    if not cuts:
        return loose
    ends = [-float("inf"), *sorted(set(cuts)), float("inf")]  # at most ``parts`` numbers
    placed = Bucketizer(splits=ends, inputCol="at", outputCol="part").transform(known).withColumn("part", F.col("part").cast("int"))
    heads = sorted((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.min("id").alias("head")).collect())
    first, before = [None] * (len(ends) - 1), [None] * (len(ends) - 1)
    for k, (part, own) in enumerate(heads):
        first[part], before[part] = own, heads[k - 1][0]
    of_part = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("part"))
    here = F.struct(F.col("part"), F.lit(False).alias("lent"))
    there = F.struct(of_part(before, "int").alias("part"), F.lit(True).alias("lent"))
    head = F.col("id") == of_part(first, "bigint")
    to = F.explode(F.when(head, F.array(here, there)).otherwise(F.array(here))).alias("to")
    dealt = placed.select(to, "id", "text").select("to.part", "to.lent", "id", "text").unionByName(loose)
    return dealt.repartition("part").sortWithinPartitions("part", F.desc("lent"), F.desc("id"), F.desc("text"))


def with_next(docs: DataFrame, held: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter of the characters (rounded
    down) replaced by as many of the beginning of the next document's, or all it has.

    (id, n_chars, fingerprint, edited_fingerprint, near_edited, near_next, edited_sha256); the digest
    tells edited texts apart without moving them.
    """
    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, source = None, None, None  # the row before: its part and id, its text and print; those that it follows
        for batch in batches_:
            for at, part in slices(batch["text"]):
                texts, own = part.to_pylist(), prints(part, held)
                parts, lent, ids = (batch[n].slice(at, len(part)).to_pylist() for n in ("part", "lent", "id"))
                donors, edited, rows = [], [], []
                for i, text in enumerate(texts):
                    here = (parts[i], lent[i], ids[i])
                    if here != key:
                        key, source = here, last
                    if ids[i] is None:
                        donors.append(own.row(i))
                        edited.append(None)
                    elif not lent[i]:
                        cut = len(text) // 4
                        donors.append(source[1])
                        edited.append(text[: len(text) - cut] + source[0][:cut])
                    if not lent[i]:
                        rows.append(i)
                    last = (text, own.row(i))
                if not rows:
                    continue
                kept, known = own.take(np.array(rows)), np.array([e is not None for e in edited])
                changed = pa.array(edited, pa.string())
                other = prints(changed, held)
                hidden = lambda values: pa.array(np.asarray(values), mask=~known)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()),
                        pa.array(kept.texts(), pa.string()),
                        pa.array([f if k else None for f, k in zip(other.texts(), known, strict=True)], pa.string()),
                        hidden(likeness(kept, other)), hidden(likeness(kept, Prints.joined(donors))),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() if e is not None else None for e in edited], pa.string()),
                    ],
                    names=["id", "n_chars", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_sha256"],
                )

    kind = (
        "id bigint, n_chars bigint, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "edited_sha256 string"
    )
    return batches(in_id_order(chosen)).mapInArrow(run, kind)
