"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

Every source is a queue of its documents' tokens, in the order of the input. A window holds
``window`` tokens; in every round a source is credited its weight's share of the window and
serves whole tokens from its credit, the rest is its deficit and carries over to the next
window, whatever partition that is made in. A source that runs dry leaves its share to the
others by weight. By default a source weighs its tokens, so every window has the mixture of all
documents and all queues end together.

With served tokens counted from the start, the round-robin has a closed form: after k windows a
source has served min(its tokens, weight * v(k)), rounded down, where v(k) is the level at which
all sources together have served k windows. Every task can therefore place its own tokens, given
only how many tokens of each source lie before it: no window is ever gathered, and no token
shuffled. The windows follow each other without gaps and are cut into sequences of ``length``.
The last, short stretch is cut into powers of two, so nothing is padded.

The round-robin is a tree: a node has at most ``QUEUES`` queues, of sources or of nodes below it. A
node's queue is credited what its sources are credited together, so at every level v all sources
have the shares they would have in one flat round; within the node's own run of tokens its queues
take turns by the same rule. Any number of sources, one or a million, is served by the same rule,
and placing a token looks at ``QUEUES`` numbers per step of the tree.

Defined cases: a null text is empty, and every document ends with token 0, so all have a piece.
Null sources are one queue. Repeated rows are packed each. An empty table has no pieces.
Strings of special tokens in a text are read as ``tokenizers`` reads them by default.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factspan.llm.shared import batches, stage_small
from factspan.llm.words import slices
from factspan.session import stage

LENGTH = 1024
WINDOW = 64 * LENGTH
QUEUES = 256  # of one node
# Fixed value: how byte-level BPE cuts a text into words before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranked(path: str) -> tiktoken.Encoding | None:
    """The vocabulary of a ``tokenizers`` file as byte ranks, if it is plain byte-level BPE whose
    ids follow the order of its merges; then both libraries give the same ids."""
    with open(path, encoding="utf-8") as source:
        made = json.load(source)
    model, splitter = made["model"], made.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE" and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space")
        and splitter.get("use_regex", True) and not made.get("normalizer") and not model.get("dropout")
    )
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    order = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not plain or any(x >= y for x, y in zip(order[:-1], order[1:], strict=True)):
        return None
    byte, special = _byte_of_char(), {t["content"] for t in made.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, equal to those of ``tokenizers`` for the same file.

    Plain byte-level vocabularies are read into ``tiktoken``, which is several times faster. Texts
    that hold a special token, or a run of a thousand characters without a space, on which its
    merging is slow, are left to ``tokenizers``, and so is every text of another kind of vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's cores are Spark's to share out
        self.slow = Tokenizer.from_file(path)
        self.fast = _ranked(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, part in slices(pc.fill_null(texts, "")):
            odd = pc.match_substring_regex(part, "[^ ]{1000}")
            for s in self.special:
                odd = pc.or_(odd, pc.match_substring(part, s))
            for text, left in zip(part.to_pylist(), odd.to_pylist(), strict=True):
                if left or self.fast is None:
                    yield np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield self.fast.encode_to_numpy(text, disallowed_special=())


def id_type(path: str) -> np.dtype:
    """Little-endian type of two or four bytes that holds every id of a vocabulary."""
    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(id, queue, part, before, tokens, ids): ids as little-endian bytes of the least width that holds
    the vocabulary, ``end`` last, and how many tokens of the same queue the task, ``part``, has written before."""
    kind = id_type(tokenizer)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches_:
            sources = [None if s is None else str(s) for s in batch["source"].to_pylist()]
            before, counts, blobs = [], [], []
            for source, ids in zip(sources, encoder(tokenizer).encode(batch["text"]), strict=True):
                blobs.append(np.append(ids, np.uint32(end)).astype(kind).tobytes())
                counts.append(len(ids) + 1)
                before.append(given.get(source, 0))
                given[source] = before[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sources, pa.string()), pa.array([part] * len(sources), pa.int32()),
                 pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["id", "queue", "part", "before", "tokens", "ids"],
            )

    return batches(docs).mapInArrow(run, "id bigint, queue string, part int, before bigint, tokens bigint, ids binary")


class Flow:
    """Tokens that some sources have been credited at a level: sources that run dry at one level are one step."""

    def __init__(self, steps: dict[Fraction, tuple[int, Fraction]]):
        self.steps = steps
        self.levels = sorted(steps)
        self.dry, self.active = [0], [sum((w for _, w in steps.values()), Fraction(0))]
        for level in self.levels:
            tokens, weight = steps[level]
            self.dry.append(self.dry[-1] + tokens)
            self.active.append(self.active[-1] - weight)
        self.served = [d + v * a for v, d, a in zip(self.levels, self.dry[1:], self.active[1:], strict=True)]
        self.total = self.dry[-1]

    @staticmethod
    def source(tokens: int, weight: Fraction) -> Flow:
        return Flow({Fraction(tokens) / weight: (tokens, weight)})

    @staticmethod
    def together(flows: list[Flow]) -> Flow:
        steps: dict[Fraction, tuple[int, Fraction]] = {}
        for flow in flows:
            for level, (tokens, weight) in flow.steps.items():
                held = steps.get(level, (0, Fraction(0)))
                steps[level] = (held[0] + tokens, held[1] + weight)
        return Flow(steps)

    def at(self, level: Fraction) -> Fraction:
        """Tokens credited at a level."""
        i = bisect_right(self.levels, level)
        return self.dry[i] + level * self.active[i]

    def level(self, tokens: int | Fraction) -> Fraction:
        """The level at which so many tokens are credited."""
        i = min(bisect_right(self.served, tokens), len(self.levels) - 1)
        return min((tokens - self.dry[i]) / self.active[i], self.levels[i]) if self.active[i] else self.levels[-1]


class Round:
    """Deficit round-robin over the queues of one node, in windows of its run of tokens, in whole numbers."""

    def __init__(self, queues: list[Flow], window: int):
        self.queues, self.window = queues, window
        self.all = Flow.together(queues)
        self.bounds = lru_cache(64)(self._bounds)

    def _bounds(self, k: int) -> tuple[list[int], list[int]]:
        """Tokens each queue has served after k windows, and their sums before each queue and in all."""
        if k * self.window >= self.all.total:
            served = [q.total for q in self.queues]
        else:
            level = self.all.level(k * self.window)
            served = [int(q.at(level)) for q in self.queues]
        return served, [0, *accumulate(served)]

    def _window_of(self, queue: int, token: int) -> int:
        k = int(self.all.at(self.queues[queue].level(token)) // self.window)
        while k > 0 and self.bounds(k)[0][queue] > token:
            k -= 1
        while self.bounds(k + 1)[0][queue] <= token:
            k += 1
        return k

    def place(self, queue: int, first: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, position) of the stretches of ``count`` tokens from ``first`` of a queue."""
        done, k = 0, self._window_of(queue, first)
        while done < count:
            (now, now_sums), (after, after_sums) = self.bounds(k), self.bounds(k + 1)
            take = min(count - done, after[queue] - (first + done))
            if take > 0:
                ahead = after_sums[queue] - now_sums[queue]
                yield done, take, now_sums[-1] + ahead + first + done - now[queue]
                done += take
            k += 1


class Schedule:
    """Where tokens go, from the sources' total tokens and weights alone."""

    def __init__(self, totals: list[int], weights: list[Fraction], window: int, length: int):
        self.length, self.all = length, sum(totals)
        flows = [Flow.source(t, w) for t, w in zip(totals, weights, strict=True)]
        self.rounds: list[list[Round]] = []  # from the sources up to the one node at the top
        while not self.rounds or len(flows) > 1:
            own = [flows[at : at + QUEUES] for at in range(0, len(flows), QUEUES)]
            self.rounds.append([Round(queues, window) for queues in own])
            flows = [r.all for r in self.rounds[-1]]
        tail = self.all % length
        self.tail = self.all - tail
        self.pieces = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]

    def place(self, queue: int, first: int, count: int, step: int = 0) -> Iterator[tuple[int, int, int]]:
        """(start, length, position) of the stretches of ``count`` tokens from ``first`` of a source."""
        node, own = divmod(queue, QUEUES)
        stretches = self.rounds[step][node].place(own, first, count)
        if step + 1 == len(self.rounds):
            yield from stretches
            return
        for start, size, position in stretches:
            for further, part, place in self.place(node, position, size, step + 1):
                yield start + further, part, place

    def cut(self, position: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of a stretch at a position of the whole run of tokens."""
        while count:
            if position < self.tail:
                sequence, offset = divmod(position, self.length)
                room = self.length - offset
            else:
                sequence, offset = self.tail // self.length, position - self.tail
                for room in self.pieces:
                    if offset < room:
                        break
                    offset -= room
                    sequence += 1
                room -= offset
            take = min(room, count)
            yield take, sequence, offset
            position += take
            count -= take


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    weights: dict[str | None, float] | None = None,
    window: int = WINDOW,
    length: int = LENGTH,
    end: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, tokens, sequence_id, offset, source).

    ``weights`` name the sources' target proportions; a source they leave out, or all without
    them, weighs its tokens. Tasks hold two numbers per source.
    """
    chosen = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.col(source_column).alias("source")
    )
    written = stage_small(tokenise(chosen, tokenizer, end), "tokens")
    sums = stage(written.groupBy("queue", "part").agg(F.sum("tokens").alias("tokens")), "token_sums")
    weight_of = {k: v for k, v in (weights or {}).items() if v}
    within = Window.partitionBy("queue").orderBy("part")
    offsets = stage(
        sums.withColumn("ahead", F.coalesce(F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("queue").alias("q"), F.col("part").alias("p"), "ahead"),
        "token_offsets",
    )
    totals = {r["queue"]: r["tokens"] for r in sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}
    names = sorted(totals, key=lambda n: (n is None, n or ""))
    schedule_of = (
        [totals[n] for n in names],
        [Fraction(weight_of.get(n, 0)) or Fraction(totals[n]) for n in names],
        window, length,
    )
    number = {n: i for i, n in enumerate(names)}
    kind = id_type(tokenizer)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(*schedule_of)
        for batch in batches_:
            out: list[list] = [[] for _ in range(8)]
            columns = (batch[c].to_pylist() for c in ("id", "queue", "first", "tokens"))
            for row, (id_, source, first, tokens) in enumerate(zip(*columns, strict=True)):
                ids = memoryview(np.frombuffer(batch["ids"][row].as_buffer(), kind).astype("<u4")).cast("B")
                for start, count, position in schedule.place(number[source], first, tokens):
                    for take, sequence, offset in schedule.cut(position, count):
                        piece = (id_, start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), tokens, sequence, offset, source)
                        for column, value in zip(out, piece, strict=True):
                            column.append(value)
                        start += take
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.string())],
                names=["id", "start", "length", "ids_crc32", "tokens", "sequence_id", "offset", "source"],
            )

    same = F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p"))
    joined = written.join(offsets, same).withColumn("first", F.col("ahead") + F.col("before")).drop("q", "p", "ahead")
    joined = joined.select("id", "queue", "first", "tokens", "ids")
    return batches(joined).mapInArrow(
        run,
        "id bigint, start bigint, length bigint, ids_crc32 bigint, tokens bigint, sequence_id bigint, offset bigint, source string",
    )
