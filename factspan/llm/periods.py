"""Periodic runs of words in whole texts by string synchronising sets.

A run is a maximal stretch of words with smallest period q (words q apart are the same) and at
least 3 * q and ``least`` words. Words are compared as written, exactly.

At each dyadic scale t = 4, 8, 16, ... positions are selected whose window of t words has the
smallest hash among the t + 1 windows from there on, or the last of them has. Whether a position
is selected depends on the 2 * t words from it alone, so copies of a context select alike. Windows
whose period is at most t / 3 do not compete; elsewhere every stretch of t words holds a selected
position. Two selected positions with the same context of 2 * t words that lie 2 * t to 4 * t - 1
words apart propose their distance as a period, which is checked word by word and extended to both
sides. Windows left out are those of highly periodic regions, which are found on their own: with
periods below 8 by direct comparison, with longer ones as the runs of the scales before.

No run is missed. Let a run have period q, 2 * t <= q < 4 * t, and start at s. If the 3 * t - 1
words from s have no period of at most t / 3, a position i < s + t is selected. Otherwise that
period p breaks before s + q + p, as else it would be the run's, and a position i <= s + q + p
- 2 * t is selected before the break. Either way both contexts, at i and i + q, lie in the run, and
the pair (i, i + q) proposes q. A context occurs at most every t / 3 words, so a position has at
most 12 partners. Only equal 64-bit hashes of different windows could hide a run.

A batch of texts is handled as one sequence with a word of its own between any two texts, the
longest text first: scale t covers those with 6 * t words or more, so work follows the words.

Defined cases: null and empty texts have no runs and an empty collapsed text; a null id stays null;
repeated rows are each answered; other columns of ``docs`` are not read. A text of any length is
one row of one task, whose memory is about 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches
from factspan.llm.words import mix, slices, split_words

LEAST = 24
DIRECT = 8  # periods below it are found by comparing words directly
TIMES = 3  # a run holds its period so many times
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true entries."""
    edges = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from minima towards both ends of blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, _NEVER)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def agreeing(words: np.ndarray, i: int, j: int) -> int:
    """How many words from ``i`` and from ``j`` on are the same, one after the other."""
    done, size = 0, 64
    while True:
        a, b = words[i + done : i + done + size], words[j + done : j + done + size]
        both = min(len(a), len(b))
        if not both:
            return done
        unlike = a[:both] != b[:both]
        first = int(unlike.argmax())
        if unlike[first]:
            return done + first
        done, size = done + both, size * 2


class Regions:
    """Maximal periodic regions [start, end) with their smallest period, by the order they were found."""

    def __init__(self) -> None:
        self.found: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        known = self.found.get((start, end))
        if known is None or period < known:  # a multiple of the smallest period spans the same region
            self.found[start, end] = period

    def rows(self) -> np.ndarray:
        return np.array([(s, e, p) for (s, e), p in self.found.items()], np.int64).reshape(-1, 3)


def selected(windows: np.ndarray, scale: int, regions: np.ndarray) -> np.ndarray:
    """The synchronising set: positions whose ``scale + 1`` windows have their minimum at an end."""
    highly = regions[(TIMES * regions[:, 2] <= scale) & (regions[:, 1] - regions[:, 0] >= scale)]
    values = windows
    if len(highly):
        edges = np.zeros(len(windows) + 1, np.int64)
        inside = highly[:, 0] < len(windows)
        np.add.at(edges, highly[inside, 0], 1)
        np.add.at(edges, np.minimum(highly[inside, 1] - scale + 1, len(windows)), -1)
        values = np.where(np.cumsum(edges[:-1]) > 0, _NEVER, windows)
    least = window_minima(values, scale + 1)
    ends = (least == values[: len(least)]) | (least == values[scale : scale + len(least)])
    return np.flatnonzero(ends & (least < _NEVER))


def proposals(positions: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of pairs with the same context 2 * scale to 4 * scale - 1 words apart."""
    order = np.argsort(contexts, kind="stable")
    at, seen = positions[order], contexts[order]
    starts, apart, lag = [], [], 1
    while lag < len(at):
        gap = at[lag:] - at[:-lag]
        near = (seen[lag:] == seen[:-lag]) & (gap < 4 * scale)
        if not near.any():
            break
        near &= gap >= 2 * scale
        starts.append(at[:-lag][near])
        apart.append(gap[near])
        lag += 1
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(apart)


def periodic_regions(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all regions that hold their period ``TIMES`` times, in the joined texts.

    ``words`` are whole numbers, texts of ``sizes`` words (the longest first) each followed by a
    number of its own.
    """
    regions = Regions()
    for period in range(1, min(DIRECT, len(words))):
        starts, ends = stretches(words[period:] == words[:-period])
        long = ends - starts >= (TIMES - 1) * period
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            regions.add(start, end + period, period)
    ends_of = np.cumsum(sizes + 1)
    backwards = words[::-1]
    windows, width, scale = mix(words.astype(np.uint64) * _STEP + _STEP), 1, DIRECT // 2
    while True:
        texts = int(np.searchsorted(-sizes, -2 * TIMES * scale, "right"))  # texts with so many words
        if not texts:
            return regions.rows()
        stop = int(ends_of[texts - 1])
        while width < 2 * scale:  # hashes of twice as many words from those of two halves
            if width == scale:
                own = windows[: stop - width + 1]
            windows = windows[: stop - width + 1]
            windows = mix(windows[:-width] * _STEP + windows[width:])
            width *= 2
        positions = selected(own, scale, regions.rows())
        at, apart = proposals(positions, windows[positions], scale)
        keys = np.unique(apart * (len(words) + 1) + at)
        k = 0
        while k < len(keys):
            period, i = divmod(int(keys[k]), len(words) + 1)
            end = i + period + agreeing(words, i, i + period)
            turned = len(words) - i
            start = i - agreeing(backwards, turned, turned - period)
            if end - start >= TIMES * period:
                regions.add(start, end, period)
            # what else proposes this period before the end is the same region
            k = max(k + 1, int(np.searchsorted(keys, period * (len(words) + 1) + max(i + 1, end - period))))
        scale *= 2


def text_runs(flat: pa.Array, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs by text, start and period, and which words stay.

    ``flat`` holds the words of all texts and ``bounds`` where each text's begin. A word goes where
    a run contains it after the run's first period.
    """
    counts = np.diff(bounds)
    stays = np.ones(len(flat), bool)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= least]
    if not len(order):
        return np.empty((0, 4), np.int64), stays
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = counts[order]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.empty(starts[-1], np.int64)
    for k, text in enumerate(order.tolist()):
        joined[starts[k] : starts[k + 1] - 1] = codes[bounds[text] : bounds[text + 1]]
        joined[starts[k + 1] - 1] = -1 - k
    found = periodic_regions(joined, sizes)
    found = found[found[:, 1] - found[:, 0] >= least]
    own = np.searchsorted(starts, found[:, 0], "right") - 1
    rows = np.stack([order[own], found[:, 0] - starts[own], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    edges = np.zeros(len(flat) + 1, np.int64)
    begins = bounds[rows[:, 0]] + rows[:, 1]
    np.add.at(edges, begins + rows[:, 3], 1)
    np.add.at(edges, begins + rows[:, 2], -1)
    stays = np.cumsum(edges[:-1]) == 0
    return rows, stays


def collapse(
    docs: DataFrame, *, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, runs, collapsed) of every row: its runs (start, length, period; words counted from 0) by
    start and period, and its words without those that repeat an earlier period, joined by spaces."""
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for at, part in slices(batch["text"]):
                flat, bounds = split_words(part)
                rows, stays = text_runs(flat, bounds, least)
                first = np.searchsorted(rows[:, 0], np.arange(len(part) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], fields=list(spans))
                ends = np.concatenate([[0], np.cumsum(stays)])[bounds].astype(np.int64)
                kept = pa.LargeListArray.from_arrays(pa.array(ends), flat.filter(pa.array(stays)))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(at, len(part)), pa.ListArray.from_arrays(pa.array(first), items),
                     pc.binary_join(kept, " ").cast(pa.string())],
                    names=["id", "runs", "collapsed"],
                )

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    kind = "id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return batches(chosen).mapInArrow(run, kind)


def strongest(runs) -> F.Column:
    """Of an array of runs the one that holds its period most often, exactly; then the first, then the shortest period."""

    def before(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    return F.get(F.array_sort(runs, before), F.lit(0))
