"""Words of whole texts as 64-bit hashes, on Arrow arrays and numpy.

A word is a maximal run of characters other than the space and U+0009 to U+000D; A to Z are
lowered, nothing else is. Texts are handled in slices of about a megabyte, so memory follows the
longest single text, not the batch. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of ``texts`` of about ``limit`` bytes, one text at least, with their start."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def plain(texts: pa.Array) -> pa.Array:
    """Lowered texts with only letters and digits between single spaces."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " ")


def hashed(strings: pa.Array) -> np.ndarray:
    """64-bit hash of every string, A to Z lowered; every distinct string is hashed once."""
    coded = strings.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    digest = xxhash.xxh64_intdigest  # bytes.lower() touches ASCII letters only
    own = np.fromiter((digest(s.lower()) for s in distinct), np.uint64, len(distinct))
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.uint64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order as written, and for each text where its words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
    return flat, bounds


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    flat, bounds = split_words(texts)
    return hashed(flat), bounds


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles of one text, in order; with fewer words, one for all."""
    if not len(words):
        return words
    take = min(width, len(words))
    out = np.full(len(words) - take + 1, take, np.uint64) * _GOLDEN
    for j in range(take):
        out = mix(out * _M2 + words[j : j + len(out)])
    return out
