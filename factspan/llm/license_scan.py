"""License notices in whole texts: winnowed fingerprints pick candidates, banded alignment confirms them.

Words are runs of letters and digits, lowered. The fingerprints of a template of ``LONG`` words or
more are its pairs of neighbouring words, winnowed: of every ``WINNOW`` pairs in a row the one with
the smallest hash is kept. An inverted index leads from a pair to the templates and places that hold
it; every pair of a text is looked up. Hits of a template whose diagonals (place in the text less
place in the template) follow each other within ``band`` words are a candidate if their
places in the text, and those in the template, are a twelfth of the template's words, two at least.

What is sure: of r unchanged words in a row (r - 1) // ``WINNOW`` pairs at least are kept, so a place
that keeps such runs is a candidate as soon as these add up to a twelfth; a place at the limit of 60
per cent keeps some 13 pairs in a hundred words even if its changes are spread as evenly as can be.
Shorter templates cannot promise a sure pair. All their words but the commonest are fingerprints;
of the commonest fewer are left out than a place may lack, so every place above the limit holds some
of the others, as many as the limit asks less those left out, and none is missed, however its changed
words lie. Stretches that hold so many near to each other are the candidates.

A candidate is aligned (match 2, other -1, local) within a band: of each word of the template only
words of the text are looked at whose diagonal is at most ``band`` from one of the hits, half a
template to either side. Shifts beyond that break a place in two; up to there the words matched are
those of the whole alignment. What is left before and after a place is aligned again until nothing
reaches the limit, so copies may follow each other directly.

A row is reported per place where at least ``least`` of a template's words are matched: the
license, coverage (matched words over the template's), and the words of text and template that
the alignment spans. Rows are found in one pass over the texts, without a shuffle. The words that
tell variants and versions apart (BY, NC, ND, SA, the license's name, its number) must stand in the
place without others between them; where they do not, the license is reported as ``unknown``.

Defined cases: null and empty texts give no rows; a template found several times in a text gives
a row for each place; of places that overlap by more than half, the one with the most words
matched is reported (then one of a known license, the higher coverage, the first name); repeated rows are scanned
each; a null id is reported as null.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.llm.shared import batches
from factspan.llm.words import hashed, mix, plain, slices, split_words

LEAST = 0.6
LONG = 30  # words from which on a template has pairs for fingerprints
WINNOW = 2
# Words too common to look for, the commonest first.
COMMON = (
    "the of and to a in is for or this that with on by as be it are not you may any an at from but can all "
    "under if will other use have has was which its no such must"
).split()

# Public license notices by their usual identifiers.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
    "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(license_: str, version: str, gone: str) -> str:
    """The notice that the GNU licenses ask for, with the paragraph that names where the license is."""
    return (
        f"This program is free software{gone[0]} you can redistribute it and/or modify it under the terms of the {license_} as "
        f"published by the Free Software Foundation{gone[1]} either version {version} of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"{license_} for more details. You should have received a copy of the {license_} along with this program{gone[2]}"
    )


_WEB = (":", ",", ". If not, see https://www.gnu.org/licenses/.")
_POST = (";", ";", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA")
_CC = {
    "BY": "Attribution", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-SA": "Attribution-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_VERSIONS = (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-3-Clause-text": _BSD + _BSD_NAMES + _BSD_END,
    **{f"CC-{k}-{v}": f"Licensed under CC {k} {v}." for k in _CC for v in ("3.0", "4.0")},
    **{
        f"CC-{k}-{v}-notice": f"This work is licensed under a Creative Commons {name} {v} {scope} License."
        for k, name in _CC.items() for v, scope in (("3.0", "Unported"), ("4.0", "International"))
    },
    "CC0-1.0": "Licensed under CC0 1.0.",
    "CC0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work under the Creative Commons CC0 1.0 Universal Public Domain Dedication."
    ),
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    **{f"{k}-{v}": f"This work is licensed under the {_GNU[k]}, version {v.removesuffix('.0')}." for k, v in _VERSIONS},
    **{
        f"{k}-{v}-header": _gnu(_GNU[k], v.removesuffix(".0"), _POST if v < "3" else _WEB)
        for k, v in _VERSIONS
    },
    "ISC": "Released under the ISC License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        'this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"
    ),
}

# Words that tell a license from its kin. A place is given the name only where each stands as written.
MARKS = {
    **dict.fromkeys(("Apache-2.0", "Apache-2.0-header"), ("Apache License", "2.0")),
    "BSD-2-Clause": ("BSD 2-Clause",),
    "BSD-3-Clause": ("BSD 3-Clause",),
    "BSD-3-Clause-text": ("neither the name",),
    **{f"CC-{k}-{v}": (f"CC {k} {v}",) for k in _CC for v in ("3.0", "4.0")},
    **{f"CC-{k}-{v}-notice": (f"Creative Commons {name} {v}",) for k, name in _CC.items() for v in ("3.0", "4.0")},
    "CC0-1.0": ("CC0 1.0",),
    "CC0-1.0-notice": ("CC0 1.0",),
    "EPL-2.0": ("Eclipse Public License", "2.0"),
    "EPL-2.0-header": ("Eclipse Public License", "2.0"),
    **{f"{k}-{v}{end}": (_GNU[k], f"version {v.removesuffix('.0')}") for k, v in _VERSIONS for end in ("", "-header")},
    "ISC": ("ISC",),
    "MIT": ("MIT",),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
}
UNKNOWN = "unknown"


def pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every ``window`` in a row, the last of equals."""
    if len(hashes) <= window:
        return np.arange(len(hashes))[hashes == hashes.min()][-1:] if len(hashes) else np.empty(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    return np.unique(len(hashes) - 1 - (np.arange(len(rows)) + rows.argmin(axis=1)))


def band(size: int) -> int:
    return max(6, size // 2)


class Inverted:
    """From fingerprints to the (template, place) pairs that hold them."""

    def __init__(self, holders: dict[int, list[tuple[int, int]]]):
        self.known = np.array(sorted(holders), np.uint64)
        flat = [h for w in self.known.tolist() for h in holders[w]]
        self.templates = np.array([t for t, _ in flat], np.int64)
        self.places = np.array([p for _, p in flat], np.int64)
        self.bounds = np.cumsum([0, *(len(holders[w]) for w in self.known.tolist())])
        self.screen = np.zeros(1 << 16, bool)
        self.screen[self.known & np.uint64(0xFFFF)] = True

    def held(self, prints: np.ndarray) -> np.ndarray:
        """Places of the fingerprints that are known."""
        near = np.flatnonzero(self.screen[prints & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.known, prints[near]), max(0, len(self.known) - 1))
        return near[self.known[at] == prints[near]] if len(self.known) else near[:0]

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, place in it, place in the text) of every fingerprint that is known."""
        near = self.held(prints)
        at = np.searchsorted(self.known, prints[near])
        counts = self.bounds[at + 1] - self.bounds[at]
        before = np.cumsum(counts) - counts
        entries = np.arange(counts.sum()) + np.repeat(self.bounds[at] - before, counts)
        return self.templates[entries], self.places[entries], np.repeat(near, counts)


class Index:
    """Templates as word hashes, and the fingerprints by which they are looked for."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, marks: dict[str, tuple[str, ...]] | None = None):
        self.names = sorted(templates)
        self.marks = [[hashed(split_words(plain(pa.array([m])))[0]) for m in (marks or {}).get(n, ())] for n in self.names]
        words, bounds = split_words(plain(pa.array([templates[n] for n in self.names], pa.string())))
        hashes = hashed(words)
        if max(np.diff(bounds), default=0) > LONGEST:
            raise ValueError(f"a template has more than {LONGEST} words")
        self.words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.needs = [max(1, math.ceil(least * len(own))) for own in self.words]
        self.asked = []  # hits that make a candidate
        of_words: dict[int, list[tuple[int, int]]] = defaultdict(list)
        of_pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        common = hashed(pa.array(COMMON)).tolist()
        for t, (own, need) in enumerate(zip(self.words, self.needs, strict=True)):
            if len(own) >= LONG:
                self.asked.append(max(2, len(own) // 12))
                grams = pairs(own)
                for place in winnowed(grams, WINNOW).tolist():
                    of_pairs[int(grams[place])].append((t, place))
                continue
            looked, spare = set(own.tolist()), need - 1
            for word in common:
                count = int((own == word).sum())
                if 0 < count <= spare:
                    looked.discard(word)
                    spare -= count
            self.asked.append(spare + 1)
            for word in looked:
                of_words[word].append((t, 0))
        self.of_words, self.of_pairs = Inverted(of_words), Inverted(of_pairs)

    def name(self, template: int, words: np.ndarray) -> str:
        """The license of a place with these words: unknown where words that tell it from its kin differ."""
        for mark in self.marks[template]:
            held = np.ones(max(0, len(words) - len(mark) + 1), bool)
            for k, word in enumerate(mark):
                held &= words[k : k + len(held)] == word
            if not held.any():
                return UNKNOWN
        return self.names[template]


# One cell of the alignment in one number: score, words matched, and (turned, so that of equals the
# shorter is larger) the words of text and of template that it spans.
SCORE, MATCHED, SPAN, OWN = 1 << 45, 1 << 31, 1 << 14, 1
LONGEST = (1 << 14) - 1
FIRST = 2 * SCORE + MATCHED + ((1 << 17) - 2) * SPAN + (LONGEST - 1) * OWN


def ends(template: np.ndarray, text: np.ndarray, need: int, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """(matched, text start, text end, template start, template end) of all local alignments that
    share the best score among those with ``need`` words matched, by their ends.

    Only cells on diagonals ``low`` to ``high`` are looked at; a row holds one cell per diagonal.
    """
    low, high = max(low, 1 - len(template)), min(high, len(text) - 1)
    if low > high:
        return []
    width = high - low + 1
    # the word of the text on diagonal d in row i is padded[i + d - low]; beyond the text nothing matches
    before_text, beyond = max(0, -low), max(0, len(template) + high - len(text))
    inside = np.zeros(before_text + len(text) + beyond, bool)
    inside[before_text : before_text + len(text)] = True
    padded = np.concatenate([np.zeros(before_text, np.uint64), text, np.zeros(beyond, np.uint64)])[max(0, low) :]
    inside = inside[max(0, low) :]
    before, top, found = np.zeros(width + 1, np.int64), 0, []
    for i, word in enumerate(template.tolist()):
        here = inside[i : i + width]
        diagonal, above = before[:-1], before[1:]  # the cell above lies on the next diagonal
        row = np.where(
            (padded[i : i + width] == word) & here,
            np.where(diagonal > 0, diagonal + (2 * SCORE + MATCHED - SPAN - OWN), FIRST),
            np.maximum(diagonal, above + SPAN) - (SCORE + SPAN + OWN),
        )
        np.maximum(row, above - (SCORE + OWN), out=row)
        row[~here] = 0
        step = 1
        while step < min(width, 2 * len(template)):  # words of the text between two matches
            row[step:] = np.maximum(row[step:], row[:-step] - step * (SCORE + SPAN))
            step *= 2
        row[(row < SCORE) | ~here] = 0
        before[:-1] = row
        if i + 1 < need:
            continue
        at = np.flatnonzero((row // MATCHED) % (SCORE // MATCHED) >= need)
        if len(at) and (best := int(row[at].max()) // SCORE) >= top:
            if best > top:
                top, found = best, []
            for c in at[row[at] // SCORE == best].tolist():
                cell, j = int(row[c]), i + c + low
                span = (1 << 17) - 1 - cell // SPAN % (1 << 17)
                own = LONGEST - cell % SPAN
                found.append((cell // MATCHED % (1 << 14), j + 1 - span, j + 1, i + 1 - own, i + 1))
    return sorted(found, key=lambda f: (f[2], f[4]))


def places(
    template: np.ndarray, text: np.ndarray, need: int, low: int | None = None, high: int | None = None
) -> Iterator[tuple[int, int, int, int, int]]:
    """Alignments with ``need`` words matched, the best first, then those in what is left between them.

    All that share the best score are taken at once, so there are at most as many rounds as scores.
    Without ``low`` and ``high`` the band holds every diagonal.
    """
    low, high = -len(template) if low is None else low, len(text) if high is None else high
    left = [(0, len(text))]
    while left:
        start, stop = left.pop()
        if stop - start < need or np.isin(text[start:stop], template).sum() < need:
            continue
        done, any_ = start, False
        for matched, a, b, c, d in ends(template, text[start:stop], need, low - start, high - start):
            if start + a >= done:
                yield matched, start + a, start + b, c, d
                left.append((done, start + a))
                done, any_ = start + b, True
        if any_:
            left.append((done, stop))


def merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Regions in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(regions):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def stretches(index: Index, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(template, first word, last word, diagonals) of the stretches that can hold a place of a short template.

    An alignment that starts anew where its score is used up skips at most twice the words it
    matches, so it spans at most three times its template.
    """
    templates, _, at = index.of_words.hits(words)
    order = np.lexsort((at, templates))
    templates, at = templates[order], at[order]
    last = np.arange(len(at)) + np.array(index.asked, np.int64)[templates] - 1
    spans = 3 * np.array([len(own) for own in index.words], np.int64)[templates]
    inside = np.flatnonzero(last < len(at))
    inside = inside[templates[last[inside]] == templates[inside]]
    inside = inside[at[last[inside]] - at[inside] < spans[inside]]
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in inside.tolist():
        found[int(templates[k])].append((max(0, int(at[last[k]] - spans[k] + 1)), int(at[k] + spans[k])))
    for t, regions in found.items():
        for start, stop in merged(regions):
            stop = min(stop, len(words))
            yield t, start, stop, -len(index.words[t]), stop - start


def bands(index: Index, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(template, first word, last word, lowest and highest diagonal from there) of the bands that hold enough pairs."""
    templates, own, at = index.of_pairs.hits(pairs(words))
    diagonals = at - own
    order = np.lexsort((diagonals, templates))
    templates, diagonals, own, at = templates[order], diagonals[order], own[order], at[order]
    sizes = np.array([len(w) for w in index.words], np.int64)
    wide = np.array([band(int(n)) for n in sizes], np.int64)
    if not len(templates):
        return
    apart = (np.diff(templates) != 0) | (np.diff(diagonals) > wide[templates[1:]])
    edges = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(templates)]])
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        t = int(templates[low])
        # a common pair that the template or the text repeats counts once
        if min(len(set(own[low:high].tolist())), len(set(at[low:high].tolist()))) < index.asked[t]:
            continue
        first, last = int(diagonals[low]) - int(wide[t]), int(diagonals[high - 1]) + int(wide[t])
        start, stop = max(0, first), min(len(words), last + int(sizes[t]))
        if stop > start:
            yield t, start, stop, first - start, last - start


def candidates(index: Index, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    yield from stretches(index, words)
    if len(words) > 1:
        yield from bands(index, words)


def scan_text(index: Index, words: np.ndarray) -> list[tuple[str, float, int, int, int, int, int]]:
    """(license, coverage, matched, text start and end, template start and end), words counted."""
    rows = []
    for t, start, stop, low, high in candidates(index, words):
        template = index.words[t]
        for matched, a, b, c, d in places(template, words[start:stop], index.needs[t], low, high):
            name = index.name(t, words[start + a : start + b])
            rows.append((name, matched / len(template), matched, start + a, start + b, c, d))
    kept: list = []
    near: dict[int, list] = defaultdict(list)
    for row in sorted(rows, key=lambda r: (-r[2], r[0] == UNKNOWN, -r[1], r[0], r[3])):
        blocks = range(row[3] >> 6, (row[4] >> 6) + 1)
        others = (k for block in blocks for k in near[block])
        if all(min(row[4], k[4]) - max(row[3], k[3]) <= (row[4] - row[3]) / 2 for k in others):
            kept.append(row)
            for block in blocks:
                near[block].append(row)
    return sorted(kept, key=lambda r: (r[3], r[0], r[4]))


def scan(
    docs: DataFrame,
    *,
    templates: dict[str, str] | None = None,
    least: float = LEAST,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, license, coverage, matched, start_word, end_word, template_start, template_end) per place found."""
    texts, marks = (templates, None) if templates else (TEMPLATES, MARKS)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, least, marks)
        for batch in batches_:
            ids, rows = batch["id"].to_pylist(), []
            for start, part in slices(batch["text"]):
                flat, bounds = split_words(plain(part))
                words = hashed(flat)
                # texts without a known fingerprint hold no place
                known = np.concatenate([index.of_words.held(words), index.of_pairs.held(pairs(words))])
                for i in np.unique(np.searchsorted(bounds, known, "right") - 1).tolist():
                    found = scan_text(index, words[bounds[i] : bounds[i + 1]])
                    rows += [(ids[start + i], *r) for r in found]
            kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 5)
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            names = ["id", "license", "coverage", "matched", "start_word", "end_word", "template_start", "template_end"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return batches(chosen).mapInArrow(
        run,
        "id bigint, license string, coverage double, matched int, start_word int, end_word int, template_start int, template_end int",
    )
