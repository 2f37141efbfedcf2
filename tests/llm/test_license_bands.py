"""Banded against whole alignment, and what winnowing promises."""

from __future__ import annotations

import random

import numpy as np
import pytest

from factspan.llm import license_scan

INDEX = license_scan.Index(license_scan.TEMPLATES)


def changed(r, template, share, longest):
    """The template with some words replaced, left out, or followed by others."""
    out = []
    for word in template.tolist():
        kind = r.random()
        if kind < share / 3:
            continue
        out.append(r.randrange(1 << 40) if kind < 2 * share / 3 else word)
        if kind > 1 - share / 3:
            out += [r.randrange(1 << 40) for _ in range(r.randint(1, longest))]
    return out


@pytest.mark.parametrize("share", [0.05, 0.2, 0.4])
def test_band_is_wide_enough(share):
    r = random.Random(int(share * 100))
    found = 0
    for t, template in enumerate(INDEX.words):
        if len(template) < license_scan.LONG:
            continue
        for _ in range(4):
            text = [r.randrange(1 << 40) for _ in range(r.randrange(40))]
            text += changed(r, template, share, max(1, len(template) // 8)) + [r.randrange(1 << 40) for _ in range(r.randrange(40))]
            words = np.array(text, np.uint64)
            whole = max((p[0] for p in license_scan.places(template, words, INDEX.needs[t])), default=0)
            banded = [
                p[0] for own, a, b, low, high in license_scan.candidates(INDEX, words) if own == t
                for p in license_scan.places(template, words[a:b], INDEX.needs[t], low, high)
            ]
            assert max(banded, default=0) == whole
            found += whole > 0
    assert found > 10


def test_band_of_a_whole_table_is_the_whole_alignment():
    r = random.Random(3)
    for _ in range(200):
        template = np.array([r.randrange(6) for _ in range(r.randrange(1, 12))], np.uint64)
        text = np.array([r.randrange(6) for _ in range(r.randrange(1, 40))], np.uint64)
        wide = license_scan.ends(template, text, 1, -100, 100)
        score = np.zeros((len(template) + 1, len(text) + 1), int)
        match = np.zeros_like(score)
        for i in range(1, len(template) + 1):
            for j in range(1, len(text) + 1):
                same = template[i - 1] == text[j - 1]
                options = [(score[i - 1, j - 1] + (2 if same else -1), match[i - 1, j - 1] + same),
                           (score[i - 1, j] - 1, match[i - 1, j]), (score[i, j - 1] - 1, match[i, j - 1])]
                top = max(options)
                score[i, j], match[i, j] = top if top[0] > 0 else (0, 0)
        if score.max():
            assert {(f[2], f[4]) for f in wide} == {(j, i) for i, j in zip(*np.nonzero(score == score.max()), strict=True)}
        else:
            assert not wide


def test_winnowing_keeps_a_pair_of_every_run():
    for template in INDEX.words:
        if len(template) < license_scan.LONG:
            continue
        kept = set(license_scan.winnowed(license_scan.pairs(template), license_scan.WINNOW).tolist())
        for run in (3, 5, 10, 20):
            for start in range(len(template) - run + 1):
                held = sum(p in kept for p in range(start, start + run - 1))
                assert held >= (run - 1) // license_scan.WINNOW


def test_places_at_the_limit_are_candidates_with_changes_spread_evenly():
    for t, template in enumerate(INDEX.words):
        if len(template) < license_scan.LONG:
            continue
        for phase in range(5):
            # two words of five changed, as far apart as can be
            words = np.array([w if (i + phase) % 5 not in (0, 2) else 7 + i for i, w in enumerate(template.tolist())], np.uint64)
            assert any(own == t for own, *_ in license_scan.candidates(INDEX, words)), (INDEX.names[t], phase)
