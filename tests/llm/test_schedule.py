"""The packing schedule against a round-robin that is run step by step."""

from __future__ import annotations

import random
import time
import tracemalloc
from fractions import Fraction

import pytest

from factspan.llm import packing


def stepwise(totals, weights, window):
    """Order of (queue, token) of a deficit round-robin: credit by weight, serve whole tokens, carry the rest."""
    credit, served, order = [Fraction(0)] * len(totals), [0] * len(totals), []
    while len(order) < sum(totals):
        left = min(Fraction(window), sum(totals) - sum(credit))
        while left:
            live = [q for q, t in enumerate(totals) if credit[q] < t]
            share = sum(weights[q] for q in live)
            # until the first of them runs dry, whose share then goes to the others
            step = min(left, *((totals[q] - credit[q]) * share / weights[q] for q in live))
            for q in live:
                credit[q] += step * weights[q] / share
            left -= step
        for q, c in enumerate(credit):
            order += [(q, i) for i in range(served[q], int(c))]
            served[q] = int(c)
    return order


def placed(schedule, totals, stretch):
    found = {}
    for q, total in enumerate(totals):
        for first in range(0, total, stretch):
            count = min(stretch, total - first)
            covered = 0
            for start, size, position in schedule.place(q, first, count):
                assert start == covered
                covered += size
                for i in range(size):
                    assert position + i not in found
                    found[position + i] = (q, first + start + i)
            assert covered == count
    return [found[i] for i in range(len(found))]


@pytest.mark.parametrize("seed", range(12))
def test_closed_form_equals_the_steps(seed):
    r = random.Random(seed)
    totals = [r.randrange(1, 120) for _ in range(r.randrange(1, 9))]
    weights = [Fraction(t) for t in totals] if seed % 3 == 0 else [Fraction(r.randrange(1, 30), r.choice([1, 2, 7])) for _ in totals]
    window = r.choice([7, 16, 50])
    schedule = packing.Schedule(totals, weights, window, 16)
    assert placed(schedule, totals, r.choice([1, 5, 33])) == stepwise(totals, weights, window)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("fan", [2, 3])
def test_trees_place_every_token_once_and_keep_the_shares(monkeypatch, seed, fan):
    monkeypatch.setattr(packing, "QUEUES", fan)
    r = random.Random(seed)
    totals = [r.randrange(1, 400) for _ in range(r.randrange(4, 30))]
    weights = [Fraction(t) for t in totals] if seed % 2 else [Fraction(r.randrange(1, 30)) for _ in totals]
    window = 40
    schedule = packing.Schedule(totals, weights, window, 16)
    assert len(schedule.rounds) > 1
    order = placed(schedule, totals, 9)
    assert sorted(order) == [(q, i) for q, t in enumerate(totals) for i in range(t)]
    flat = packing.Flow.together([packing.Flow.source(t, w) for t, w in zip(totals, weights, strict=True)])
    served = [0] * len(totals)
    for at, (q, i) in enumerate(order):
        assert i == served[q]  # a source's tokens stay in order
        served[q] += 1
        if at % window == 0:
            level = flat.level(at + 1)
            for s, t, w in zip(served, totals, weights, strict=True):
                # a window of every node on the way, and a token of rounding each
                assert abs(s - min(t, w * level)) <= len(schedule.rounds) * (window + 2)


def test_a_hundred_thousand_sources():
    r = random.Random(1)
    totals = [r.randrange(1, 2000) for _ in range(100_000)]
    weights = [Fraction(t) for t in totals]
    tracemalloc.start()
    begun = time.time()
    schedule = packing.Schedule(totals, weights, 64 * 1024, 1024)
    for q in (0, 5, 99_999, 50_000):
        assert sum(n for _, n, _ in schedule.place(q, 0, totals[q])) == totals[q]
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    assert time.time() - begun < 60
