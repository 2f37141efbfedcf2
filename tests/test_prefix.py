"""Ordered passes over ranges against plain statements, with one hot series."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan.operators import intervals, prefix, series


def points(seed, count=400):
    r = random.Random(seed)
    names = [None, "a", "b", "hot", "hot", "hot"]
    return [(r.choice(names), i, r.choice([None, float(r.randrange(50))])) for i in r.sample(range(count * 3), count)]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_previous_and_sums_at_any_number_of_ranges(spark, parts, monkeypatch):
    data = points(parts)
    df = spark.createDataFrame(data, "k string, t int, v double").repartition(5)
    got = prefix.sums_before(df, ["k"], ["t"], {"total": F.col("v"), "rows": F.lit(1)}, parts).collect()
    assert len(got) == len(data)
    for x in got:
        before = [v for k, t, v in data if k == x["k"] and t < x["t"]]
        assert (x["total"], x["rows"]) == (sum(v for v in before if v is not None), len(before))
    cut = prefix.in_ranges(df, ["k"], ["t"], parts)
    for x in prefix.carried_previous(cut, ["k"], ["t"], ["t", "v"]).collect():
        before = max(((t, v) for k, t, v in data if k == x["k"] and t < x["t"]), default=None, key=lambda p: p[0])
        assert (x["previous"] and tuple(x["previous"])) == before


def test_a_hot_series_lies_in_many_tasks(spark):
    df = spark.range(20_000).selectExpr("'hot' as k", "cast(id as int) as t", "cast(id % 7 as double) as v")
    cut = prefix.in_ranges(df, ["k"], ["t"], 16)
    sizes = [r["count"] for r in cut.groupBy(prefix.SEGMENT).count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3_000
    area = series.trapezoid(df, ["k"], ["t"], "t", "v").first()["integral"]
    v = np.arange(20_000) % 7
    assert area == pytest.approx(np.sum((v[1:] + v[:-1]) / 2))
    plan = series.trapezoid(df, ["k"], ["t"], "t", "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # only the table with one row per range is ordered by series alone
    assert windows and all(prefix.SEGMENT in line for line in windows)


def test_merge_as_of_equals_a_plain_statement(spark):
    r = random.Random(5)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    names = [None, "a", "hot", "hot", "hot"]
    events = [(r.choice(names), day(r.randrange(300)), i) for i in range(500)]
    aliases = []
    for name in (None, "a", "hot"):
        starts = sorted(r.sample(range(-20, 290), 12))
        for s, e in zip(starts, [*starts[1:], None], strict=True):
            end = None if e is None and name == "a" else day((e or 295) - r.choice([0, 0, 3]))
            if end is None or end > day(s):
                aliases.append((name, f"{name}{s}", day(s), end))
    left = spark.createDataFrame(events, "entity_id string, day date, n int").repartition(6)
    right = spark.createDataFrame(aliases, "entity_id string, label string, valid_start date, valid_end date")
    want = sorted((n, label) for k, d, n in events for e, label, s, t in aliases if e == k and s <= d and (t is None or d < t))
    found = intervals.alias_as_of(left, right)
    assert sorted((x["n"], x["label"]) for x in found.collect()) == want
    assert found.columns == ["entity_id", "day", "n", "label", "valid_start", "valid_end"]
    for parts in (1, 40):
        merged = prefix.merge_as_of(left, right, ["entity_id"], "day", "valid_start", parts)
        merged = merged.where("valid_end is null or day < valid_end")
        assert sorted((x["n"], x["label"]) for x in merged.collect()) == want


@pytest.mark.parametrize("parts", [1, 9])
def test_rolling_trend_equals_a_fit_per_origin(spark, parts):
    data = [(k, 2 * t + 100, v) for k, t, v in points(8, 120)]
    grid = spark.createDataFrame(data, "k string, t int, v double")
    got = series.rolling_trend(grid, ["k"], "t", "v", minimum=4, parts=parts).collect()
    seen = 0
    for k in {k for k, _, _ in data}:
        own = sorted((t, v) for name, t, v in data if name == k)
        for i, (t, v) in enumerate(own):
            past = [(a, b) for a, b in own[:i] if b is not None]
            row = next((x for x in got if x["k"] == k and x["origin"] == t), None)
            assert (row is None) == (len(past) < 4)
            if row:
                slope, level = np.polyfit(*zip(*past, strict=True), 1)
                assert row["training_rows"] == len(past) and row["slope"] == pytest.approx(slope, abs=1e-9)
                assert row["forecast"] == pytest.approx(level + slope * t)
                assert (row["error"] is None) if v is None else row["error"] == pytest.approx(v - level - slope * t)
                seen += 1
    assert seen > 40
    flat = spark.createDataFrame([("x", 3, 1.0)] * 2 + [("x", 4, 2.0)], "k string, t int, v double")
    assert series.rolling_trend(flat, ["k"], "t", "v", minimum=2).count() == 0
