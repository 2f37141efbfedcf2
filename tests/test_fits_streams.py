from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspan import contracts as C
from factspan.operators import counts, fits, history, intervals
from factspan.operators.rules import ContractViolation
from factspan.plans import births
from factspan.sources import files
from factspan.streaming import births as streams
from tests.test_plans import RELEASE, SPAN, birth_file
from tests.test_rules import frame

# --- fits ----------------------------------------------------------------------


def test_trend_is_the_minimum_of_its_loss(spark):
    y = np.array([100, 105, 103, 108, 111, 109, 115, 118], float)
    z = fits.trend_log_rate(y, np.ones(8), 20.0)
    d2 = np.diff(np.eye(8), n=2, axis=0)
    gradient = np.exp(z) - y + 20.0 * d2.T @ d2 @ z
    assert np.abs(gradient).max() < 1e-5
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, t int, n double")
    rows = fits.fit_trend(df, ["k"], "t", "n", penalty=20.0).orderBy("t").collect()
    assert np.allclose([r["log_fitted"] for r in rows], z)
    assert rows[0]["innovation_scale"] == pytest.approx(
        max(np.sqrt(np.mean(np.diff(z, n=2) ** 2)), 1e-3))
    with pytest.raises(Exception, match="three nonnegative"):
        fits.fit_trend(df.limit(2), ["k"], "t", "n").collect()


def test_backtest_uses_only_the_past(spark):
    y = [100, 102, 105, 104, 108, 110, 111, 115, 114]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, t int, n double")
    got = fits.rolling_backtest(df, ["k"], "t", "n", 5, 10.0).orderBy("origin").collect()
    assert [r["origin"] for r in got] == [5, 6, 7, 8]
    changed = df.withColumn("n", F.when(F.col("t") == 8, 1.0).otherwise(F.col("n")))
    again = fits.rolling_backtest(changed, ["k"], "t", "n", 5, 10.0).orderBy("origin").collect()
    assert [r["forecast"] for r in got] == [r["forecast"] for r in again]
    assert all(r["error"] == pytest.approx(r["actual"] - r["forecast"]) for r in got)


def test_spline_basis():
    knots = fits.spline_knots(0.0, 10.0, 7)
    x = np.linspace(0, 10, 101)
    basis = fits.spline_basis(x, knots)
    assert basis.shape == (101, 7)
    assert np.allclose(basis.sum(axis=1), 1)
    step = 1e-6
    numeric = (fits.spline_basis(x[1:-1] + step, knots) - fits.spline_basis(x[1:-1] - step, knots)) / (2 * step)
    assert np.allclose(fits.spline_slope(x[1:-1], knots), numeric, atol=1e-5)


def test_rate_schedule(spark):
    exposure = [600e3, 625e3, 690e3, 770e3, 715e3, 655e3, 602e3]
    events = [420, 1922, 3224, 3614, 2625, 659, 36]
    bins = spark.createDataFrame(
        [("s", 15.0 + 5 * i, 20.0 + 5 * i, float(n), e)
         for i, (n, e) in enumerate(zip(events, exposure, strict=True))],
        "k string, age_lower double, age_upper double, events double, exposure double")
    rates = [r["rate"] for r in fits.fit_rate_schedule(
        bins, ["k"], list(np.linspace(15, 50, 100)), df=7, penalty=10.0).collect()]
    assert np.isfinite(rates).all()
    assert min(rates) > 0
    total = fits.predict_bins(bins, ["k"], df=7, penalty=10.0).agg(F.sum("expected")).first()[0]
    assert total == pytest.approx(sum(events), rel=0.05)


def test_monotone_tail_does_not_fall():
    low = np.arange(0, 100, 10.0)
    exposure = np.array([10, 9, 8, 7, 6, 5, 4, 3, 2, 1]) * 1e5
    counts_ = np.array([100, 80, 100, 160, 300, 650, 1300, 2600, 4000, 3500.0])
    theta, knots = fits.fit_spline_rate(low, low + 10, counts_, exposure, 9, 5.0, 3, 40.0)
    rates = fits.spline_rate(theta, knots, np.linspace(40, 100, 121))
    assert np.diff(np.log(rates)).min() > -1e-7
    counts_[-1] = 500
    ages = np.linspace(40, 100, 121)
    free, _ = fits.fit_spline_rate(low, low + 10, counts_, exposure, 9, 5.0)
    assert np.diff(np.log(fits.spline_rate(free, knots, ages))).min() < 0
    held, _ = fits.fit_spline_rate(low, low + 10, counts_, exposure, 9, 5.0, 3, 40.0)
    assert np.diff(np.log(fits.spline_rate(held, knots, ages))).min() > -1e-7


def test_open_bins_need_an_end(spark):
    bins = spark.createDataFrame([("s", 85.0, None, 1000.0)],
                                 "k string, age_lower double, age_upper double, count double")
    with pytest.raises(Exception, match="open_end"):
        fits.ungroup(bins, ["k"], [float(i) for i in range(106)]).collect()


def test_ungrouping_keeps_totals_and_scale(spark):
    low, high = np.array([0.0, 2, 5]), np.array([2.0, 5, 10])
    totals = np.array([100.0, 240, 160])
    grid = np.linspace(0, 10, 21)
    density, matrix = fits.smooth_density(grid, low, high, totals)
    assert np.abs(matrix @ density - totals).max() < 1e-7
    assert density.min() >= 0
    scaled, _ = fits.smooth_density(grid, low, high, totals * 1000)
    assert np.allclose(scaled, 1000 * density, rtol=1e-6)
    fine, _ = fits.smooth_density(np.linspace(0, 10, 41), low, high, totals)
    assert np.allclose(fine[::2], density, rtol=0.08, atol=0.08)
    # optimality: the gradient is a mix of bin weights on free nodes, and rises at zero nodes
    gradient, free = fits._roughness(grid) @ density, density > 1e-6 * density.max()
    mix = np.linalg.lstsq(matrix[:, free].T, gradient[free], rcond=None)[0]
    rest = gradient - matrix.T @ mix
    assert np.abs(rest[free]).max() < 1e-6 * np.abs(gradient).max()
    assert (rest[~free] > -1e-6).all()
    bins = spark.createDataFrame(
        [("s", a, b, t) for a, b, t in zip(low.tolist(), high.tolist(), totals.tolist(), strict=True)],
        "k string, age_lower double, age_upper double, count double")
    curve = fits.ungroup(bins, ["k"], grid.tolist())
    weights = intervals.linear_weights(bins, intervals.grid_cells(curve, "node"), ["age_lower"], 3.0)
    added = intervals.apply_operator(weights, curve, ["age_lower"], "node", [], "density")
    got = {r["age_lower"]: r["density"] for r in added.collect()}
    assert got == pytest.approx(dict(zip(low.tolist(), totals.tolist(), strict=True)))
    compared = fits.compare_ungrouping(bins, ["k"], grid.tolist()).first()
    assert compared["relative_difference"] < 0.08


def test_ungrouping_with_empty_bins_stays_nonnegative():
    low = np.arange(0, 50, 5.0)
    totals = np.array([0, 0, 100, 0, 0, 5, 0, 900, 0, 0.0])
    density, matrix = fits.smooth_density(np.linspace(0, 50, 101), low, low + 5, totals)
    assert density.min() >= 0
    assert np.abs(matrix @ density - totals).max() < 1e-7


# --- streams -------------------------------------------------------------------


def test_shard_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    for part in range(3):
        birth_file(folder / f"{part}.csv", *[
            {"MES_NAC": str((part + i) % 12 + 1), "NACIONALIDAD_MADRE": "" if i % 2 else "C"}
            for i in range(8)], bom=False)
    seen = []
    merged = streams.two_pass(spark, str(folder), RELEASE, "dpa-2019", SPAN,
                              totals={"raw_rows": 24},
                              sidecar=lambda batch, i: seen.append(batch.count()))
    whole = births.count_facts(files.scan_births(spark, str(folder)))
    key = list(births.CANONICAL_KEY)
    assert sorted(map(tuple, merged.select(*key, F.col("value").cast("bigint")).collect()), key=repr) == \
        sorted(map(tuple, whole.select(*key, "value").collect()), key=repr)
    assert sorted(seen) == [8, 8, 8]
    with pytest.raises(ContractViolation, match="release_controls"):
        streams.two_pass(spark, str(folder), RELEASE, "dpa-2019", SPAN, totals={"raw_rows": 25},
                         sidecar=lambda batch, i: seen.append(-1))
    assert -1 not in seen


def test_running_counts_merge_null_keys_over_files(spark, tmp_path):
    data = [("a", None, 1), ("a", 1, 2), ("b", None, 3), ("a", None, 4)]
    for i in range(0, 4, 2):
        spark.createDataFrame(data[i:i + 2], "k string, n int, v bigint").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    events = streams.file_stream(spark, str(tmp_path / "in"), schema, "parquet")
    got = streams.run_counts(events, ["k", "n"], "v")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("a", None, 5), ("a", 1, 2), ("b", None, 3)], key=repr)
    batch = counts.sum_by_key(spark.read.parquet(str(tmp_path / "in")), ["k", "n"], "v")
    assert sorted(map(tuple, batch.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def test_release_history_grows_once_per_release(spark, tmp_path):
    path = str(tmp_path / "history")
    first = frame(spark, "health_system", {})
    second = frame(spark, "health_system", {
        "release_id": "factspan:release:v1:" + "b" * 64, "value": 9.0,
        "observation_id": "factspan:observation:v1:" + "b" * 64,
        "available_at": datetime(2026, 1, 1)})
    for batch in (first, second, second):
        history.append_release(batch, path)
    schema = C.domain_schema("health_system")
    table = history.read_history(spark, path, schema)
    assert table.count() == 2
    early = history.latest_as_of(table, F.lit(datetime(2025, 6, 1)).cast("timestamp"))
    late = history.latest_as_of(table, F.lit(datetime(2026, 6, 1)).cast("timestamp"))
    assert [r["value"] for r in early.collect()] == [3.0]
    assert [r["value"] for r in late.collect()] == [9.0]
    releases = table.select("release_id", "available_at").distinct()
    assert history.contributing_releases(late, releases).count() == 1
    one = history.read_history(spark, path, schema, releases.where("available_at < '2025-06-01'"))
    assert one.count() == 1


def test_streamed_releases_are_appended(spark, tmp_path):
    frame(spark, "health_system", {}).write.parquet(str(tmp_path / "in"))
    schema = C.domain_schema("health_system")
    for run in ("c1", "c2"):
        stream = streams.file_stream(spark, str(tmp_path / "in"), schema, "parquet")
        streams.stream_releases(stream, str(tmp_path / "out"), str(tmp_path / run))
    assert history.read_history(spark, str(tmp_path / "out"), schema).count() == 1


