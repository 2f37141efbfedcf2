from __future__ import annotations

import math
import random
from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factspan.operators import (
    counts,
    exposure,
    history,
    intervals,
    metrics,
    reconcile,
    reporting,
    series,
)
from factspan.operators.rules import ContractViolation
from factspan.queries import QUERIES

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- history -------------------------------------------------------------------

HISTORY = "fact_id string, available_at timestamp, observation_id string, value double"


def clock(day):
    return datetime(2024, 1, day)


def test_latest_is_inclusive_and_per_fact(spark):
    df = spark.createDataFrame(
        [("a", clock(1), "o1", 1.0), ("a", clock(3), "o2", 2.0), ("a", clock(5), "o3", 3.0),
         ("b", clock(2), "o4", None)], HISTORY)
    got = history.latest_as_of(df, F.lit(clock(3)))
    assert rows(got, "fact_id", "observation_id") == [("a", "o2"), ("b", "o4")]
    assert history.latest_as_of(df, F.lit(datetime(2023, 1, 1))).count() == 0
    assert got.columns == df.columns


def test_a_tie_is_an_error_and_a_repeat_is_not(spark):
    df = spark.createDataFrame(
        [("a", clock(1), "o1", 1.0), ("a", clock(1), "o1", 1.0)], HISTORY)
    assert history.latest_as_of(df, F.lit(clock(9))).count() == 1
    tied = df.unionAll(spark.createDataFrame([("a", clock(1), "o10", 1.0)], HISTORY))
    with pytest.raises(Exception, match="newest clock"):
        history.latest_as_of(tied, F.lit(clock(9))).collect()
    found = history.ambiguous_revisions(tied, F.lit(clock(9)))
    assert rows(found, "fact_id", "observations") == [("a", 2)]
    later = tied.unionAll(spark.createDataFrame([("a", clock(2), "o2", 1.0)], HISTORY))
    assert history.ambiguous_revisions(later, F.lit(clock(9))).count() == 0


def test_query_flags_ties_and_keeps_the_last_instant(spark, tmp_path):
    events = [(1, 7, "a", "2024-01-14 10:00:00"), (2, 7, "a", "2024-01-14 10:00:00"), (3, 7, "b", "2024-01-15 00:00:00"),
              (4, 8, "a", "2024-01-15 00:00:01"), (5, 8, "b", "2024-01-01 00:00:00"), (6, 8, "b", "2024-01-02 00:00:00")]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, ts string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "event_id / 2.0D as value"
    ).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["latest_as_of"](spark, str(tmp_path))
    assert rows(found, "user_id", "event_type", "event_id", "value", "ambiguous") == [
        (7, "a", 2, 1.0, True), (7, "b", 3, 1.5, False), (8, "b", 6, 3.0, False)]


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 3), st.sampled_from(["", "a", "ab", "b"])),
                min_size=1, max_size=30))
def test_newest_states_equal_a_plain_statement(spark, data):
    df = spark.createDataFrame(
        [(str(f), clock(d), o, float(i)) for i, (f, d, o) in enumerate(data)], HISTORY)
    got = {r["fact_id"]: (r["available_at"].day, r["observation_id"], r["ambiguous"])
           for r in history.newest_states(df, F.lit(clock(2))).collect()}
    want = {}
    for fact in {str(f) for f, d, _ in data if d <= 2}:
        top = max(d for f, d, _ in data if str(f) == fact and d <= 2)
        ids = {o for f, d, o in data if str(f) == fact and d == top}
        want[fact] = (top, max(ids), len(ids) > 1)
    assert got == want


def test_history_conflicts_and_creation(spark):
    schema = "observation_id string, fact_id string, key string, value double"
    one = spark.createDataFrame([("o1", "f1", "k", 1.0)], schema)
    two = spark.createDataFrame([("o1", "f1", "k", 2.0), ("o2", "f1", "other", 1.0)], schema)
    assert rows(history.history_conflicts(one.unionAll(two), ["key"]), "conflict", "id") == [
        ("fact_id", "f1"), ("observation_id", "o1")]
    with pytest.raises(ContractViolation):
        history.create_history([one, two], ["key"])
    assert history.create_history([one, one], ["key"]).count() == 2
    with pytest.raises(ContractViolation):
        history.strict_union(one, one.withColumn("value", F.lit(1)))


def test_identity_merge(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "id string, payload string")
    assert history.merge_identities(a, a).count() == 2
    with pytest.raises(Exception, match="two payloads"):
        history.merge_identities(a, a.withColumn("payload", F.lit("3"))).collect()


# --- reconcile -----------------------------------------------------------------


def test_compare_matches_null_keys_one_to_one(spark):
    left = spark.createDataFrame([("a", None, 3.0), ("b", 1, 2.0)], "k string, n int, value double")
    right = spark.createDataFrame([("a", None, 3.0), ("b", 1, 5.0)], "k string, n int, value double")
    got = reconcile.reconcile(left, right, ["k", "n"], "final_annual")
    assert rows(got, "k", "difference", "status") == [
        ("a", 0.0, "reconciled_final"), ("b", -3.0, "different_final")]
    with pytest.raises(ContractViolation, match="same_key_set"):
        reconcile.reconcile(left, right.where("k = 'a'"), ["k", "n"], "final_annual")
    with pytest.raises(ContractViolation, match="left_key_unique"):
        reconcile.reconcile(left.unionAll(left), right, ["k", "n"], "final_annual")


def test_compared_sides_are_not_sent_to_the_driver(spark, tmp_path):
    # packed on disk far below their size in memory, so Spark's size check would broadcast them
    for name in ("left", "right"):
        spark.range(500).selectExpr("id as k", "repeat('x', 4000) as n", "1.0D as value").write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    compared = reconcile.compare_values(left, right, ["k", "n"], "final_annual")
    assert compared.where("status = 'reconciled_final'").count() == 500
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_set_status(spark):
    a = spark.createDataFrame([(None, 1), (1, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 1), (1, 9), (3, 2)], "k int, v int")
    assert rows(reconcile.set_status(a, b, ["k"], ["v"]), "k", "status") == sorted(
        [(None, "equal"), (1, "different"), (2, "only_left"), (3, "only_right")], key=repr)


def test_three_way_enforces(spark):
    def side(e, d, names):
        return spark.createDataFrame([("t", 1, e, d)], f"table_id string, age int, {names}")

    public = side(5, 2, "exposed bigint, deaths bigint")
    book = side(4, 1, "exposed bigint, deaths bigint")
    good = side(1, 1, "delta_exposed bigint, delta_deaths bigint")
    bad = side(2, 1, "delta_exposed bigint, delta_deaths bigint")
    assert reconcile.three_way(public, book, good, mode="enforce").first()["qx_reconciled"]
    assert not reconcile.three_way(public, book, bad).first()["qx_reconciled"]
    with pytest.raises(Exception, match="reconciliation failed"):
        reconcile.three_way(public, book, bad, mode="enforce").collect()


def test_controls_may_list_a_subset(spark):
    audit = spark.createDataFrame([("year", "1", 5), ("year", "2", 6)], "audit string, key string, n bigint")
    controls = spark.createDataFrame([("year", "2", 6), ("year", "3", 1)],
                                     "audit string, key string, expected bigint")
    assert rows(counts.control_differences(controls, audit), "key", "agrees") == [
        ("2", True), ("3", False)]


# --- intervals -----------------------------------------------------------------


@FEW
@given(st.lists(st.floats(0.5, 40.0), min_size=1, max_size=6), st.integers(1, 9))
def test_bin_weights_conserve_mass_and_are_exact_for_straight_lines(spark, widths, step):
    low, bins = 0.0, []
    for w in widths:
        bins.append((f"b{len(bins)}", low, low + w))
        low += w
    top = step * (int(low / step) + 1)
    nodes = spark.createDataFrame([(float(x),) for x in range(0, top + 1, step)], "x double")
    table = spark.createDataFrame(bins, "out string, age_lower double, age_upper double")
    weights = intervals.linear_weights(table, intervals.grid_cells(nodes, "x"), ["out"], 7.0)
    got = {r["out"]: (r["m"], r["l"]) for r in weights.groupBy("out").agg(
        F.sum("weight").alias("m"), F.sum(F.col("weight") * (2 + 3 * F.col("node"))).alias("l")
    ).collect()}
    for name, a, b in bins:
        mass, line = got[name]
        assert mass == pytest.approx(b - a)
        assert line == pytest.approx(2 * (b - a) + 1.5 * (b * b - a * a))


@FEW
@given(st.integers(0, 10_000))
def test_overlap_join_equals_all_pairs(spark, seed):
    rng = random.Random(seed)

    def make(n):
        spans = []
        for i in range(n):
            a = rng.uniform(0, 50)
            spans.append((i, a, a + rng.choice([0.1, 3.0, 20.0])))
        return spans

    left, right = make(12), make(9)
    a = spark.createDataFrame(left, "i int, a0 double, a1 double")
    b = spark.createDataFrame(right, "j int, b0 double, b1 double")
    got = rows(intervals.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), 4.0), "i", "j")
    want = sorted(((i, j) for i, a0, a1 in left for j, b0, b1 in right if a0 < b1 and b0 < a1), key=repr)
    assert got == want


def test_rebin_needs_one_target(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0, 5), ("m", 85.0, None, 2)],
                               "sex string, age_lower double, age_upper double, n int")
    got = intervals.rebin(df, ["sex"], [(0, 80), (80, None)], "n")
    assert rows(got, "bin", "n") == [(0, 5), (1, 2)]
    with pytest.raises(Exception, match="exactly one"):
        intervals.rebin(df, ["sex"], [(0, 10)], "n").collect()


def test_alias_as_of_is_exact_at_interval_edges(spark):
    aliases = spark.createDataFrame(
        [("e", "old", date(1999, 6, 1), date(2001, 1, 1)), ("e", "new", date(2001, 1, 1), None)],
        "entity_id string, label string, valid_start date, valid_end date")
    days = [date(1999, 5, 31), date(1999, 6, 1), date(2000, 12, 31), date(2001, 1, 1),
            date(2150, 1, 1), date(2500, 1, 1)]
    events = spark.createDataFrame([("e", d) for d in days], "entity_id string, day date")
    got = rows(intervals.alias_as_of(events, aliases), "day", "label")
    assert got == [(days[1], "old"), (days[2], "old"), (days[3], "new"), (days[4], "new"),
                   (days[5], "new")]


def test_interpolate(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 20.0)], "k string, x double, v double")
    points = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 2.5), ("a", 10.0), ("a", 11.0),
                                    ("b", 1.0)], "k string, at double")
    got = intervals.interpolate(points, nodes, ["k"], "at", "x", "v", 3.0)
    assert rows(got, "k", "at", "v") == sorted(
        [("a", -1.0, None), ("a", 0.0, 0.0), ("a", 2.5, 5.0), ("a", 10.0, 20.0), ("a", 11.0, None),
         ("b", 1.0, None)], key=repr)


def test_bins_on_a_scale(spark):
    df = spark.createDataFrame(
        [("g", 0.0, 5.0, False), ("g", 4.0, 9.0, False), ("h", 0.0, None, True), ("h", 5.0, 9.0, False)],
        "g string, age_lower double, age_upper double, age_open boolean")
    assert rows(intervals.overlapping_bins(df, ["g"]), "g", "age_lower") == [("g", 0.0), ("h", 0.0)]
    assert rows(intervals.open_not_last(df, ["g"]), "g") == [("h",)]


def test_operator_composition_is_associative(spark):
    rng = random.Random(3)

    def weights(outs, nodes):
        return spark.createDataFrame(
            [(o, n, rng.uniform(-1, 1)) for o in outs for n in nodes],
            "out string, node string, weight double")

    a, b, c = weights("xy", "pq"), weights("pq", "rst"), weights("rst", "uv")
    left = intervals.compose_operators(intervals.compose_operators(a, b), c)
    right = intervals.compose_operators(a, intervals.compose_operators(b, c))
    l, r = ({(x["out"], x["node"]): x["weight"] for x in t.collect()} for t in (left, right))
    assert l.keys() == r.keys()
    assert all(l[k] == pytest.approx(r[k]) for k in l)


# --- exposure and algebra ------------------------------------------------------


def surface(spark, *cells):
    return spark.createDataFrame(list(cells), "age int, value double")


def test_misaligned_surfaces_fail_instead_of_shrinking(spark):
    a = surface(spark, (1, 2.0), (2, None))
    b = surface(spark, (1, 4.0), (2, 5.0))
    assert rows(exposure.central_rate(a, b, ["age"]), "age", "rate") == [(1, 0.5), (2, None)]
    for broken in (b.where("age = 1"), b.unionAll(surface(spark, (3, 1.0)))):
        with pytest.raises(Exception, match="not aligned"):
            exposure.central_rate(a, broken, ["age"]).collect()


@FEW
@given(st.lists(st.tuples(st.floats(0, 1e3), st.floats(0.1, 1e3)), min_size=1, max_size=8))
def test_rate_algebra(spark, pairs):
    a = surface(spark, *[(i, x) for i, (x, _) in enumerate(pairs)])
    b = surface(spark, *[(i, y) for i, (_, y) in enumerate(pairs)])
    forward, backward = exposure.rate_sum(a, b, ["age"]), exposure.rate_sum(b, a, ["age"])
    assert rows(forward, "age", "value") == rows(backward, "age", "value")
    doubled = exposure.rate_times_exposure(exposure.scaled(a, 2), b, ["age"])
    plain = exposure.rate_times_exposure(a, b, ["age"])
    for x, y in zip(rows(doubled, "age", "value"), rows(plain, "age", "value"), strict=True):
        assert x[1] == pytest.approx(2 * y[1])


def test_annual_exposure(spark):
    stocks = spark.createDataFrame([("m", 2020, 10.0), ("m", 2021, 20.0), ("m", 2022, None)],
                                   "sex string, year int, value double")
    got = exposure.annual_exposure(stocks, ["sex"])
    assert rows(got, "year", "exposure") == [(2020, 15.0), (2021, None)]
    assert rows(exposure.requested_years(got, [2020]), "year") == [(2020,)]
    with pytest.raises(Exception, match="not consecutive"):
        exposure.annual_exposure(stocks.where("year <> 2021"), ["sex"]).collect()


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 115), st.integers(-5, 115)), max_size=25))
def test_sweep_line_equals_counting_every_age(spark, data):
    data = [*data, ("a", 0, 0)]
    df = spark.createDataFrame(data, "t string, lower_age int, upper_age int")
    got = {(r["t"], r["age"]): r["exposed"] for r in exposure.exposed_by_age(df, ["t"]).collect()}
    tables = {t for t, a, b in data if max(a, 0) <= min(b, 110)}
    assert {t for t, _ in got} == tables
    for t in tables:
        for age in range(111):
            assert got[t, age] == sum(x == t and a <= age <= b for x, a, b in data)


def test_cube_addition(spark):
    cube = spark.createDataFrame([("a", 1, 1.0)], "variable string, age int, value double")
    more = spark.createDataFrame([("b", 1, 2.0)], "variable string, age int, value double")
    both = exposure.add_variable(cube, more, ["age"])
    assert exposure.select_cells(both, variable="b").count() == 1
    with pytest.raises(ValueError, match="age"):
        exposure.add_variable(cube, more.withColumn("age", F.lit(2)), ["age"])
    with pytest.raises(ValueError, match="taken"):
        exposure.add_variable(cube, cube, ["age"])


def test_units():
    assert exposure.same_dimension("1 / month", "1 / year")
    assert not exposure.same_dimension("person", "event")
    exposure.require_unit("rate", "1 / month")
    with pytest.raises(ValueError):
        exposure.require_unit("rate", "1 / month", annual=True)


# --- series and metrics --------------------------------------------------------


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), min_size=1, max_size=40,
                unique=True), st.integers(1, 9))
def test_previous_row_crosses_segments(spark, data, width):
    df = spark.createDataFrame([(k, t, t * 10) for k, t in data], "k string, t int, v int")
    linked = series.previous_row(df, ["k"], ["t"], ["v"], F.floor(F.col("t") / width))
    got = {(r["k"], r["t"]): r["p"] for r in linked.select("k", "t", F.col("previous.v").alias("p")).collect()}
    want = {}
    for k, t in data:
        earlier = [u for j, u in data if j == k and u < t]
        want[k, t] = max(earlier) * 10 if earlier else None
    assert got == want


def test_yearly_sums_keep_a_short_last_year(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(14)], "k string, i int, n int")
    assert rows(series.yearly_sums(df, ["k"], "i", "n"), "year_index", "n", "steps") == [
        (0, 12, 12), (1, 2, 2)]


def test_gaps(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 0), ("c", 0)], "k string, i int")
    assert rows(series.gaps(df, ["k"], "i"), "k") == [("b",), ("c",)]


def test_trend_band(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.001), ("a", 2, 0.5, 0.001), ("b", 1, 1.0, 0.1)],
                               "k string, t int, l double, s double")
    got = {(r["k"], r["horizon"]): r for r in series.trend_band(df, ["k"], "t", "l", "s", 2).collect()}
    assert math.log(got["a", 2]["mean"]) == pytest.approx(1.5)
    spread = 1.959963984540054 * 0.03 * math.sqrt(2 * 2)
    assert math.log(got["a", 2]["upper"]) == pytest.approx(1.5 + spread)
    assert got["b", 1]["mean"] == pytest.approx(math.e)


def test_diagnostics(spark):
    y, mu = [100.0, 110.0, 105.0, 120.0, 115.0, 125.0], [102.0, 108.0, 107.0, 118.0, 117.0, 123.0]
    df = spark.createDataFrame(
        [("s", i, a, b) for i, (a, b) in enumerate(zip(y, mu, strict=True))],
        "k string, t int, observed double, expected double")
    got = metrics.diagnostic_report(df, ["k"], parameters=2).first()
    r = [(a - b) / b**0.5 for a, b in zip(y, mu, strict=True)]
    assert got["dispersion"] == pytest.approx(sum(x * x for x in r) / 4)
    assert got["mean_absolute_error"] == pytest.approx(2.0)
    same = df.withColumn("expected", F.col("observed"))
    assert metrics.poisson_deviance(same, ["k"]).first()["deviance"] == 0
    test = metrics.ljung_box_test(df.withColumn("r", metrics.pearson(F.col("observed"), F.col("expected"))),
                                  ["k"], "t", "r", lags=2).first()
    mean = sum(r) / 6
    c = [x - mean for x in r]
    rho = [sum(c[i] * c[i - k] for i in range(k, 6)) / sum(x * x for x in c) for k in (1, 2)]
    q = 6 * 8 * sum(p * p / (6 - k) for k, p in zip((1, 2), rho, strict=True))
    assert test["lag_used"] == 2
    assert test["statistic"] == pytest.approx(q)
    assert 0 <= test["p_value"] <= 1


@pytest.mark.parametrize(("x", "df", "p"), [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05),
                                            (11.070497693516351, 5, 0.05), (13.361566136511726, 8, 0.1)])
def test_chi_square_tail(x, df, p):
    assert metrics.chi_square_tail(x, df) == pytest.approx(p, rel=1e-9)


# --- reporting -----------------------------------------------------------------


def test_projected_rows_cannot_be_projected_again(spark):
    from tests.test_rules import frame

    long = reporting.project_long({"health_system": frame(spark, "health_system", {}),
                                   "demographic": frame(spark, "demographic", {})})
    assert long.columns == list(reporting.LONG_COLUMNS)
    shown = {r["projected_domain"]: r["display_dimensions"] for r in long.collect()}
    assert shown["demographic"] == (
        '{"age_lower":15.0,"age_open":false,"age_upper":20.0,"cause":"not_applicable",'
        '"commune":null,"region":"CL","sex":"male"}')
    assert reporting.repeated_observations(long).count() == 1
    with pytest.raises(ContractViolation):
        reporting.project_domain(long, "demographic")
    bad = frame(spark, "demographic", {"age_lower": float("inf")})
    with pytest.raises(Exception, match="not finite"):
        reporting.project_domain(bad, "demographic").collect()
