"""Guards that no selection prunes, parts of a release, and series whose key is null."""

from __future__ import annotations

from datetime import datetime

import pytest

from factspan.operators import exposure, history, intervals, metrics, reconcile, series
from factspan.sources import files

CLOCK = datetime(2024, 1, 1)


def tied(spark):
    rows = [("f", "o1", CLOCK, 1), ("f", "o2", CLOCK, 2), ("g", "o3", CLOCK, 3)]
    return spark.createDataFrame(rows, "fact_id string, observation_id string, available_at timestamp, value int")


@pytest.mark.parametrize("use", [lambda d: d.count(), lambda d: d.select("value").collect(), lambda d: d.select("fact_id").collect()])
def test_ties_fail_under_any_selection(spark, use):
    with pytest.raises(Exception, match="newest clock"):
        use(history.latest_as_of(tied(spark), CLOCK))
    assert history.latest_as_of(tied(spark).where("observation_id <> 'o2'"), CLOCK).count() == 2


@pytest.mark.parametrize("use", [lambda d: d.count(), lambda d: d.select("k").collect(), lambda d: d.collect()])
def test_misalignment_fails_under_any_selection(spark, use):
    left = spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, value double")
    right = spark.createDataFrame([("b", 1.0), (None, 2.0)], "k string, value double")
    with pytest.raises(Exception, match="not aligned"):
        use(exposure.rate_sum(left, right, ["k"]))
    same = exposure.rate_sum(left, left, ["k"]).collect()
    assert {(r["k"], r["value"]) for r in same} == {("a", 2.0), (None, 4.0)}


def test_conflicting_identities_fail_when_counted(spark):
    left = spark.createDataFrame([("i", "x"), ("j", "y")], "id string, payload string")
    right = spark.createDataFrame([("i", "z")], "id string, payload string")
    with pytest.raises(Exception, match="two payloads"):
        history.merge_identities(left, right).count()
    assert history.merge_identities(left, left).count() == 2


def test_release_in_parts_and_again(spark, tmp_path):
    schema = "observation_id string, value int, domain string, release_id string"
    first = spark.createDataFrame([("o1", 1, "d", "r"), ("o2", 2, "d", "r")], schema)
    second = spark.createDataFrame([("o2", 2, "d", "r"), ("o3", 3, "d", "r")], schema)
    path = str(tmp_path / "history")
    for part in (first, second, first):
        history.append_release(part, path)
    rows = history.read_history(spark, path, first.schema).collect()
    assert sorted(r["observation_id"] for r in rows) == ["o1", "o2", "o3"]


def weights(spark, rows):
    return spark.createDataFrame(rows, "out string, node string, weight double")


@pytest.mark.parametrize("use", [lambda d: d.count(), lambda d: d.collect()])
def test_operators_and_surfaces_need_the_same_nodes(spark, use):
    operator = weights(spark, [("o", "a", 2.0), ("o", None, 3.0)])
    surface = spark.createDataFrame([("a", 5.0), (None, 7.0)], "node string, value double")
    assert intervals.apply_operator(operator, surface, ["out"], "node", []).first()["value"] == 31.0
    for one, other in ((operator, surface.where("node = 'a'")), (operator.where("node = 'a'"), surface)):
        with pytest.raises(Exception, match="different nodes"):
            use(intervals.apply_operator(one, other, ["out"], "node", []))
    inner = weights(spark, [("a", "x", 5.0), (None, "x", 7.0)])
    assert intervals.compose_operators(operator, inner).first()["weight"] == 31.0
    with pytest.raises(Exception, match="different nodes"):
        use(intervals.compose_operators(operator, inner.where("out = 'a'")))


def test_intervals_join_null_groups(spark):
    a = spark.createDataFrame([(None, 1.0, 3.0), ("g", 1.0, 3.0)], "g string, a0 double, a1 double")
    b = spark.createDataFrame([(None, 2.0, 4.0)], "g string, b0 double, b1 double")
    assert [r["g"] for r in intervals.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), 2.0, ["g"]).collect()] == [None]


def test_three_way_keeps_cells_that_a_side_lacks(spark):
    side = spark.createDataFrame([("t", 1, 5, 2), (None, 2, 5, 2)], "table_id string, age int, exposed bigint, deaths bigint")
    none = side.selectExpr("table_id", "age", "0L as delta_exposed", "0L as delta_deaths")
    good = reconcile.three_way(side, side, none).collect()
    assert len(good) == 2 and all(r["qx_reconciled"] for r in good)
    lacking = reconcile.three_way(side, side.where("age = 1"), none)
    assert sorted((r["age"], r["qx_reconciled"]) for r in lacking.collect()) == [(1, True), (2, False)]
    with pytest.raises(Exception, match="reconciliation failed"):
        reconcile.three_way(side, side.where("age = 1"), none, mode="enforce").count()


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20000).selectExpr("concat('row-', id) as name", "id").coalesce(1).write.option("sep", ";").csv(path, header=True)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "40000")
        numbered = files.number_rows(files.scan_with_position(spark, path, ["name", "id"], "a"))
        spark.conf.set(key, "100000")
        got = numbered.selectExpr("count(*) as n", "count(distinct archive_row_number) as d", "max(archive_row_number) as m",
                                  "count_if(archive_row_number = int(id) + 1) as same").first()
    finally:
        spark.conf.set(key, before)
    assert tuple(got) == (20000, 20000, 20000, 20000)


def test_rows_outside_the_counted_blocks_fail(spark):
    rows = spark.createDataFrame([("a", i // 3, i) for i in range(6)], "archive string, block int, position bigint")
    offsets = series.block_offsets(rows.where("position < 5"), "archive", "block", "position")
    with pytest.raises(Exception, match="outside the blocks"):
        series.archive_row_numbers(rows, offsets, "archive", "block", "position").count()


def test_uneven_lines_fail_with_positions(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("x;y\n1;2\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.scan_with_position(spark, str(tmp_path / "bad.csv"), ["x", "y"], "a").collect()


def test_checksum_of_any_size_is_one_digest(spark):
    assert files.table_checksum(spark.range(40).selectExpr("id as i", "id * 2 as v"), "i", fan=2).count() == 1
