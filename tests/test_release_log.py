"""Appends that are killed, repeated or cross each other, and digests that find conflicts."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factspan.operators import history, release_log

SCHEMA = "observation_id string, fact_id string, value int, domain string, release_id string"


def rows(frame):
    return sorted((r["release_id"], r["observation_id"], r["value"]) for r in frame.collect())


@pytest.fixture
def batches(spark):
    def make(release, *names):
        return spark.createDataFrame([(n, "f" + n, i, "d", release) for i, n in enumerate(names)], SCHEMA)

    return make


def test_a_killed_append_is_not_seen(spark, tmp_path, batches, monkeypatch):
    path = str(tmp_path / "h")
    first, second = batches("r1", "a", "b"), batches("r2", "c")
    history.append_release(first, path)
    before = rows(history.read_history(spark, path, first.schema))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(release_log, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            history.append_release(second, path)
    assert rows(history.read_history(spark, path, first.schema)) == before
    assert len(release_log.uncommitted(spark, path)) == 1
    history.append_release(second, path)
    assert rows(history.read_history(spark, path, first.schema)) == [*before, ("r2", "c", 0)]
    assert [c.number for c in release_log.commits(spark, path)] == [1, 2]
    assert rows(history.read_history(spark, path, first.schema, upto=1)) == before


def test_a_repeated_append_adds_nothing(spark, tmp_path, batches):
    path = str(tmp_path / "h")
    batch = batches("r1", "a", "b")
    assert release_log.append(batch, path).rows == 2
    assert release_log.append(batch.unionAll(batch), path) is None
    more = release_log.append(batches("r1", "b", "a", "c", "c").distinct(), path)
    assert more.rows == 2 and more.releases == {"r1"}  # c twice, with two values
    assert len(release_log.commits(spark, path)) == 2
    assert release_log.append(batch.where("false"), path) is None


@pytest.mark.parametrize("other", ["r1", "r2"])
def test_writers_that_cross_lose_and_repeat_nothing(spark, tmp_path, batches, monkeypatch, other):
    path = str(tmp_path / "h")
    mine, theirs = batches("r1", "a", "b"), batches(other, "b", "c")
    commit, crossed = release_log.commit, []

    def late(spark_, path_, entry):
        if not crossed:
            crossed.append(entry.number)
            release_log.append(theirs, path_)  # takes the number first
        commit(spark_, path_, entry)

    monkeypatch.setattr(release_log, "commit", late)
    history.append_release(mine, path)
    got = [(r, o) for r, o, _ in rows(history.read_history(spark, path, mine.schema))]
    assert got == sorted({("r1", "a"), ("r1", "b"), (other, "b"), (other, "c")})
    assert [c.number for c in release_log.commits(spark, path)] == [1, 2]
    with pytest.raises(release_log.Taken):
        commit(spark, path, release_log.Commit(2, "t", 0, frozenset()))


def test_nothing_committed_reads_as_empty(spark, tmp_path, batches):
    schema = batches("r", "a").schema
    assert history.read_history(spark, str(tmp_path / "none"), schema).count() == 0
    with pytest.raises(ValueError, match="no release"):
        release_log.append(batches(None, "a"), str(tmp_path / "h"))


def test_digests_tell_nulls_places_and_nested_values_apart(spark):
    schema = "id string, a string, b string, c array<int>, d double"
    pairs = [
        (("x", None, [1], 0.0), (None, "x", [1], 0.0)),
        ((None, "x", [1], 0.0), (None, None, [1], 0.0)),
        (("x", "y", [1, None], 0.0), ("x", "y", [None, 1], 0.0)),
        (("x", "y", [], 0.0), ("x", "y", None, 0.0)),
        (("x", "y", [1], 1.0), ("x", "y", [1], None)),
    ]
    data = [(str(i), *side) for i, pair in enumerate(pairs) for side in pair]
    same = [("same", "x", None, [1, None], 0.0), ("same", "x", None, [1, None], -0.0), ("nan", None, None, None, float("nan"))]
    frame = spark.createDataFrame(data + same + same[2:], schema)
    found = history.inconsistent(frame, "id", ["a", "b", "c", "d"])
    assert sorted(r["id"] for r in found.collect()) == [str(i) for i in range(len(pairs))]


def test_conflicts_take_one_scan_and_hash(spark, tmp_path):
    spark.range(100).selectExpr(
        "cast(id % 40 as string) as observation_id", "cast(id % 20 as string) as fact_id", "id % 10 as k", "id % 3 as value"
    ).write.parquet(str(tmp_path / "t"))
    found = history.history_conflicts(spark.read.parquet(str(tmp_path / "t")), ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan
    assert found.where("conflict = 'fact_id'").count() == 0 and found.where("conflict = 'observation_id'").count() == 40


def test_newest_states_never_sort_whole_rows_before_the_choice(spark, tmp_path):
    spark.range(200).selectExpr(
        "if(id % 5 = 0, null, cast(id % 5 as string)) as fact_id", "timestamp_seconds(id div 10) as available_at",
        "cast(id as string) as observation_id", "id as value",
    ).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    states = history.newest_states(table, F.lit(datetime(2030, 1, 1)))
    assert "SortAggregate" not in states._jdf.queryExecution().executedPlan().toString()
    got = {r["fact_id"]: (r["observation_id"], r["ambiguous"]) for r in states.collect()}
    assert got == {None: ("195", True), **{str(k): (max(str(190 + k), str(195 + k)), True) for k in (1, 2, 3, 4)}}
