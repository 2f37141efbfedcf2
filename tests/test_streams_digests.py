"""Count streams over several files and runs, and trees of digests."""

from __future__ import annotations

import random

import pytest

from factspan.queries import jobs
from factspan.session import stage
from factspan.sources import files
from factspan.streaming import births as streams

KIND = "k string, n int, v bigint"


def data(seed, count=60):
    r = random.Random(seed)
    return [(r.choice([None, "a", "b", "c"]), r.choice([None, 1, 2]), r.randrange(9)) for _ in range(count)]


def totals(rows):
    out = {}
    for k, n, v in rows:
        out[k, n] = out.get((k, n), 0) + v
    return out


@pytest.mark.parametrize("every", [1, 2, 3, 100])
def test_counts_go_on_from_the_checkpoint(spark, tmp_path, every):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    seen, table = [], streams.CountTable(state, ("k", "n"), every)
    for run in range(3):
        fresh = data(run)
        spark.createDataFrame(fresh, KIND).repartition(4).write.mode("append").parquet(folder)
        seen += fresh
        schema = spark.createDataFrame([], KIND).schema
        events = streams.file_stream(spark, folder, schema, "parquet")
        got = streams.run_counts(events, ["k", "n"], "v", path=state, compact_every=every)
        assert {(r["k"], r["n"]): r["value"] for r in got.collect()} == totals(seen)
    batches, snapshots = table.numbers(spark, "updates"), table.numbers(spark, "snapshots")
    assert batches == list(range(len(batches))) and len(batches) >= 9  # one per file
    assert snapshots == [b for b in batches if (b + 1) % every == 0]


def test_a_snapshot_that_was_cut_off_is_not_read(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = data(7)
    spark.createDataFrame(rows, KIND).repartition(4).write.parquet(folder)
    schema = spark.createDataFrame([], KIND).schema
    events = streams.file_stream(spark, folder, schema, "parquet")
    streams.run_counts(events, ["k", "n"], "v", path=state, compact_every=2)
    table = streams.CountTable(state, ("k", "n"), 2)
    last = table.numbers(spark, "snapshots")[-1]
    (tmp_path / "state" / "snapshots" / f"upto={last}" / "_SUCCESS").unlink()
    counted = streams.running_counts(events, ["k", "n"], "v").schema
    assert last not in table.numbers(spark, "snapshots")
    assert {(r["k"], r["n"]): r["value"] for r in table.read(spark, counted).collect()} == totals(rows)


def rows_of(spark, cells):
    return spark.createDataFrame(cells, "i bigint, v string, x double")


@pytest.mark.parametrize(("fan", "count"), [(2, 40), (8, 50), (64, 10), (4, 1)])
def test_changed_blocks_are_named(spark, fan, count):
    r = random.Random(fan)
    cells = [(3 * i, f"v{i}", i / 7) for i in range(count)]
    tree = files.digest_tree(rows_of(spark, cells).repartition(5), "i", fan)
    assert files.changed_blocks(tree, files.digest_tree(rows_of(spark, cells[::-1]), "i", fan), fan).count() == 0
    for change in ("value", "null", "bits", "gone", "moved", "added"):
        other, at = list(cells), r.randrange(count)
        i, v, x = other[at]
        touched = {i // fan}
        if change == "added":
            other.append((3 * i + 1 if (3 * i + 1) % 3 else i + 1, v, x))
            touched = {other[-1][0] // fan}
        elif change == "gone":
            other.pop(at)
        else:
            other[at] = {"value": (i, v + "x", x), "null": (i, None, x), "bits": (i, v, x + 1e-15), "moved": (i + 1, v, x)}[change]
            touched |= {other[at][0] // fan}
        if change == "bits" and x + 1e-15 == x:
            continue
        if not other:
            continue
        found = files.changed_blocks(tree, files.digest_tree(rows_of(spark, other), "i", fan), fan).collect()
        assert {b["block"] for b in found} == touched, change
        assert all(b["first"] == b["block"] * fan and b["last"] == b["first"] + fan - 1 for b in found)


def test_tree_of_growing_and_empty_tables(spark):
    cells = [(i, "v", 0.0) for i in range(100)]
    small, large = (files.digest_tree(rows_of(spark, cells[:n]), "i", 4) for n in (10, 100))
    assert {b["block"] for b in files.changed_blocks(small, large, 4).collect()} == set(range(2, 25))
    none = files.digest_tree(rows_of(spark, []), "i", 4)
    assert none.count() == 0 and files.table_checksum(rows_of(spark, []), "i").count() == 0
    assert {b["block"] for b in files.changed_blocks(none, small, 4).collect()} == {0, 1, 2}
    assert files.changed_blocks(none, none, 4).count() == 0
    sizes = large.groupBy("level").count().collect()
    assert {(r["level"], r["count"]) for r in sizes} == {(1, 25), (2, 7), (3, 2), (4, 1)}
    with pytest.raises(Exception, match="ordinal"):
        files.digest_tree(rows_of(spark, [(None, "v", 0.0)]), "i")


def test_checksum_tells_layouts_and_types_apart(spark):
    base = rows_of(spark, [(0, "1", 1.0)])
    others = [base.withColumnRenamed("v", "w"), base.selectExpr("i", "cast(v as int) as v", "x"),
              base.selectExpr("i", "v", "-x as x"), base.selectExpr("i", "x", "v")]
    digests = [files.table_checksum(t, "i").first()["sha256"] for t in (base, *others)]
    assert len(set(digests)) == 5
    zero, minus = (files.table_checksum(rows_of(spark, [(0, "a", z)]), "i").first() for z in (0.0, -0.0))
    assert zero == minus


def test_checksum_query_deals_into_the_parts_of_the_session(spark, tmp_path, monkeypatch):
    lines = spark.range(400).selectExpr("id as l_orderkey", "cast(1 as int) as l_linenumber", "id / 7 as l_extendedprice")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = []

    def counting(df, name):
        parts.append(df.rdd.getNumPartitions())
        return stage(df, name)

    monkeypatch.setattr(jobs, "stage", counting)
    conf = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert jobs.table_checksum(spark, str(tmp_path)).collect() == [(1, 400)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert parts == [11, 11]
