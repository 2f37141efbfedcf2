"""Grouped fits, streams and file attestation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.operators import fits, intervals, metrics
from factspan.queries.base import query, table
from factspan.session import new_path, stage
from factspan.sources import files
from factspan.streaming.births import file_stream, run_counts


def _monthly(spark, sf_dir):
    """Orders per priority and month; months without orders count as zero."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    counted = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", month.cast("bigint").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = stage(counted, "monthly-orders")
    span = counted.groupBy("o_orderpriority").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = span.select("o_orderpriority", F.explode(F.sequence("t0", "t1")).alias("t"))
    return grid.join(counted, ["o_orderpriority", "t"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def _bins(spark, sf_dir):
    low = F.least(F.floor(F.col("l_quantity") / 5) * 5, F.lit(45))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", low.cast("double").alias("age_lower"))
        .agg(
            F.count_if(F.col("l_linestatus") == "F").cast("double").alias("events"),
            F.count(F.lit(1)).cast("double").alias("exposure"),
        )
        .withColumn("age_upper", F.when(F.col("age_lower") < 45, F.col("age_lower") + 5))
        .withColumn("count", F.col("exposure"))
    )


@query()
def fit_trend(spark, sf_dir):
    return fits.fit_trend(_monthly(spark, sf_dir), ["o_orderpriority"], "t", "n")


@query("""
WITH m AS (SELECT o_orderpriority, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS t,
                  count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, round(CAST(sum(n) AS DOUBLE), 2) AS total,
       round(CAST(sum(t * n) AS DOUBLE), 0) AS moment FROM m GROUP BY 1
""")
def trend_totals(spark, sf_dir):
    """The penalty is blind to straight lines, so a fit keeps the total and the first moment."""
    fitted = fits.fit_trend(_monthly(spark, sf_dir), ["o_orderpriority"], "t", "n")
    return fitted.groupBy("o_orderpriority").agg(
        F.round(F.sum("fitted"), 2).alias("total"),
        F.round(F.sum(F.col("t") * F.col("fitted")), 0).alias("moment"),
    )


@query()
def backtest(spark, sf_dir):
    return fits.rolling_backtest(_monthly(spark, sf_dir), ["o_orderpriority"], "t", "n")


@query()
def backtest_errors(spark, sf_dir):
    tested = fits.rolling_backtest(_monthly(spark, sf_dir), ["o_orderpriority"], "t", "n")
    return metrics.forecast_errors(tested, ["o_orderpriority"])


@query()
def rate_schedule(spark, sf_dir):
    ages = [float(a) for a in range(0, 106, 5)]
    return fits.fit_rate_schedule(
        _bins(spark, sf_dir), ["l_returnflag"], ages, monotone_from=30.0, open_end=105.0
    )


@query()
def predicted_bins(spark, sf_dir):
    return fits.predict_bins(_bins(spark, sf_dir), ["l_returnflag"], open_end=105.0)


@query("""
SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS events
FROM lineitem GROUP BY 1
""")
def predicted_totals(spark, sf_dir):
    """The spline penalty is blind to a constant, so expected events add up to the observed."""
    predicted = fits.predict_bins(_bins(spark, sf_dir), ["l_returnflag"], open_end=105.0)
    return predicted.groupBy("l_returnflag").agg(F.round(F.sum("expected"), 2).alias("events"))


@query()
def ungroup(spark, sf_dir):
    nodes = [float(a) for a in range(0, 106)]
    return fits.ungroup(_bins(spark, sf_dir), ["l_returnflag"], nodes, open_end=105.0)


@query("""
WITH b AS (SELECT l_returnflag, least(CAST(floor(l_quantity / 5) AS INTEGER) * 5, 45) AS lo,
                  count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, CAST(lo AS DOUBLE) AS age_lower, CAST(n AS DOUBLE) AS total FROM b
""")
def ungroup_totals(spark, sf_dir):
    """Integrals of the ungrouped curves over their bins: the published totals."""
    nodes = [float(a) for a in range(0, 106)]
    bins = stage(_bins(spark, sf_dir), "bins")
    curve = stage(fits.ungroup(bins, ["l_returnflag"], nodes, open_end=105.0), "curve")
    closed = bins.select(
        "l_returnflag", "age_lower", F.coalesce("age_upper", F.lit(105.0)).alias("age_upper")
    )
    cells = intervals.grid_cells(curve, "node", ["l_returnflag"])
    weights = intervals.linear_weights(closed, cells, ["age_lower"], 10.0, ["l_returnflag"])
    added = intervals.apply_operator(
        weights, curve, ["age_lower"], "node", [], "density", ["l_returnflag"]
    )
    return added.select("l_returnflag", "age_lower", F.round("density", 4).alias("total"))


@query()
def ungroup_refined(spark, sf_dir):
    nodes = [float(a) for a in range(0, 106)]
    return fits.compare_ungrouping(
        stage(_bins(spark, sf_dir), "bins"), ["l_returnflag"], nodes, open_end=105.0
    )


@query("""
SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, event_type,
       count(*) AS value
FROM events GROUP BY 1, 2
""")
def stream_running_counts(spark, sf_dir):
    """Events arrive as files in two goes; the second run goes on from the first one's checkpoint."""
    keyed = lambda events: events.select(
        F.when(F.col("event_id") % 97 != 0, F.to_date("ts")).alias("day"), "event_type"
    )
    return _in_two_runs(spark, table(spark, sf_dir, "events"), "event_id", keyed, ["day", "event_type"])


def _in_two_runs(spark, rows, by, shape, key, value=None):
    """The rows written as files in two goes, each followed by a run of the count stream, file by file."""
    folder, state = new_path(spark, "arriving"), new_path(spark, "running")
    late = F.pmod(F.xxhash64(by), F.lit(5)) < 2
    for part in (rows.where(~late), rows.where(late)):
        part.repartition(3).write.mode("append").parquet(folder)
        stream = shape(file_stream(spark, folder, rows.schema, "parquet"))
        counted = run_counts(stream, key, value, path=state, compact_every=2)
    return counted


@query("""
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1
""")
def stream_running_sums(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    totals = _in_two_runs(spark, orders, "o_orderkey", lambda rows: rows, ["o_orderpriority"], "o_totalprice")
    return totals.withColumn("value", F.round("value", 2))


@query()
def file_attestation(spark, sf_dir):
    """Every table file against a manifest that lists two of them, one with a wrong size."""
    found = files.attest_files(spark, f"{sf_dir}/*.parquet")
    listed = found.where(F.col("name").isin("orders.parquet", "part.parquet")).withColumn(
        "bytes", F.col("bytes") + F.when(F.col("name") == "part.parquet", 1).otherwise(0)
    )
    return files.attestation_status(found, listed)


@query("""
SELECT 'orders_as_births' AS archive_id, count(*) AS rows, CAST(1 AS BIGINT) AS first_row,
       count(*) AS last_row, count(*) AS numbers,
       CAST(sum(o_orderkey) AS BIGINT) AS key_total FROM orders
""")
def archive_row_numbers(spark, sf_dir):
    """Row numbers of orders written as delimited text: contiguous from one."""
    path = new_path(spark, "orders-text")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    orders.write.option("header", True).option("sep", ";").csv(path)
    scan = files.scan_with_position(
        spark, path, ["o_orderkey", "o_orderpriority"], "orders_as_births"
    )
    return files.number_rows(scan).groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("archive_row_number").alias("first_row"),
        F.max("archive_row_number").alias("last_row"),
        F.count_distinct("archive_row_number").alias("numbers"),
        F.sum(F.col("o_orderkey").cast("bigint")).alias("key_total"),
    )


@query("SELECT count(*) AS rows FROM lineitem")
def content_digest(spark, sf_dir):
    """The row count, given only where the rows have a digest, so that every column is read."""
    found = files.content_digest(table(spark, sf_dir, "lineitem"))
    digested = F.col("digest").isNotNull() | (F.col("rows") == 0)
    return found.select(F.when(digested, F.col("rows")).alias("rows"))


@query("""
SELECT count(*) AS rows, CAST(sum(('0x' || substr(md5(concat_ws('|',
         coalesce(l_orderkey::VARCHAR, 'null'), coalesce(l_partkey::VARCHAR, 'null'), coalesce(l_suppkey::VARCHAR, 'null'),
         coalesce(l_linenumber::VARCHAR, 'null'), coalesce(l_quantity::DECIMAL(18, 4)::VARCHAR, 'null'),
         coalesce(l_extendedprice::DECIMAL(18, 4)::VARCHAR, 'null'), coalesce(l_discount::DECIMAL(18, 4)::VARCHAR, 'null'),
         coalesce(l_tax::DECIMAL(18, 4)::VARCHAR, 'null'), coalesce(l_returnflag, 'null'), coalesce(l_linestatus, 'null'),
         coalesce(epoch_us(l_shipdate)::VARCHAR, 'null'))), 1, 15))::BIGINT) AS VARCHAR) AS digest
FROM lineitem
""")
def content_digest_text(spark, sf_dir):
    """Digest over the text of every column, so that SQL can state it too."""
    lines = table(spark, sf_dir, "lineitem")
    found = files.content_digest(lines, text_hash(lines))
    return found.withColumn("digest", F.col("digest").cast("string"))


def text_hash(df):
    """The first 60 bits of the md5 of a row's columns as text: decimals with four places, times in microseconds."""
    def text(name, kind):
        if kind.startswith("timestamp"):
            return F.unix_micros(F.col(name).cast("timestamp")).cast("string")
        return F.col(name).cast("decimal(18,4)" if kind == "double" else kind).cast("string")

    parts = [F.coalesce(text(name, kind), F.lit("null")) for name, kind in df.dtypes]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10)


FAN = 256


def _ordered_lines(spark, sf_dir, name, change=None):
    """Line items with an ordinal, written out and read back."""
    lines = table(spark, sf_dir, "lineitem")
    ordered = lines.withColumn("place", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return stage(ordered if change is None else change(ordered), name)


@query(f"""
WITH changed AS (SELECT DISTINCT (l_orderkey * 8 + l_linenumber) // {FAN} AS block FROM lineitem
  WHERE l_orderkey % 1013 = 5 OR (l_orderkey % 1019 = 7 AND l_linenumber = 1))
SELECT block, block * {FAN} AS first, block * {FAN} + {FAN - 1} AS last FROM changed
""")
def changed_blocks(spark, sf_dir):
    """Blocks of rows that differ between two written tables: some prices changed, some lines are gone."""
    def change(rows):
        dearer = F.when(F.col("l_orderkey") % 1013 == 5, F.col("l_extendedprice") + 0.01).otherwise(F.col("l_extendedprice"))
        gone = (F.col("l_orderkey") % 1019 == 7) & (F.col("l_linenumber") == 1)
        return rows.withColumn("l_extendedprice", dearer).where(~gone)

    before, after = (_ordered_lines(spark, sf_dir, n, c) for n, c in (("lines", None), ("lines-changed", change)))
    return files.changed_blocks(files.digest_tree(before, "place", FAN), files.digest_tree(after, "place", FAN), FAN)


@query("SELECT 1::BIGINT AS checksums, count(*) AS rows FROM lineitem")
def table_checksum(spark, sf_dir):
    """One checksum for the table written twice in other orders and splits."""
    # by the ordinal, into as many parts as the session gives: a fixed number of parts grows with the table
    dealt = {"lines": lambda rows: rows.repartition("place"), "lines-turned": lambda rows: rows.repartitionByRange(F.desc("place"))}
    one, other = (_ordered_lines(spark, sf_dir, name, deal) for name, deal in dealt.items())
    both = files.table_checksum(one, "place").unionAll(files.table_checksum(other, "place"))
    return both.agg(F.count_distinct("sha256").alias("checksums")).crossJoin(one.agg(F.count(F.lit(1)).alias("rows")))
