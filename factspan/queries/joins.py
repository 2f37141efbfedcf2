"""Aligned, interval and range joins; exposure and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspan.functions import numbers
from factspan.operators import exposure, intervals, reconcile, units
from factspan.plans import finance
from factspan.queries.base import PENSIONERS, query, raw_pensioners, table
from factspan.session import stage

# --- aligned tables ------------------------------------------------------------

PER_USER = """
cells AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 40) AS d,
                 count(*) FILTER (WHERE value > 90) AS x
          FROM events GROUP BY 1, 2)
"""


def _cells(spark, sf_dir):
    """Three surfaces on one complete grid of (user, event type), from one scan."""
    value = F.col("value")
    counted = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.count_if(value > 40).cast("double").alias("d"),
            F.count_if(value > 90).cast("double").alias("x"),
        )
    )
    cells = stage(counted, "cells")
    return [cells.select("user_id", "event_type", F.col(c).alias("value")) for c in ("d", "n", "x")]


@query(f"""
WITH {PER_USER}
SELECT user_id, event_type, CAST(d AS DOUBLE) AS deaths, CAST(n AS DOUBLE) AS exposure,
       round(CAST(d AS DOUBLE) / n, 9) AS rate FROM cells
""")
def aligned_rate(spark, sf_dir):
    dims = ["user_id", "event_type"]
    deaths, lived, _ = _cells(spark, sf_dir)
    rate = exposure.central_rate(deaths, lived, dims)
    return rate.withColumn("rate", F.round("rate", 9))


@query(f"""
WITH {PER_USER}
SELECT user_id, event_type, round((CAST(d AS DOUBLE) / n) * n, 6) AS value FROM cells
""")
def rate_times_exposure(spark, sf_dir):
    dims = ["user_id", "event_type"]
    deaths, lived, _ = _cells(spark, sf_dir)
    rate = exposure.central_rate(deaths, lived, dims).select(*dims, F.col("rate").alias("value"))
    result = exposure.rate_times_exposure(rate, lived, dims)
    return result.withColumn("value", F.round("value", 6))


@query(f"""
WITH {PER_USER}
SELECT user_id, event_type, CAST(d + 2.5 * x AS DOUBLE) AS value FROM cells
""")
def rate_sum(spark, sf_dir):
    dims = ["user_id", "event_type"]
    some, _, more = _cells(spark, sf_dir)
    return exposure.rate_sum(some, exposure.scaled(more, 2.5), dims)


MONTHLY_CELLS = """
cells AS (SELECT l_suppkey, year(l_shipdate) AS year, count(*)::DOUBLE AS lived,
                 count(CASE WHEN l_returnflag = 'R' THEN 1 END)::DOUBLE AS lost FROM lineitem GROUP BY 1, 2)
"""


def _monthly_surfaces(spark, sf_dir):
    """Per supplier and year: persons lost, person-years, and a rate per month for suppliers of odd keys."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).cast("double").alias("lived"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("lost")
    )
    cells = stage(counted, "cells")
    dims, basis = ["l_suppkey", "year"], F.lit("resident_estimate").alias("population_basis")
    lost = cells.select(*dims, F.col("lost").alias("value"), F.lit("person").alias("unit"), basis)
    lived = cells.select(*dims, F.col("lived").alias("value"), F.lit("person * year").alias("unit"), basis)
    odd = F.col("l_suppkey") % 2 == 1
    monthly = exposure.counts_over_exposure(lost, lived, dims).withColumns(
        {"value": F.when(odd, F.col("value") / 12).otherwise(F.col("value")), "unit": F.when(odd, "1 / month").otherwise(F.col("unit"))}
    )
    return dims, monthly, lived


@query(f"""
WITH {MONTHLY_CELLS}
SELECT l_suppkey, year, round(lost / lived * lived, 6) AS value, 'person' AS unit, 'resident_estimate' AS population_basis
FROM cells
""")
def expected_counts(spark, sf_dir):
    """Expected counts from rates of mixed units, converted before they meet the exposure."""
    dims, rate, lived = _monthly_surfaces(spark, sf_dir)
    result = exposure.rate_times_exposure(units.converted(rate, "1 / year"), lived, dims)
    return result.withColumn("value", F.round("value", 6))


@query(f"""
WITH {MONTHLY_CELLS}
SELECT l_suppkey, year, round(lost / lived / CASE WHEN l_suppkey % 2 = 1 THEN 6 ELSE 0.5 END, 9) AS value,
       CASE WHEN l_suppkey % 2 = 1 THEN '1 / month' ELSE '1 / year' END AS unit, 'resident_estimate' AS population_basis
FROM cells
""")
def rates_of_one_unit(spark, sf_dir):
    """Sum of a rate surface with itself: each cell keeps its unit."""
    dims, rate, _ = _monthly_surfaces(spark, sf_dir)
    result = exposure.rate_sum(rate, rate, dims)
    return result.withColumn("value", F.round("value", 9))


@query("""
WITH u(k, unit, person, year, month, length, mass) AS (VALUES
  (0, 'person', 1, 0, 0, 0, 0), (1, 'person * year', 1, 1, 0, 0, 0), (2, '1 / year', 0, -1, 0, 0, 0), (3, '1 / month', 0, 0, -1, 0, 0),
  (4, 'dimensionless', 0, 0, 0, 0, 0), (5, 'microgram / meter ** 3', 0, 0, 0, -3, 1), (6, 'millimeter', 0, 0, 0, 1, 0))
SELECT a.unit AS left_unit, b.unit AS right_unit, count(*) AS lines,
  (a.person + b.person = 1 AND a.year + b.year = 0 AND a.month + b.month = 0 AND a.length + b.length = 0
   AND a.mass + b.mass = 0) AS is_count,
  (a.person = b.person AND a.year + a.month = b.year + b.month AND a.length = b.length AND a.mass = b.mass) AS same_dimension
FROM lineitem JOIN u a ON l_linenumber % 7 = a.k JOIN u b ON l_partkey % 7 = b.k GROUP BY ALL
""")
def unit_products(spark, sf_dir):
    names = ["person", "person * year", "1 / year", "1 / month", "dimensionless", "microgram / meter ** 3", "millimeter"]
    of = lambda c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 7 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(of("l_linenumber").alias("left_unit"), of("l_partkey").alias("right_unit"))
    a, b = units.vector(F.col("left_unit")), units.vector(F.col("right_unit"))
    marked = lines.select(
        "left_unit", "right_unit", (units.product(a, b) == units.vector(F.lit("person"))).alias("is_count"),
        (units.dimension(a) == units.dimension(b)).alias("same_dimension"),
    )
    return marked.groupBy("left_unit", "right_unit", "is_count", "same_dimension").agg(F.count(F.lit(1)).alias("lines"))


@query("""
WITH stocks AS (SELECT o_orderpriority, year(o_orderdate) AS year, count(*) AS value
                FROM orders GROUP BY 1, 2)
SELECT a.o_orderpriority, a.year, 0.5::DOUBLE * (a.value + b.value) AS exposure
FROM stocks a JOIN stocks b ON a.o_orderpriority = b.o_orderpriority AND b.year = a.year + 1
""")
def adjacent_exposure(spark, sf_dir):
    stocks = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return exposure.annual_exposure(stocks, ["o_orderpriority"])


@query("""
WITH rates AS (SELECT CAST(l_quantity AS INTEGER) AS age,
                 CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS rate,
                 CAST(count(*) AS DOUBLE) AS exposure FROM lineitem GROUP BY 1)
SELECT age, scenario, round(rate * scale * CASE WHEN age >= lo AND age < hi THEN f ELSE 1.0 END
                            * exposure, 6) AS expected
FROM rates, (VALUES ('base', 1.0::DOUBLE, 0, 1, 1.0::DOUBLE), ('boost', 1.1, 15, 35, 1.25),
                    ('relief', 1.0, 40, 99, 0.8)) AS s(scenario, scale, lo, hi, f)
""")
def scenario_expected(spark, sf_dir):
    age = F.col("l_quantity").cast("int").alias("age")
    rates = (
        table(spark, sf_dir, "lineitem")
        .groupBy(age)
        .agg(
            (F.count_if(F.col("l_returnflag") == "R").cast("double") / F.count(F.lit(1))).alias(
                "rate"
            ),
            F.count(F.lit(1)).cast("double").alias("exposure"),
        )
    )
    scenarios = [
        ("base", F.lit(1.0), 1.0),
        ("boost", numbers.band_multiplier(F.col("age"), 15, 35, 1.25), 1.1),
        ("relief", numbers.band_multiplier(F.col("age"), 40, 99, 0.8, reduction=True), 1.0),
    ]
    expected = exposure.scenario_events(rates, scenarios)
    return expected.select("age", "scenario", F.round("expected", 6).alias("expected"))


# --- bins and intervals --------------------------------------------------------

TARGET_BINS = [(0, 5), (5, 10), (10, 20), (20, 35), (35, None)]


@query("""
WITH source AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) - l_linenumber % 2 AS lo,
                       CAST(l_quantity AS INTEGER) + 1 AS hi, l_linenumber FROM lineitem),
targets AS (SELECT * FROM (VALUES (0, 0, 5), (1, 5, 10), (2, 10, 20), (3, 20, 35), (4, 35, 105))
            AS t(bin, lo, hi))
SELECT l_returnflag, t.bin, sum(l_linenumber)::BIGINT AS value
FROM source s JOIN targets t ON 0.5 * (s.lo + CASE WHEN s.lo = 50 THEN 105 ELSE s.hi END) >= t.lo
                            AND 0.5 * (s.lo + CASE WHEN s.lo = 50 THEN 105 ELSE s.hi END) < t.hi
GROUP BY 1, 2
""")
def bin_range_join(spark, sf_dir):
    quantity, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    low = quantity - line % 2
    source = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        low.cast("double").alias("age_lower"),
        F.when(low != 50, (quantity + 1).cast("double")).alias("age_upper"),
        line.cast("bigint").alias("value"),
    )
    return intervals.rebin(source, ["l_returnflag"], TARGET_BINS, "value")


ACTIVITY = """
spans AS (SELECT o_custkey, CAST(min(o_orderdate::DATE) - DATE '1995-01-01' AS DOUBLE) AS lo,
                 CAST(max(o_orderdate::DATE) - DATE '1995-01-01' + 1 AS DOUBLE) AS hi
          FROM orders GROUP BY 1),
months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
nodes AS (SELECT DISTINCT CAST(d - DATE '1995-01-01' AS DOUBLE) AS x FROM (
            SELECT m AS d FROM months
            UNION ALL SELECT CAST(m + INTERVAL 1 MONTH AS DATE) FROM months)),
cells AS (SELECT * FROM (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1 FROM nodes)
          WHERE x1 IS NOT NULL),
pieces AS (SELECT s.o_custkey, c.x0, c.x1, greatest(s.lo, c.x0) - c.x0 AS z0,
                  least(s.hi, c.x1) - c.x0 AS z1
           FROM spans s JOIN cells c ON s.lo < c.x1 AND c.x0 < s.hi),
weights AS (SELECT o_custkey, node, sum(weight) AS weight FROM (
    SELECT o_custkey, x0 AS node, (z1 - z0) - (z1 * z1 - z0 * z0) / (2 * (x1 - x0)) AS weight
    FROM pieces
    UNION ALL SELECT o_custkey, x1, (z1 * z1 - z0 * z0) / (2 * (x1 - x0)) FROM pieces)
  GROUP BY 1, 2)
"""


def _weights(spark, sf_dir):
    """Activity span of every customer integrated over a grid of month starts."""
    orders = table(spark, sf_dir, "orders")
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
    spans = orders.groupBy("o_custkey").agg(
        F.min(day).alias("age_lower"), (F.max(day) + 1).alias("age_upper")
    )
    months = orders.select(F.trunc("o_orderdate", "MM").alias("m")).distinct()
    nodes = months.select(F.explode(F.array("m", F.add_months("m", 1))).alias("d")).select(
        F.date_diff("d", F.lit("1995-01-01").cast("date")).cast("double").alias("x")
    )
    # a calendar of cells, written first so that Spark knows its size
    cells = stage(intervals.grid_cells(nodes, "x"), "cells")
    return intervals.linear_weights(spans, cells, ["o_custkey"], width=64.0)


@query(f"""
WITH {ACTIVITY}
SELECT o_custkey, round(sum(weight), 6) AS mass, round(sum(weight * node), 3) AS first_moment,
       count(*) AS nodes
FROM weights GROUP BY 1
""")
def p1_overlap_weights(spark, sf_dir):
    return (
        _weights(spark, sf_dir)
        .groupBy("o_custkey")
        .agg(
            F.round(F.sum("weight"), 6).alias("mass"),
            F.round(F.sum(F.col("weight") * F.col("node")), 3).alias("first_moment"),
            F.count(F.lit(1)).alias("nodes"),
        )
    )


@query(f"""
WITH {ACTIVITY}, surface AS (
  SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) - DATE '1995-01-01' AS DOUBLE)
           AS node, o_orderpriority, CAST(count(*) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, round(sum(weight * value), 3) AS value
FROM weights JOIN surface USING (node) GROUP BY 1, 2
""")
def operator_apply(spark, sf_dir):
    month = F.trunc("o_orderdate", "MM")
    # every month, and its successor with nothing of its own: the nodes of the weights
    both = F.array(
        F.struct(month.alias("m"), F.lit(1.0).alias("one")),
        F.struct(F.add_months(month, 1).alias("m"), F.lit(0.0).alias("one")),
    )
    node = F.date_diff("m", F.lit("1995-01-01").cast("date")).cast("double")
    counted = (
        table(spark, sf_dir, "orders")
        .select("o_orderpriority", F.inline(both))
        .groupBy("o_orderpriority", node.alias("node"))
        .agg(F.sum("one").alias("value"))
    )
    # one row per month and priority, written first so that Spark knows its size
    surface = stage(counted, "surface")
    applied = intervals.apply_operator(
        _weights(spark, sf_dir), surface, ["o_custkey"], "node", ["o_orderpriority"]
    )
    return applied.withColumn("value", F.round("value", 3))


@query("""
WITH inner_op AS (SELECT strftime(l_shipdate, '%Y-%m') AS mid, l_returnflag AS node,
                         CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
outer_op AS (SELECT DISTINCT strftime(l_shipdate, '%Y') AS out,
                    strftime(l_shipdate, '%Y-%m') AS mid,
                    1.0::DOUBLE / month(l_shipdate) AS w FROM lineitem)
SELECT o.out, i.node, round(sum(o.w * i.w), 6) AS weight
FROM outer_op o JOIN inner_op i USING (mid) GROUP BY 1, 2
""")
def operator_compose(spark, sf_dir):
    month = F.date_format("l_shipdate", "yyyy-MM")
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy(month.alias("out"), F.col("l_returnflag").alias("node"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    inner = stage(counted, "month-weights")
    number = F.substring("out", 6, 2).cast("int")
    outer = inner.select(
        F.substring("out", 1, 4).alias("out"),
        F.col("out").alias("node"),
        (F.lit(1.0) / number).alias("weight"),
    ).distinct()
    product = intervals.compose_operators(outer, inner)
    return product.withColumn("weight", F.round("weight", 6))


@query("""
WITH starts AS (SELECT DISTINCT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS s
                FROM orders),
aliases AS (SELECT o_custkey AS entity_id, o_custkey || '@' || s AS label, s AS valid_start,
                   lead(s) OVER (PARTITION BY o_custkey ORDER BY s) AS valid_end FROM starts),
shipped AS (SELECT o_custkey AS entity_id, CAST(l_shipdate AS DATE) AS day
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.entity_id, label, count(*) AS events
FROM shipped s JOIN aliases a ON s.entity_id = a.entity_id AND s.day >= valid_start
     AND (valid_end IS NULL OR s.day < valid_end)
GROUP BY 1, 2
""")
def alias_as_of(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    starts = orders.select(
        F.col("o_custkey").alias("entity_id"), F.trunc("o_orderdate", "QUARTER").alias("valid_start")
    ).distinct()
    order = Window.partitionBy("entity_id").orderBy("valid_start")
    aliases = starts.withColumns(
        {
            "valid_end": F.lead("valid_start").over(order),
            "label": F.concat(
                F.col("entity_id").cast("string"), F.lit("@"), F.col("valid_start").cast("string")
            ),
        }
    )
    shipped = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("entity_id"), F.to_date("l_shipdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        intervals.alias_as_of(shipped, aliases)
        .groupBy("entity_id", "label")
        .agg(F.sum("n").alias("events"))
    )


@query("""
WITH nodes AS (SELECT l_returnflag, CAST(CAST(date_trunc('month', l_shipdate) AS DATE)
                 - DATE '1995-01-01' AS DOUBLE) AS x, count(*) AS y
               FROM lineitem WHERE month(l_shipdate) % 3 = 1 GROUP BY 1, 2),
points AS (SELECT DISTINCT l_returnflag, CAST(l_shipdate::DATE - DATE '1995-01-01' AS DOUBLE) AS at
           FROM lineitem),
cells AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM nodes
          WINDOW w AS (PARTITION BY l_returnflag ORDER BY x))
SELECT p.l_returnflag, p.at,
       round(CASE WHEN c.x1 IS NULL THEN c.y
                  ELSE c.y + (p.at - c.x) / (c.x1 - c.x) * (c.y1 - c.y) END, 6) AS value
FROM points p LEFT JOIN cells c ON p.l_returnflag = c.l_returnflag
  AND ((c.x1 IS NOT NULL AND p.at >= c.x AND p.at < c.x1) OR (c.x1 IS NULL AND p.at = c.x))
""")
def interpolate(spark, sf_dir):
    lines, origin = table(spark, sf_dir, "lineitem"), F.lit("1995-01-01").cast("date")
    nodes = (
        lines.where(F.month("l_shipdate") % 3 == 1)
        .groupBy(
            "l_returnflag",
            F.date_diff(F.trunc("l_shipdate", "MM"), origin).cast("double").alias("x"),
        )
        .agg(F.count(F.lit(1)).alias("value"))
    )
    points = lines.select(
        "l_returnflag", F.date_diff(F.to_date("l_shipdate"), origin).cast("double").alias("at")
    ).distinct()
    line = intervals.interpolate(points, nodes, ["l_returnflag"], "at", "x", "value", width=31.0)
    return line.withColumn("value", F.round("value", 6))


# --- sweep line and person tables ----------------------------------------------


def _spells(spark, sf_dir):
    quantity = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("table_id"),
        quantity.alias("lower_age"),
        (quantity + (F.col("l_suppkey") % 80) - 5).cast("int").alias("upper_age"),
        F.when(
            F.col("l_partkey") % 9 == 0, quantity + (F.col("l_partkey") % 70).cast("int")
        ).alias("death_age"),
    )


SPELLS = """
spells AS (SELECT l_returnflag AS table_id, CAST(l_quantity AS BIGINT) AS lo,
                  CAST(l_quantity AS BIGINT) + l_suppkey % 80 - 5 AS hi,
                  CASE WHEN l_partkey % 9 = 0 THEN CAST(l_quantity AS BIGINT) + l_partkey % 70 END
                    AS death_age
           FROM lineitem)
"""


@query(f"""
WITH {SPELLS}, lived AS (SELECT table_id, unnest(range(lo, least(hi, 110) + 1)) AS age
                         FROM spells WHERE lo <= least(hi, 110))
SELECT t.table_id, CAST(a.age AS INTEGER) AS age, count(l.age) AS exposed
FROM (SELECT DISTINCT table_id FROM spells) t CROSS JOIN (SELECT unnest(range(0, 111)) AS age) a
LEFT JOIN lived l ON l.table_id = t.table_id AND l.age = a.age GROUP BY 1, 2
""")
def sweep_exposure(spark, sf_dir):
    return exposure.exposed_by_age(_spells(spark, sf_dir), ["table_id"])


@query(f"""
WITH {SPELLS}
SELECT table_id, CAST(death_age AS INTEGER) AS age, count(*) AS deaths FROM spells
WHERE death_age BETWEEN greatest(lo, 0) AND least(hi, 110) GROUP BY 1, 2
""")
def deaths_by_age(spark, sf_dir):
    return exposure.deaths_by_age(_spells(spark, sf_dir), ["table_id"])


@query(f"""
WITH {PENSIONERS}, kept AS (SELECT * FROM pension_spells WHERE lo <= hi),
lived AS (SELECT table_id, unnest(range(lo, hi + 1)) AS age FROM kept),
grid AS (SELECT table_id, age FROM (VALUES ('RV-M-2020'), ('CB-H-2020'), ('B-M-2020'),
           ('MI-M-2020'), ('MI-H-2020')) AS t(table_id)
         CROSS JOIN (SELECT unnest(range(0, 111)) AS age)),
e AS (SELECT table_id, age, count(*) AS n FROM lived GROUP BY 1, 2),
d AS (SELECT table_id, death_age AS age, count(*) AS n FROM kept
      WHERE death_age BETWEEN lo AND hi GROUP BY 1, 2)
SELECT g.table_id, CAST(g.age AS INTEGER) AS age, coalesce(e.n, 0) AS exposed,
       coalesce(d.n, 0) AS deaths
FROM grid g LEFT JOIN e ON g.table_id = e.table_id AND g.age = e.age
LEFT JOIN d ON g.table_id = d.table_id AND g.age = d.age
""")
def pensioner_counts(spark, sf_dir):
    return finance.public_counts(raw_pensioners(spark, sf_dir))


THREE = """
cells AS (SELECT l_returnflag AS table_id, CAST(l_quantity AS INTEGER) AS age,
    count(*) AS pe, count(*) FILTER (WHERE l_linestatus = 'F') AS pd,
    count(*) FILTER (WHERE l_linenumber <= 5) AS we,
    count(*) FILTER (WHERE l_linenumber <= 5 AND l_linestatus = 'F') AS wd,
    count(*) FILTER (WHERE l_linenumber > 5) + CASE WHEN l_quantity = 7 THEN 1 ELSE 0 END AS de,
    count(*) FILTER (WHERE l_linenumber > 5 AND l_linestatus = 'F') AS dd
  FROM lineitem GROUP BY l_returnflag, l_quantity)
"""


@query(f"""
WITH {THREE}
SELECT table_id, age, pe AS public_exposed, pd AS public_deaths,
       round(pd::DOUBLE / nullif(pe, 0), 12) AS public_qx, we AS workbook_exposed,
       wd AS workbook_deaths, round(wd::DOUBLE / nullif(we, 0), 12) AS workbook_qx,
       de AS published_delta_exposed, dd AS published_delta_deaths,
       pe - we = de AS exposed_relation_ok, pd - wd = dd AS deaths_relation_ok,
       pe - we = de AND pd - wd = dd AS qx_reconciled
FROM cells
""")
def three_way_recon(spark, sf_dir):
    line, died = F.col("l_linenumber"), F.col("l_linestatus") == "F"
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("table_id"), F.col("l_quantity").cast("int").alias("age"))
        .agg(
            F.count(F.lit(1)).alias("pe"),
            F.count_if(died).alias("pd"),
            F.count_if(line <= 5).alias("we"),
            F.count_if((line <= 5) & died).alias("wd"),
            F.count_if(line > 5).alias("de"),
            F.count_if((line > 5) & died).alias("dd"),
        )
    )
    cells = stage(counted, "three-sides")
    key, shift = ["table_id", "age"], F.when(F.col("age") == 7, 1).otherwise(0)
    rows = reconcile.three_way(
        cells.select(*key, F.col("pe").alias("exposed"), F.col("pd").alias("deaths")),
        cells.select(*key, F.col("we").alias("exposed"), F.col("wd").alias("deaths")),
        cells.select(
            *key, (F.col("de") + shift).alias("delta_exposed"), F.col("dd").alias("delta_deaths")
        ),
    )
    return rows.withColumns(
        {c: F.round(c, 12) for c in ("public_qx", "workbook_qx")}
    )
