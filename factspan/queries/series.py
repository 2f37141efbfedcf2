"""Ordered series, residual metrics, bins on a scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspan.functions import numbers
from factspan.operators import intervals, metrics, series
from factspan.queries.base import query, table
from factspan.session import stage

MONTHLY = """
monthly AS (SELECT l_returnflag, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t,
                   count(*) AS n FROM lineitem GROUP BY 1, 2)
"""


def _monthly(spark, sf_dir):
    """Lines per flag and month since January 1995: one row per (series, step)."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", month.cast("bigint").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


RESIDUALS = f"""
{MONTHLY}, means AS (SELECT l_returnflag, avg(n) AS mu FROM monthly GROUP BY 1),
fitted AS (SELECT m.*, mu + 1.0 AS mu FROM monthly m JOIN means USING (l_returnflag)),
residuals AS (SELECT l_returnflag, t, n, mu, (n - mu) / sqrt(mu) AS r FROM fitted)
"""


def _grid(spark, sf_dir):
    """The monthly grid written once, for queries that read it several times."""
    return stage(_monthly(spark, sf_dir), "monthly")


def _residuals(spark, sf_dir):
    monthly = _grid(spark, sf_dir)
    means = monthly.groupBy("l_returnflag").agg((F.avg("n") + 1.0).alias("mu"))
    return monthly.join(means, "l_returnflag").withColumn(
        "r", metrics.pearson(F.col("n"), F.col("mu"))
    )


@query(f"""
WITH {RESIDUALS}
SELECT l_returnflag, round(2 * sum(CASE WHEN n > 0 THEN n * ln(n / mu) ELSE 0 END - (n - mu)), 6)
       AS deviance FROM residuals GROUP BY 1
""")
def poisson_deviance(spark, sf_dir):
    result = metrics.poisson_deviance(_residuals(spark, sf_dir), ["l_returnflag"], "n", "mu")
    return result.withColumn("deviance", F.round("deviance", 6))


@query(f"""
WITH {RESIDUALS}
SELECT l_returnflag, count(*) AS n,
  round(2 * sum(CASE WHEN n > 0 THEN n * ln(n / mu) ELSE 0 END - (n - mu)), 6) AS deviance,
  round(sum(r * r) / greatest(count(*) - 2, 1), 6) AS dispersion,
  round(avg(abs(n - mu)), 6) AS mean_absolute_error,
  round(sqrt(avg((n - mu) * (n - mu))), 6) AS root_mean_squared_error
FROM residuals GROUP BY 1
""")
def diagnostic_report(spark, sf_dir):
    result = metrics.diagnostic_report(
        _residuals(spark, sf_dir), ["l_returnflag"], "n", "mu", parameters=2
    )
    return result.select(
        "l_returnflag", "n", *[F.round(c, 6).alias(c) for c in result.columns[2:]]
    )


@query(f"""
WITH {RESIDUALS}, centred AS (SELECT l_returnflag, t, r - avg(r) OVER (PARTITION BY l_returnflag)
  AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM residuals),
lags AS (SELECT unnest(range(1, 5)) AS k),
c AS (SELECT a.l_returnflag, a.n, k, sum(a.r * b.r) AS c FROM centred a CROSS JOIN lags
      JOIN centred b ON a.l_returnflag = b.l_returnflag AND b.t = a.t - k GROUP BY 1, 2, 3),
v AS (SELECT l_returnflag, sum(r * r) AS v FROM centred GROUP BY 1)
SELECT l_returnflag, n, 4 AS lag_used,
       round(n * (n + 2) * sum(c * c / (n - k)) / (max(v) * max(v)), 6) AS statistic
FROM c JOIN v USING (l_returnflag) GROUP BY 1, 2
""")
def ljung_box_q(spark, sf_dir):
    result = metrics.ljung_box(_residuals(spark, sf_dir), ["l_returnflag"], "t", "r", lags=4)
    return result.withColumn("statistic", F.round("statistic", 6))


# with four degrees of freedom the chi-square tail is exp(-q / 2) * (1 + q / 2)
@query(f"""
WITH {RESIDUALS}, centred AS (SELECT l_returnflag, t, r - avg(r) OVER (PARTITION BY l_returnflag)
  AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM residuals),
c AS (SELECT a.l_returnflag, a.n, a.t - b.t AS k, sum(a.r * b.r) AS c FROM centred a
      JOIN centred b ON a.l_returnflag = b.l_returnflag AND a.t - b.t BETWEEN 1 AND 4
      GROUP BY 1, 2, 3),
v AS (SELECT l_returnflag, sum(r * r) AS v FROM centred GROUP BY 1),
q AS (SELECT l_returnflag, n * (n + 2) * sum(c * c / (n - k)) / (max(v) * max(v)) AS q
      FROM c JOIN v USING (l_returnflag) GROUP BY l_returnflag, n)
SELECT l_returnflag, round(q, 6) AS statistic, round(exp(-q / 2) * (1 + q / 2), 9) AS p_value FROM q
""")
def ljung_box_test(spark, sf_dir):
    tested = metrics.ljung_box_test(
        _residuals(spark, sf_dir), ["l_returnflag"], "t", "r", lags=4
    )
    return tested.select(
        "l_returnflag", F.round("statistic", 6).alias("statistic"),
        F.round("p_value", 9).alias("p_value"),
    )


@query(f"""
WITH {RESIDUALS}
SELECT l_returnflag, round(avg(abs(n - mu)), 6) AS mae, round(sqrt(avg((n - mu) * (n - mu))), 6)
       AS rmse FROM residuals GROUP BY 1
""")
def forecast_errors(spark, sf_dir):
    errors = _residuals(spark, sf_dir).withColumn("error", F.col("n") - F.col("mu"))
    result = metrics.forecast_errors(errors, ["l_returnflag"])
    return result.select("l_returnflag", F.round("mae", 6).alias("mae"),
                         F.round("rmse", 6).alias("rmse"))


@query(f"""
WITH {RESIDUALS}
SELECT l_returnflag, round(max(abs(mu - n)), 6) AS max_absolute,
       round(max(abs(mu - n) / greatest(n, 1.0)), 6) AS max_relative,
       round(sum(mu - n), 3) AS total_residual FROM residuals GROUP BY 1
""")
def bin_residuals(spark, sf_dir):
    result = metrics.bin_residuals(_residuals(spark, sf_dir), ["l_returnflag"], "mu", "n")
    return result.select(
        "l_returnflag",
        F.round("max_absolute", 6).alias("max_absolute"),
        F.round("max_relative", 6).alias("max_relative"),
        F.round("total_residual", 3).alias("total_residual"),
    )


@query(f"""
WITH {MONTHLY}
SELECT a.l_returnflag || '-' || b.l_returnflag AS pair, max(abs(a.n - b.n)) AS max_difference,
       greatest(max(a.n), max(b.n)) AS density_scale,
       round(max(abs(a.n - b.n))::DOUBLE / greatest(max(a.n), max(b.n)), 9) AS relative_difference
FROM monthly a JOIN monthly b ON a.t = b.t AND a.l_returnflag < b.l_returnflag GROUP BY 1
""")
def grid_comparison(spark, sf_dir):
    """Every pair of flags."""
    own = _grid(spark, sf_dir).select(F.col("l_returnflag").alias("flag"), "t", "n")
    others = own.select(F.col("flag").alias("other")).distinct()
    pair = lambda a, b: F.concat(a, F.lit("-"), b).alias("pair")
    left = own.join(others, F.col("flag") < F.col("other")).select(pair("flag", "other"), "t", "n")
    right = own.join(others, F.col("other") < F.col("flag")).select(pair("other", "flag"), "t", "n")
    result = metrics.grid_difference(left, right, ["pair", "t"], ["pair"], "n")
    return result.withColumn("relative_difference", F.round("relative_difference", 9))


@query("""
WITH points AS (SELECT event_type, epoch_us(ts) / 1000000.0::DOUBLE AS x, value AS y,
                       lag(epoch_us(ts) / 1000000.0::DOUBLE) OVER w AS px, lag(value) OVER w AS py
                FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_type, round(sum((x - px) * (y + py) * 0.5), 0) AS integral FROM points GROUP BY 1
""")
def trapezoid(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    points = table(spark, sf_dir, "events").select(
        "event_type", "ts", "event_id", seconds.alias("x"), F.col("value").alias("y")
    )
    result = series.trapezoid(points, ["event_type"], ["ts", "event_id"], "x", "y")
    return result.withColumn("integral", F.round("integral", 0))


@query(f"""
WITH {MONTHLY}
SELECT l_returnflag, t // 12 AS year_index, sum(n)::BIGINT AS n, count(*) AS steps
FROM monthly GROUP BY 1, 2
""")
def annual_remainder(spark, sf_dir):
    return series.yearly_sums(_monthly(spark, sf_dir), ["l_returnflag"], "t", "n")


@query(f"""
WITH {MONTHLY}
SELECT l_returnflag, t, n, sum(n) OVER (PARTITION BY l_returnflag ORDER BY t)::BIGINT AS total
FROM monthly
""")
def running_total(spark, sf_dir):
    return series.running_total(_monthly(spark, sf_dir), ["l_returnflag"], "t", "n", "total")


@query(f"""
WITH {MONTHLY}
SELECT l_returnflag, t, n,
       n - 2 * lag(n, 1) OVER w + lag(n, 2) OVER w AS second_difference
FROM monthly WINDOW w AS (PARTITION BY l_returnflag ORDER BY t)
""")
def second_diff(spark, sf_dir):
    return series.second_differences(_monthly(spark, sf_dir), ["l_returnflag"], "t", "n")


@query(f"""
WITH {MONTHLY}, d AS (SELECT *, n - 2 * lag(n, 1) OVER w + lag(n, 2) OVER w AS dd
  FROM monthly WINDOW w AS (PARTITION BY l_returnflag ORDER BY t))
SELECT l_returnflag, round(max(abs(dd)) / 8.0 / max(abs(n)), 9) AS curvature_indicator,
       round(sqrt(avg(dd * dd)), 9) AS innovation_scale
FROM d GROUP BY 1
""")
def curvature(spark, sf_dir):
    result = series.curvature(_monthly(spark, sf_dir), ["l_returnflag"], "t", "n")
    return result.select(
        "l_returnflag",
        F.round("curvature_indicator", 9).alias("curvature_indicator"),
        F.round("innovation_scale", 9).alias("innovation_scale"),
    )


@query(f"""
WITH {MONTHLY}
SELECT l_returnflag, t, n,
       round(n::DOUBLE / last_value(n) OVER (PARTITION BY l_returnflag ORDER BY t
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 9) AS relative
FROM monthly
""")
def index_to_last(spark, sf_dir):
    result = series.index_to_last(_grid(spark, sf_dir), ["l_returnflag"], "t", "n", "relative")
    return result.withColumn("relative", F.round("relative", 9))


@query(f"""
WITH {MONTHLY}, before AS (SELECT *, lag(n) OVER (PARTITION BY l_returnflag ORDER BY t)
  AS previous_value FROM monthly)
SELECT * FROM before WHERE n < previous_value
""")
def monotone_breaks(spark, sf_dir):
    return series.falls(_monthly(spark, sf_dir), ["l_returnflag"], "t", "n")


@query("""
WITH grid AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders),
following AS (SELECT *, lead(year) OVER (PARTITION BY o_custkey ORDER BY year) AS next_year
              FROM grid)
SELECT * FROM following WHERE next_year - year <> 1
""")
def missing_years(spark, sf_dir):
    grid = table(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").cast("bigint").alias("year")
    ).distinct()
    return series.missing_years(grid, ["o_custkey"])


@query("""
SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS ordinals,
       min(l_linenumber) AS first, max(l_linenumber) AS last
FROM lineitem GROUP BY 1
HAVING min(l_linenumber) <> 1 OR count(DISTINCT l_linenumber) <> count(*)
    OR max(l_linenumber) - min(l_linenumber) + 1 <> count(*)
""")
def contiguous(spark, sf_dir):
    return series.gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", start=1)


@query(f"""
WITH {MONTHLY}, d AS (SELECT l_returnflag, t, ln(n) AS l FROM monthly),
dd AS (SELECT *, l - 2 * lag(l, 1) OVER w + lag(l, 2) OVER w AS c, lag(l) OVER w AS l0
       FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY t)),
s AS (SELECT l_returnflag, sqrt(avg(c * c)) AS scale, max(t) AS t1 FROM dd GROUP BY 1),
e AS (SELECT dd.l_returnflag, l, l0, scale FROM dd JOIN s ON dd.l_returnflag = s.l_returnflag
      AND dd.t = s.t1),
h AS (SELECT unnest(range(1, 7)) AS h),
o AS (SELECT l_returnflag, h, l + (l - l0) * h AS level,
             1.959963984540054 * greatest(scale, 0.03) * sqrt(h * (1 + h / 2.0::DOUBLE)) AS spread
      FROM e CROSS JOIN h)
SELECT l_returnflag, CAST(h AS INTEGER) AS horizon, round(level, 6) AS log_mean,
       round(level - spread, 6) AS log_lower, round(level + spread, 6) AS log_upper
FROM o
""")
def trend_band(spark, sf_dir):
    logs = _grid(spark, sf_dir).withColumn("l", F.log("n"))
    scales = series.curvature(logs, ["l_returnflag"], "t", "l").select(
        "l_returnflag", "innovation_scale"
    )
    band = series.trend_band(
        logs.join(scales, "l_returnflag"), ["l_returnflag"], "t", "l", "innovation_scale", 6
    )
    return band.select(
        "l_returnflag",
        "horizon",
        F.round(F.log("mean"), 6).alias("log_mean"),
        F.round(F.log("lower"), 6).alias("log_lower"),
        F.round(F.log("upper"), 6).alias("log_upper"),
    )


@query(f"""
WITH {MONTHLY}, past AS (
SELECT l_returnflag, t AS origin, count(*) OVER w AS training_rows,
       round(avg(n) OVER w, 6) AS training_mean, n AS actual
FROM monthly WINDOW w AS (PARTITION BY l_returnflag ORDER BY t
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM past WHERE training_rows >= 8
""")
def rolling_origins(spark, sf_dir):
    result = series.rolling_origins(_monthly(spark, sf_dir), ["l_returnflag"], "t", "n")
    return result.withColumn("training_mean", F.round("training_mean", 6))


@query("""
WITH grid AS (SELECT l_suppkey, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, count(*) AS n
              FROM lineitem GROUP BY 1, 2),
past AS (SELECT l_suppkey, t, n, count(*) OVER w AS training_rows, regr_slope(n, t) OVER w AS slope,
                regr_intercept(n, t) OVER w AS level
         FROM grid WINDOW w AS (PARTITION BY l_suppkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_suppkey, t AS origin, training_rows, round(slope, 5) + 0.0 AS slope,
       round(level + slope * t, 5) + 0.0 AS forecast, round(n - level - slope * t, 5) + 0.0 AS error
FROM past WHERE training_rows >= 8
""")
def rolling_trend(spark, sf_dir):
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    grid = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", month.cast("bigint").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    result = series.rolling_trend(grid, ["l_suppkey"], "t", "n")
    return result.select(
        "l_suppkey", "origin", "training_rows", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "forecast", "error")]
    )


@query("""
SELECT event_type, min(ts::DATE) AS first_observation, max(ts::DATE) AS last_observation,
       max(ts::DATE + 1) AS period_end FROM events GROUP BY 1
""")
def series_bounds(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(
        "event_type", F.to_date("ts").alias("s"), F.date_add(F.to_date("ts"), 1).alias("e")
    )
    return series.series_bounds(days, ["event_type"], "s", "e")


# --- bins on a scale -----------------------------------------------------------


SCALE = """
scale AS (SELECT DISTINCT p_brand, CAST(p_size AS DOUBLE) AS age_lower,
    CASE WHEN p_size % 10 = 9 THEN NULL ELSE CAST(p_size + p_size % 3 AS DOUBLE) END AS age_upper,
    p_size % 10 = 9 AS age_open FROM part)
"""


def _scale(spark, sf_dir):
    size = F.col("p_size")
    is_open = size % 10 == 9
    return table(spark, sf_dir, "part").select(
        "p_brand",
        size.cast("double").alias("age_lower"),
        F.when(~is_open, (size + size % 3).cast("double")).alias("age_upper"),
        is_open.alias("age_open"),
    ).distinct()


@query(f"""
WITH {SCALE}, n AS (SELECT *, lead(age_lower) OVER (PARTITION BY p_brand ORDER BY age_lower)
  AS next_lower FROM scale)
SELECT * FROM n WHERE next_lower IS NOT NULL AND (age_upper IS NULL OR next_lower < age_upper)
""")
def overlap_bins(spark, sf_dir):
    return intervals.overlapping_bins(_scale(spark, sf_dir), ["p_brand"])


@query(f"""
WITH {SCALE}, n AS (SELECT *, lead(age_lower) OVER (PARTITION BY p_brand ORDER BY age_lower)
  AS next_lower FROM scale)
SELECT * FROM n WHERE age_open AND next_lower IS NOT NULL
""")
def open_last(spark, sf_dir):
    return intervals.open_not_last(_scale(spark, sf_dir), ["p_brand"])


@query("""
SELECT l_returnflag, bin, count(*) AS n,
       round(count(*) / (CASE WHEN bin = 10 THEN 55.0 ELSE 5.0 END)::DOUBLE, 9) AS density
FROM (SELECT l_returnflag, CAST(floor(l_quantity / 5) AS BIGINT) AS bin FROM lineitem)
GROUP BY 1, 2
""")
def count_density(spark, sf_dir):
    low = F.floor(F.col("l_quantity") / 5) * 5
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", low.alias("low")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upper = numbers.close_bin(F.when(F.col("low") < 50, F.col("low") + 5).cast("double"), 105)
    return counted.select(
        "l_returnflag",
        F.floor(F.col("low") / 5).alias("bin"),
        "n",
        F.round(numbers.density(F.col("n"), F.col("low"), upper), 9).alias("density"),
    )
