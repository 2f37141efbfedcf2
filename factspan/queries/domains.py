"""Domain tables, reshapes and the long reporting table."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from factspan.operators import reconcile, reporting
from factspan.plans import births, controls, deaths, finance, stocks
from factspan.plans.batch import Release, complete, with_ids
from factspan.queries.base import BIRTHS, RAW_DEATHS, query, raw_births, raw_deaths, table
from factspan.session import stage

RELEASE = Release(
    source_key="example_release",
    vintage="v2024",
    available_at=datetime(2024, 2, 1),
    assets=(("example_release", "a" * 64),),
    released_at=date(2024, 1, 31),
)
SOURCE = {"publisher": "example"}


# --- census and population -----------------------------------------------------


@query("""
WITH sizes AS (SELECT p_size - p_size % 5 AS low, count(*) FILTER (WHERE p_partkey % 2 = 0) AS m,
                      count(*) FILTER (WHERE p_partkey % 2 = 1) AS f FROM part GROUP BY 1),
bins AS (SELECT CASE WHEN low = 50 THEN 85.0 ELSE CAST(low AS DOUBLE) END AS age_lower,
                CASE WHEN low < 50 THEN CAST(low + 5 AS DOUBLE) END AS age_upper,
                low = 50 AS age_open, m, f FROM sizes)
SELECT age_lower, age_upper, age_open, 'male' AS sex, CAST(m AS DOUBLE) AS value FROM bins
UNION ALL SELECT age_lower, age_upper, age_open, 'female', f FROM bins
UNION ALL SELECT age_lower, age_upper, age_open, 'all', m + f FROM bins
""")
def unpivot_sex(spark, sf_dir):
    low = (F.col("p_size") - F.col("p_size") % 5).alias("low")
    male = F.col("p_partkey") % 2 == 0
    counted = table(spark, sf_dir, "part").groupBy(low).agg(
        F.count_if(male).alias("population_male"),
        F.count_if(~male).alias("population_female"),
        F.count(F.lit(1)).alias("population_total"),
    )
    closed = F.concat(F.col("low").cast("string"), F.lit(" a "), (F.col("low") + 4).cast("string"))
    wide = counted.select(
        F.when(F.col("low") == 50, "85 o Más").otherwise(closed).alias("age_group"),
        "population_male",
        "population_female",
        "population_total",
    )
    return stocks.census_facts(wide)


@query("""
WITH cells AS (SELECT year(l_shipdate) AS y, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f,
                      count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(y AS DOUBLE) AS year, CAST(n AS DOUBLE) AS value,
  CASE WHEN q = 50 THEN 85.0 ELSE CAST(q AS DOUBLE) END AS age_lower,
  CASE WHEN q < 50 THEN CAST(q + 1 AS DOUBLE) END AS age_upper, q = 50 AS age_open,
  CASE f WHEN 'A' THEN 'male' WHEN 'N' THEN 'female' ELSE 'all' END AS sex, 'CL' AS region,
  make_date(y, 6, 30) AS period_start, make_date(y, 7, 1) AS period_end,
  CASE WHEN y <= 1998 THEN 'observed_fact' ELSE 'external_projection' END AS observation_role,
  CASE WHEN q < 50 THEN CAST(q AS DOUBLE) END AS age_quantity
FROM cells
""")
def population_facts(spark, sf_dir):
    quantity, flag = F.col("l_quantity").cast("int"), F.col("l_returnflag")
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.year("l_shipdate").alias("year"), quantity.alias("q"), flag.alias("f"))
        .agg(F.count(F.lit(1)).alias("population"))
    )
    number = F.col("q").cast("string")
    published = counted.select(
        "year",
        F.when(F.col("q") == 50, "85 o más")
        .when(F.col("q") % 2 == 0, F.concat(number, F.lit(" AÑOS")))
        .otherwise(number)
        .alias("age"),
        F.when(F.col("f") == "A", "Hombres")
        .when(F.col("f") == "N", "MUJER")
        .otherwise("Ambos  sexos")
        .alias("sex"),
        "population",
    )
    return stocks.population_facts(published, 1998)


@query(f"""
WITH {BIRTHS}, monthly AS (SELECT y, m, sex, region, count(*) AS n FROM births GROUP BY ALL)
SELECT CAST(n AS DOUBLE) AS value, sex, region,
  CASE WHEN region = 'unknown' THEN NULL ELSE 'dpa-2019' END AS geography_vintage,
  make_date(y, m, 1) AS period_start, CAST(make_date(y, m, 1) + INTERVAL 1 MONTH AS DATE)
    AS period_end, 'birth_occurrence_month' AS date_basis
FROM monthly
""")
def birth_controls(spark, sf_dir):
    cells = births.canonical(raw_births(spark, sf_dir, "o_orderkey", "o_orderdate").select(
        "*", F.lit(1).alias("value")
    ).withColumn("MES_NAC", F.month("o_orderdate").cast("string")))
    published = (
        cells.groupBy("period_start", "sex", "region")
        .agg(F.sum("value").alias("births"))
        .select(
            F.year("period_start").alias("year"),
            F.month("period_start").alias("month"),
            "sex",
            "region",
            F.when(F.col("region") != "unknown", "dpa-2019").alias("geography_vintage"),
            "births",
        )
    )
    return controls.control_facts(published)


# --- market series and mortality tables ----------------------------------------

SERIES = """
series AS (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS d,
                  CASE WHEN count(*) % 11 > 0 THEN CAST(count(*) AS DOUBLE) END AS v
           FROM orders GROUP BY 1, 2)
"""


def _market_facts(spark, sf_dir):
    counted = (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority", F.trunc("o_orderdate", "MM").alias("observed_on"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    observations = counted.select(
        F.col("o_orderpriority").alias("series_id"),
        "observed_on",
        F.when(F.col("n") % 11 > 0, F.col("n").cast("double")).alias("published"),
        F.when(F.col("n") % 11 > 0, "OK").otherwise("ND").alias("status_code"),
    )
    quote = (
        F.when(F.col("series_id") == "1-URGENT", "benchmark_yield")
        .when(F.col("series_id") == "2-HIGH", "swap_fixed_rate")
        .when(F.col("series_id") == "3-MEDIUM", "fixing")
        .when(F.col("series_id") == "4-NOT SPECIFIED", "published_index")
        .otherwise("published_change")
    )
    units = {
        "benchmark_yield": "1 / year",
        "swap_fixed_rate": "1 / year",
        "fixing": "CLP",
        "published_index": "dimensionless",
        "published_change": "percent",
    }
    unit = F.lit(None).cast("string")
    for name, canonical in units.items():
        unit = F.when(F.col("quote_type") == name, canonical).otherwise(unit)
    specs = (
        observations.select("series_id")
        .distinct()
        .withColumn("quote_type", quote)
        .select(
            "*",
            unit.alias("canonical_unit"),
            F.lit("MONTHLY").alias("frequency"),
            F.concat(F.lit("v_"), F.col("quote_type")).alias("variable"),
            F.lit(None).cast("double").alias("tenor_years"),
            F.lit("CLP").alias("currency"),
            F.lit("nominal").alias("indexation"),
            F.lit("series").alias("instrument_type"),
            F.lit(None).cast("string").alias("compounding"),
            F.lit(None).cast("string").alias("day_count"),
        )
    )
    return finance.market_facts(observations, specs)


@query(f"""
WITH {SERIES}, q AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'benchmark_yield'
    WHEN '2-HIGH' THEN 'swap_fixed_rate' WHEN '3-MEDIUM' THEN 'fixing'
    WHEN '4-NOT SPECIFIED' THEN 'published_index' ELSE 'published_change' END AS quote_type
  FROM series)
SELECT p AS source_series_id, quote_type, d AS period_start,
  CAST(d + INTERVAL 1 MONTH AS DATE) AS period_end,
  round(CASE WHEN quote_type IN ('benchmark_yield', 'swap_fixed_rate') THEN v / 100 ELSE v END, 9)
    AS value,
  CASE WHEN quote_type IN ('benchmark_yield', 'swap_fixed_rate') THEN 'rate'
       WHEN quote_type = 'fixing' THEN 'price' ELSE 'index' END AS semantic_kind,
  CASE WHEN quote_type IN ('benchmark_yield', 'swap_fixed_rate') THEN 'market_quote'
       ELSE 'covariate' END AS observation_role,
  CASE WHEN v IS NULL THEN 'bcch_source_observation_missing' ELSE 'not_applicable_observed' END
    AS missingness_reason
FROM q
""")
def market_facts(spark, sf_dir):
    return _market_facts(spark, sf_dir).select(
        "source_series_id",
        "quote_type",
        "period_start",
        "period_end",
        F.round("value", 9).alias("value"),
        "semantic_kind",
        "observation_role",
        "missingness_reason",
    )


WIDE = """
wide AS (SELECT l_returnflag AS table_id, CAST(l_quantity AS INTEGER) AS age,
    round(avg(l_tax), 6) AS qx, round(avg(l_discount) FILTER (WHERE l_linenumber = 1), 6) AS f1,
    round(avg(l_discount) FILTER (WHERE l_linenumber = 2), 6) AS f2,
    round(avg(l_discount) FILTER (WHERE l_linenumber = 3), 6) AS f3
  FROM lineitem GROUP BY 1, 2)
"""


WIDE_WHOLE = f"""
wide AS (SELECT l_returnflag AS table_id, CAST(l_quantity AS INTEGER) AS age, round(avg(l_tax), 6) AS qx,
    {', '.join(f'round(avg(l_discount) FILTER (WHERE l_linenumber = {n}), 6) AS f{n}' for n in range(1, 8))}
  FROM lineitem GROUP BY 1, 2)
"""


def _wide(spark, sf_dir, lines=(1, 2, 3)):
    line = F.col("l_linenumber")

    def factor(n):
        return F.round(F.avg(F.when(line == n, F.col("l_discount"))), 6)

    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("table_id"), F.col("l_quantity").cast("int").alias("age"))
        .agg(
            F.round(F.avg("l_tax"), 6).alias("qx"),
            *[factor(n).alias(str(2020 + n)) for n in lines],
        )
        .withColumn("sex", F.lit("male"))
    )


@query(f"""
WITH {WIDE_WHOLE}
SELECT table_id, age, 'male' AS sex, 'regulatory_mortality_probability' AS variable, qx AS value,
       CAST(NULL AS INTEGER) AS improvement_year FROM wide
{' '.join(f"UNION ALL SELECT table_id, age, 'male', 'regulatory_mortality_improvement_factor', f{n}, {2020 + n} FROM wide" for n in range(1, 8))}
""")
def improvement_long(spark, sf_dir):
    """Factors from every line number."""
    lines = range(1, 8)
    return finance.improvement_long(_wide(spark, sf_dir, lines), [2020 + n for n in lines])


@query("""
WITH cells AS (SELECT l_returnflag AS block, CAST(l_quantity AS INTEGER) AS age,
                      count(*) % 7 AS value FROM lineitem GROUP BY 1, 2),
a AS (SELECT c.block || '-' || o.block AS pair, c.age, c.value
      FROM cells c JOIN (SELECT DISTINCT block FROM cells) o ON c.block < o.block),
b AS (SELECT o.block || '-' || c.block AS pair, c.age, c.value
      FROM cells c JOIN (SELECT DISTINCT block FROM cells) o ON o.block < c.block)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.age, b.age) AS age, coalesce(a.value, b.value) AS value,
       CAST(CASE WHEN a.age IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_left,
       CAST(CASE WHEN b.age IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_right
FROM a FULL JOIN b ON a.pair = b.pair AND a.age = b.age AND a.value = b.value
WHERE a.age IS NULL OR b.age IS NULL
""")
def duplicate_block(spark, sf_dir):
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("block"), F.col("l_quantity").cast("int").alias("age"))
        .agg((F.count(F.lit(1)) % 7).alias("value"))
    )
    cells = stage(cells, "blocks")
    others = cells.select(F.col("block").alias("other")).distinct()
    pair = lambda a, b: F.concat(a, F.lit("-"), b).alias("pair")
    left = cells.join(others, F.col("block") < F.col("other")).select(pair("block", "other"), "age", "value")
    right = cells.join(others, F.col("other") < F.col("block")).select(pair("other", "block"), "age", "value")
    return reconcile.same_rows(
        left, right, ["pair", "age", "value"]
    )


# --- reporting -----------------------------------------------------------------


def _batches(spark, sf_dir):
    grain = deaths.Grain("year", "completed_year", "region", "all", True)
    raw = raw_deaths(spark, sf_dir)
    lookup = stage(deaths.region_lookup(raw), "region-lookup")
    facts = deaths.count_facts(raw, grain, date(2001, 12, 31), lookup=lookup)
    demographic = deaths.payload(facts, grain, RELEASE)
    market = complete(
        _market_facts(spark, sf_dir),
        "market_quote",
        {
            "domain": "market_quote",
            "population_basis": "not_applicable",
            "parity_scope": "not_applicable",
            **RELEASE.stamp(),
            "aggregation_rule": "one observation",
            "date_basis": "market_observation",
        },
    )
    return {
        "demographic": with_ids(demographic, "demographic", RELEASE, SOURCE),
        "market_quote": with_ids(market, "market_quote", RELEASE, SOURCE),
    }


LONG = f"""
{RAW_DEATHS}, {SERIES}, d AS (
  SELECT make_date(event_year, 1, 1) AS period_start, CASE WHEN event_date IS NULL THEN 1 ELSE 0 END
    AS basis, CASE WHEN in_years THEN CAST(CAST(edad_cant AS INTEGER) AS DOUBLE)
                   WHEN below_one THEN 0.0 END AS lo, sex, region, count(*) AS n
  FROM deaths GROUP BY ALL),
long AS (
  SELECT 'demographic' AS projected_domain, period_start, CAST(n AS DOUBLE) AS value,
    '{{"age_lower":' || coalesce(CAST(lo AS VARCHAR), 'null') || ',"age_open":false,"age_upper":'
    || coalesce(CAST(lo + 1 AS VARCHAR), 'null') || ',"cause":"all_causes","commune":null,'
    || '"region":"' || region || '","sex":"' || sex || '"}}' AS display_dimensions
  FROM d
  UNION ALL
  SELECT 'market_quote', d, CASE WHEN p IN ('1-URGENT', '2-HIGH') THEN v / 100 ELSE v END,
    '{{"currency":"CLP","indexation":"nominal","instrument_type":"series","quote_type":"'
    || CASE p WHEN '1-URGENT' THEN 'benchmark_yield' WHEN '2-HIGH' THEN 'swap_fixed_rate'
         WHEN '3-MEDIUM' THEN 'fixing' WHEN '4-NOT SPECIFIED' THEN 'published_index'
         ELSE 'published_change' END
    || '","source_series_id":"' || p || '","tenor_years":null}}'
  FROM series)
"""


@query(f"""
WITH {LONG}
SELECT projected_domain, period_start, round(value, 6) AS value, display_dimensions FROM long
""")
def strict_union_long(spark, sf_dir):
    long = reporting.project_long(_batches(spark, sf_dir))
    return long.select(
        "projected_domain", "period_start", F.round("value", 6).alias("value"), "display_dimensions"
    )


@query(f"""
WITH {LONG}
SELECT projected_domain, CAST(1 AS BIGINT) AS releases, count(*) AS rows,
  CASE projected_domain WHEN 'demographic' THEN 7 ELSE 6 END AS shown,
  CASE projected_domain WHEN 'demographic' THEN 19 ELSE 3 END AS omitted
FROM long GROUP BY 1
""")
def projection_metadata(spark, sf_dir):
    metadata = reporting.projection_metadata(reporting.project_long(_batches(spark, sf_dir)))
    return metadata.select(
        "projected_domain",
        "releases",
        "rows",
        F.size("selected_dimensions").alias("shown"),
        F.size("omitted_dimensions").alias("omitted"),
    )


@query(f"""
WITH {SERIES} SELECT CAST(2 AS BIGINT) AS rows, count(*) AS observations FROM series
""")
def repeated_observations(spark, sf_dir):
    """A market batch that was projected twice."""
    batches = _batches(spark, sf_dir)
    again = reporting.project_domain(batches["market_quote"], "market_quote")
    long = reporting.project_long(batches).unionAll(again)
    return reporting.repeated_observations(long).groupBy("rows").agg(
        F.count(F.lit(1)).alias("observations")
    )


@query(f"""
WITH {BIRTHS}, shards AS (SELECT {{dims}}, k % 7 AS shard, count(*) AS n FROM births GROUP BY ALL)
SELECT {{dims}}, CAST(sum(n) AS DOUBLE) AS value FROM shards GROUP BY {{dims}}
""".replace("{dims}", "period_start, period_end, age_lower, age_upper, age_open, sex, region, "
            "nationality, date_basis"))
def merge_shards(spark, sf_dir):
    raw = raw_births(spark, sf_dir, "o_orderkey")
    cells = births.canonical(
        raw.groupBy(*births.RAW_KEY, (F.col("o_orderkey") % 7).alias("shard"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    shards = births.payload(cells, RELEASE, "dpa-2019", births.SHARD_TRANSFORMATION)
    return births.aggregate_shards(shards).select(
        "period_start",
        "period_end",
        "age_lower",
        "age_upper",
        "age_open",
        "sex",
        "region",
        "nationality",
        "date_basis",
        "value",
    )


# --- whole normalisers: rules, controls, counts, identifiers, validation ---------


@query(f"""
WITH {RAW_DEATHS}
SELECT make_date(event_year, 1, 1) AS period_start, sex, region,
       CASE WHEN event_year <= 1996 THEN 'ICD-9' ELSE 'ICD-10' END AS cause_code_system,
       CAST(count(*) AS DOUBLE) AS value, count(DISTINCT event_date IS NULL) AS facts
FROM deaths GROUP BY ALL
""")
def normalise_deaths(spark, sf_dir):
    raw = raw_deaths(spark, sf_dir)
    grain = deaths.Grain("year", "all", "region", "all", True)
    batch = deaths.normalise(raw, RELEASE, grain, date(1990, 1, 1), date(2030, 12, 31), SOURCE)
    return batch.groupBy("period_start", "sex", "region", "cause_code_system").agg(
        F.sum("value").alias("value"), F.count_distinct("fact_id").alias("facts")
    )


@query(f"""
WITH {BIRTHS}
SELECT sex, region, CAST(count(*) AS DOUBLE) AS value,
       count(DISTINCT (period_start, date_basis, age_lower, age_open, nationality)) AS facts
FROM births GROUP BY ALL
""")
def normalise_births(spark, sf_dir):
    raw = raw_births(spark, sf_dir)
    batch = births.normalise(
        raw, RELEASE, date(1990, 1, 1), date(2030, 12, 31), "dpa-2019", SOURCE
    )
    return batch.groupBy("sex", "region").agg(
        F.sum("value").alias("value"), F.count_distinct("fact_id").alias("facts")
    )


@query("""
SELECT 'female' AS sex, year(l_shipdate)::BIGINT AS year, CAST(count(*) AS DOUBLE) AS value,
       count(DISTINCT l_quantity) AS facts FROM lineitem GROUP BY 2
""")
def normalise_population(spark, sf_dir):
    quantity = F.col("l_quantity").cast("int")
    published = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.year("l_shipdate").alias("year"),
            F.when(quantity == 50, "85 o más").otherwise(quantity.cast("string")).alias("age"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("population"))
        .withColumn("sex", F.lit("Mujeres"))
    )
    batch = stocks.population(stage(published, "population"), RELEASE, 1998, SOURCE)
    return batch.groupBy("sex", F.year("period_start").cast("bigint").alias("year")).agg(
        F.sum("value").alias("value"), F.count_distinct("fact_id").alias("facts")
    )


@query("""
SELECT o_orderpriority AS source_series_id, count(DISTINCT date_trunc('month', o_orderdate))
  AS facts FROM orders GROUP BY 1
""")
def normalise_market(spark, sf_dir):
    """A series for every priority, of either kind in turn."""
    found = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect()
    names = sorted(r["o_orderpriority"] for r in found)
    return _priorities(spark, sf_dir, {n: (YIELD, SWAP)[i % 2] for i, n in enumerate(names)})


YIELD = ("benchmark_yield", "official_benchmark_yield", "bcp_benchmark_bond")
SWAP = ("swap_fixed_rate", "official_swap_fixed_rate", "spc_nominal_fixed_swap")


def _priorities(spark, sf_dir, names):
    """Facts of the priorities named, each with its kind of series."""
    counted = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority").isin(*names))
        .groupBy("o_orderpriority", F.trunc("o_orderdate", "MM").alias("observed_on"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    observations = stage(
        counted.select(
            F.col("o_orderpriority").alias("series_id"),
            "observed_on",
            F.col("n").cast("double").alias("published"),
            F.lit("OK").alias("status_code"),
        ),
        "observations",
    )
    specs = spark.createDataFrame(
        [(s, "MONTHLY", v, q, "percent", "1 / year", 5.0, "CLP", "nominal", i, None, None)
         for s, (q, v, i) in names.items()],
        "series_id string, frequency string, variable string, quote_type string, "
        "source_unit string, canonical_unit string, tenor_years double, currency string, "
        "indexation string, instrument_type string, compounding string, day_count string",
    )
    span = (date(1990, 1, 1), date(2030, 1, 1))
    batch = finance.market(observations, specs, RELEASE, span, SOURCE)
    return batch.groupBy("source_series_id").agg(F.count_distinct("fact_id").alias("facts"))
