"""Written orders, row ranges, points in bins, and rule sets of the remaining side tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.functions import text
from factspan.operators import counts, exposure, history, intervals, reporting, rulesets, series
from factspan.operators.rules import check, report
from factspan.plans import batch, births
from factspan.queries.base import BIRTHS, MATERNAL_LABELS, ntz, query, raw_births, table
from factspan.queries.domains import RELEASE as RELEASE_OF
from factspan.queries.domains import SOURCE as SOURCE_OF
from factspan.queries.history import AS_OF, event_history
from factspan.queries.intake import _delimited
from factspan.queries.projection import _long_sql, domain_batches
from factspan.session import new_path, stage
from factspan.sources import files


def _written_positions(spark, ordered: DataFrame, columns) -> DataFrame:
    """Rows as they were written, with their line number over all files."""
    path = new_path(spark, "ordered")
    text_ = ordered.select(*[F.col(c).cast("string").alias(c) for c in columns])
    text_.write.option("header", True).option("sep", ";").csv(path)
    numbered = files.number_rows(files.scan_with_position(spark, path, columns, "ordered"))
    return numbered.select(*columns, F.col("archive_row_number").alias("position"))


# --- orders ---------------------------------------------------------------------


@query("""
WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS release_id, date_trunc('day', max(ts)) AS available_at FROM events GROUP BY 1)
SELECT release_id, row_number() OVER (ORDER BY available_at DESC, release_id) AS position FROM m
""")
def release_positions(spark, sf_dir):
    """Releases in the order of their clocks (turned round here), as written."""
    assets = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("release_id"), (-F.unix_date(F.to_date("ts"))).alias("available_at")
    )
    return _written_positions(spark, history.release_order(history.manifests(assets)), ["release_id"])


@query(f"""
WITH chosen AS (SELECT user_id || '/' || event_type AS fact_id, 'o' || event_id AS observation_id FROM events
  WHERE ts + to_microseconds(event_id) <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts + to_microseconds(event_id) DESC) = 1)
SELECT fact_id, observation_id, row_number() OVER (ORDER BY fact_id, observation_id) AS position FROM chosen
""")
def selection_positions(spark, sf_dir):
    chosen = history.latest_as_of(event_history(spark, sf_dir), ntz(AS_OF))
    return _written_positions(spark, history.selection_order(chosen), ["fact_id", "observation_id"])


@query(f"""
WITH long AS ({_long_sql()})
SELECT projected_domain, release_id, observation_id,
       row_number() OVER (ORDER BY projected_domain, release_id, observation_id) AS position FROM long
""")
def report_positions(spark, sf_dir):
    long = reporting.project_long(domain_batches(spark, sf_dir))
    return _written_positions(spark, reporting.report_order(long), ["projected_domain", "release_id", "observation_id"])


# --- row ranges -----------------------------------------------------------------


@query("""
WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT unnest(range((SELECT ceil(n / 1000.0)::BIGINT FROM n))) AS shard)
SELECT shard, shard * 1000 + 1 AS first_row, least((shard + 1) * 1000, n) AS last_row FROM s, n
""")
def shard_ranges(spark, sf_dir):
    """First and last row of every thousand rows of a written archive."""
    path = _delimited(spark, raw_births(spark, sf_dir), files.BIRTH_COLUMNS_25, "birth-ranges")
    numbered = files.number_rows(files.scan_with_position(spark, path, files.BIRTH_COLUMNS_25, "births"))
    cut = numbered.withColumn("shard", F.floor((F.col("archive_row_number") - 1) / 1000))
    return series.shard_bounds(cut, "archive_id", "shard").select("shard", "first_row", "last_row")


@query(f"""
WITH {BIRTHS}
SELECT period_start, sex, region, nationality, count(*)::DOUBLE AS value, (SELECT ceil(count(*) / 1000.0)::BIGINT FROM births) AS shards
FROM births GROUP BY period_start, sex, region, nationality
""")
def shards_of_rows(spark, sf_dir):
    """Births normalised per thousand rows, each shard under its own rule, and merged into the whole."""
    path = _delimited(spark, raw_births(spark, sf_dir), files.BIRTH_COLUMNS_25, "birth-shards")
    numbered = files.number_rows(files.scan_with_position(spark, path, files.BIRTH_COLUMNS_25, "births"))
    shards = stage(births.shard_payloads(numbered, RELEASE_OF, "dpa-2019", 1000), "row-shards")
    number = shards.agg(F.count_distinct("aggregation_rule").alias("shards"))
    merged = births.aggregate_shards(shards)
    return merged.groupBy("period_start", "sex", "region", "nationality").agg(F.sum("value").alias("value")).crossJoin(number)


@query(f"""
WITH {BIRTHS}
SELECT period_start, sex, age_lower, age_upper, count(*)::DOUBLE AS value, count(DISTINCT region)::BIGINT AS regions
FROM births GROUP BY period_start, sex, age_lower, age_upper
""")
def shards_with_nan(spark, sf_dir):
    """Shards of which every second holds NaN where a number is missing merge as if all held nulls."""
    path = _delimited(spark, raw_births(spark, sf_dir), files.BIRTH_COLUMNS_25, "birth-nan")
    numbered = files.number_rows(files.scan_with_position(spark, path, files.BIRTH_COLUMNS_25, "births"))
    shards = births.shard_payloads(numbered, RELEASE_OF, "dpa-2019", 1000)
    odd = F.pmod(F.xxhash64("aggregation_rule"), F.lit(2)) == 1
    holes = {c: F.when(odd & F.col(c).isNull(), float("nan")).otherwise(F.col(c)) for c in ("age_lower", "age_upper", "age_quantity", "birth_order")}
    merged = births.aggregate_shards(stage(shards.withColumns(holes), "nan-shards"))
    cells = merged.groupBy("period_start", "sex", "age_lower", "age_upper", "region").agg(F.sum("value").alias("value"))
    return cells.groupBy("period_start", "sex", "age_lower", "age_upper").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("regions"))


# --- points and labels ------------------------------------------------------------

EDGES = [(0.0, 10.0), (10.0, 25.0), (25.0, 60.0), (60.0, None)]


@query("""
WITH b AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE), (1, 10.0, 25.0), (2, 25.0, 60.0), (3, 60.0, NULL)) v(bin, lo, hi))
SELECT event_type, bin, lo AS age_lower, hi AS age_upper, count(*) AS n
FROM events JOIN b ON value >= lo AND (hi IS NULL OR value < hi) GROUP BY ALL
""")
def points_in_bins(spark, sf_dir):
    """Event values joined with the bin that holds them, bounds attached by the bin's number."""
    bins = spark.range(len(EDGES)).select(F.col("id").cast("int").alias("bin"))
    bounded = intervals.bin_table(bins, EDGES).select("bin", "age_lower", F.coalesce("age_upper", F.lit(1e6)).alias("high"))
    events = table(spark, sf_dir, "events").where("value >= 0").select("event_type", "value")
    joined = intervals.point_join(events, bounded, "value", ("age_lower", "high"), 1e5)
    counted = joined.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))
    return intervals.bin_table(counted, EDGES).select("event_type", "bin", "age_lower", "age_upper", "n")


@query("""
SELECT (o_orderkey % 10) BETWEEN 1 AND 7 AS fertile, CASE WHEN o_orderkey % 10 IN (0, 9) THEN NULL ELSE (10 + 5 * (o_orderkey % 10))::DOUBLE END
  AS age_lower, count(*) AS value
FROM orders GROUP BY ALL
""")
def labels_parsed_once(spark, sf_dir):
    """Births counted by their raw age label, which is then parsed once per label."""
    label = F.col("GRUPO_ETARIO_MADRE")
    lower = F.when(label != MATERNAL_LABELS[0], text.maternal_age(label)["age_lower"])
    # fixed value: one label is published in capitals
    fertile = text.fertility_label(F.lower(label))
    return counts.count_then_parse(raw_births(spark, sf_dir), ["GRUPO_ETARIO_MADRE"], {"fertile": fertile, "age_lower": lower})


# --- rule sets ----------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_suppkey AS s, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT s, y, CASE WHEN s % 7 = 0 THEN 'person' ELSE '1 / year' END AS unit FROM c UNION ALL SELECT s, y, '1 / year' FROM c WHERE s % 10 = 3)
SELECT 'coordinate_unique' AS rule_id, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY s, y HAVING count(*) > 1)) AS failed
UNION ALL SELECT 'semantics_declared', (SELECT count(*) FROM t WHERE unit <> '1 / year')
UNION ALL SELECT 'one_semantics', (SELECT CASE WHEN count(DISTINCT unit) > 1 THEN 1 ELSE 0 END FROM t)
""")
def surface_rules(spark, sf_dir):
    """One value per coordinate and one declared meaning: a surface with repeated cells and a second unit."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("value"))
    surface = stage(cells, "surface").withColumns({
        "semantic_kind": F.lit("rate"), "unit": F.when(F.col("l_suppkey") % 7 == 0, "person").otherwise("1 / year"),
        "population_basis": F.lit("person_time"),
    })
    again = surface.where("l_suppkey % 10 = 3").withColumn("unit", F.lit("1 / year"))
    found = exposure.surface_report(surface.unionAll(again), ["l_suppkey", "year"], "rate", "1 / year", "person_time")
    return found.select("rule_id", F.least("failed", F.when(F.col("rule_id") == "one_semantics", 1).otherwise(F.col("failed"))).alias("failed"))


@query("""
WITH a AS (SELECT 'k' || o_custkey AS source_key, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT source_key, 1::BIGINT AS in_left, 0::BIGINT AS in_right FROM a WHERE k % 5 = 0
UNION ALL SELECT source_key, 0, 1 FROM a WHERE k % 5 = 0
UNION ALL SELECT source_key, 1, 0 FROM a WHERE k % 5 <> 0 AND k % 7 = 0
""")
def reviewed_assets(spark, sf_dir):
    """Manifest assets that the reviewed registry lacks or holds with another digest."""
    rows = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("source_key")).agg(
        F.max("o_orderkey").alias("k")
    )
    rows = stage(rows, "assets").withColumns({
        "sha256": F.sha2(F.col("k").cast("string"), 256), "released_at": F.lit("2024-01-01").cast("date"),
        "release_missingness_reason": F.lit(None).cast("string"),
    })
    other = rows.withColumn("sha256", F.when(F.col("k") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    reviewed = other.where("k % 5 = 0 or k % 7 <> 0")
    return files.same_assets(rows, reviewed).select("source_key", "in_left", "in_right")


@query("""
WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT 'scalar_or_interval' AS rule_id, count(*) FILTER (k % 7 = 0) AS failed FROM t
UNION ALL SELECT 'ordinal_nonnegative', 0 FROM (SELECT 1)
UNION ALL SELECT 'label_nonblank', count(*) FILTER (k % 11 = 0) FROM t
UNION ALL SELECT 'set_matches_vocabulary', count(*) FILTER (k % 13 = 0) FROM t
UNION ALL SELECT 'term_in_vocabulary', count(*) FILTER (k % 7 = 0 OR k % 17 = 0) FROM t
UNION ALL SELECT 'ordinals_contiguous', (SELECT count(*) FROM (SELECT CASE WHEN k % 13 = 0 THEN 'x' ELSE 's' || c END AS s,
    count(*) AS n, count(DISTINCT k % 3) AS d, min(k % 3) AS lo, max(k % 3) AS hi FROM t GROUP BY 1) WHERE lo <> 0 OR hi <> n - 1 OR d <> n)
UNION ALL SELECT 'band_cardinality', 0 FROM (SELECT 1)
UNION ALL SELECT 'entity_type_known', count(*) FILTER (k % 19 = 0) FROM t
UNION ALL SELECT 'entity_id_matches_type', count(*) FILTER (k % 23 = 0) FROM t
""")
def term_and_entity_rules(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("double")
    terms = orders.select(
        F.when(k % 13 == 0, "x").otherwise(F.concat(F.lit("scomp:v1:s"), c.cast("string"))).alias("product_term_set_id"),
        (k % 3).alias("term_ordinal"), F.when(k % 11 == 0, " ").otherwise("label").alias("source_label"),
        F.lit("guarantee_years").alias("term_code"), F.lit("contract_term").alias("term_role"), F.lit("year").alias("unit"),
        F.when(k % 17 == 0, 1.5).otherwise(10.0).alias("numeric_value"), F.when(k % 7 == 0, 1.0).otherwise(none).alias("lower_bound"),
        none.alias("upper_bound"),
    )
    entities = orders.select(
        F.when(k % 19 == 0, "nobody").otherwise("market_total").alias("entity_type"), F.when(k % 23 == 0, "x").otherwise("market:total").alias("entity_id")
    ).withColumn("entity_id", F.when((F.col("entity_type") == "nobody") & (F.col("entity_id") != "x"), "cl-rut:11111111-1").otherwise(F.col("entity_id")))
    return report(rulesets.term_report(stage(terms, "terms")), check(entities, rulesets.entity_rules())).select("rule_id", "failed")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS release_id, count(*) AS rows FROM events GROUP BY 1
""")
def created_history(spark, sf_dir):
    """A history created from one batch per release, checked for conflicts across all of them."""
    rows = stage(event_history(spark, sf_dir), "one-history")
    early = F.col("release_id") < "2024-01-11"
    whole = history.create_history([rows.where(early), rows.where(~early)], ["domain"])
    return whole.groupBy("release_id").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""
WITH {BIRTHS}, cells AS (SELECT period_start, date_basis, age_lower, age_upper, age_open, sex, region, nationality FROM births GROUP BY ALL)
SELECT 'demographic' AS domain, count(*) AS rows FROM cells
""")
def recorded_validation(spark, sf_dir):
    """A batch validated once and recorded for its readers."""
    facts = births.normalise(raw_births(spark, sf_dir), RELEASE_OF, date(1990, 1, 1), date(2030, 12, 31), "dpa-2019", SOURCE_OF)
    return batch.validation_record(facts, "demographic").select("domain", "rows")
