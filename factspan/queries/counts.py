"""Event counts, audits and controls over recast death and birth events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from factspan.operators import counts, reconcile
from factspan.operators.rules import check
from factspan.plans import births, deaths
from factspan.session import stage
from factspan.queries.base import BIRTHS, RAW_DEATHS, query, raw_births, raw_deaths, table

CUTOFF = date(2001, 8, 20)


def _facts(spark, sf_dir, grain: deaths.Grain, provisional: bool = False):
    raw, lookup = raw_deaths(spark, sf_dir), None
    if grain.geography != "national":
        lookup = stage(deaths.region_lookup(raw), "region-lookup")
    facts = deaths.count_facts(raw, grain, CUTOFF, provisional, lookup)
    return facts.withColumn("value", F.col("value").cast("bigint"))


def _cube_sql(start: str, end: str, dims: dict[str, str]) -> str:
    listed = ", ".join(f"{expression} AS {name}" for name, expression in dims.items())
    return f"""
WITH {RAW_DEATHS}
SELECT CASE WHEN event_date IS NULL THEN 'death_occurrence_year_when_date_missing'
            ELSE 'death_occurrence' END AS date_basis,
       CAST({start} AS DATE) AS period_start, CAST({end} AS DATE) AS period_end,
       CASE WHEN event_year <= 1996 THEN 'ICD-9' ELSE 'ICD-10' END AS cause_code_system,
       {listed}, count(*) AS value
FROM deaths GROUP BY ALL"""


YEAR_START = "make_date(event_year, 1, 1)"
YEAR_END = "make_date(event_year + 1, 1, 1)"
MONTH_START = f"coalesce(date_trunc('month', event_date), {YEAR_START})"
MONTH_END = f"coalesce(date_trunc('month', event_date) + INTERVAL 1 MONTH, {YEAR_END})"
DAY_START = f"coalesce(event_date, {YEAR_START})"
DAY_END = f"coalesce(event_date + INTERVAL 1 DAY, {YEAR_END})"
NO_AGE = {
    "age_lower": "NULL::DOUBLE",
    "age_upper": "NULL::DOUBLE",
    "age_measure_unit": "NULL::VARCHAR",
    "age_quantity": "NULL::DOUBLE",
}
COUNT = "CAST(edad_cant AS INTEGER)"
LOWER = f"CASE WHEN in_years THEN CAST({COUNT} AS DOUBLE) WHEN below_one THEN 0.0 END"
UPPER = f"CASE WHEN in_years THEN CAST({COUNT} + 1 AS DOUBLE) WHEN below_one THEN 1.0 END"
COMPLETED = {
    "age_lower": LOWER,
    "age_upper": UPPER,
    "age_measure_unit": "CASE WHEN in_years OR below_one THEN 'completed_years' "
    "ELSE 'source_age_unknown' END",
    "age_quantity": LOWER,
}
REPORTED = {
    "age_lower": LOWER,
    "age_upper": UPPER,
    "age_measure_unit": "CASE edad_tipo WHEN '1' THEN 'completed_years' "
    "WHEN '2' THEN 'completed_months' WHEN '3' THEN 'completed_days' "
    "WHEN '4' THEN 'completed_hours' ELSE 'source_age_unknown' END",
    "age_quantity": f"CASE WHEN in_years OR below_one THEN CAST({COUNT} AS DOUBLE) END",
}
EXTERNAL = (
    "CASE WHEN trim(diag2) = '' THEN 'not_applicable' "
    "WHEN upper(trim(diag2)) IN ('XXX', 'XXX1', 'XXX2', 'X') THEN 'unknown_not_coded' "
    "ELSE trim(diag2) END"
)
COMMUNE = "CASE WHEN comuna NOT IN ('', '99999') THEN lpad(comuna, 5, '0') END"
GROUP_CAUSE = "CASE WHEN trim(grupo) = '' THEN 'unknown' ELSE trim(grupo) END"
NO_TEXT = "NULL::VARCHAR"


@query(
    _cube_sql(
        MONTH_START,
        MONTH_END,
        {
            **NO_AGE,
            "sex": "sex",
            "region": "region",
            "commune": NO_TEXT,
            "cause": GROUP_CAUSE,
            "external_cause": NO_TEXT,
        },
    )
)
def count_cube_month_region(spark, sf_dir):
    return _facts(spark, sf_dir, deaths.Grain("month", "all", "region", "group", True, False))


@query(
    _cube_sql(
        DAY_START,
        DAY_END,
        {
            **REPORTED,
            "sex": "sex",
            "region": "region",
            "commune": COMMUNE,
            "cause": "chapter",
            "external_cause": EXTERNAL,
        },
    )
)
def count_cube_day_commune(spark, sf_dir):
    grain = deaths.Grain("day", "source_reported", "commune", "chapter", True, True)
    return _facts(spark, sf_dir, grain)


@query(
    _cube_sql(
        YEAR_START,
        YEAR_END,
        {
            **COMPLETED,
            "sex": "'all'",
            "region": "'CL'",
            "commune": NO_TEXT,
            "cause": "'all_causes'",
            "external_cause": NO_TEXT,
        },
    )
)
def count_cube_year_national(spark, sf_dir):
    return _facts(spark, sf_dir, deaths.Grain("year", "completed_year", "national", "all", False))


@query(
    _cube_sql(
        MONTH_START,
        f"least({MONTH_END}, DATE '2001-08-21')",
        {
            **NO_AGE,
            "sex": "'all'",
            "region": "'CL'",
            "commune": NO_TEXT,
            "cause": "CASE WHEN diag1 = '' THEN 'unknown' ELSE diag1 END",
            "external_cause": NO_TEXT,
        },
    )
)
def period_clip(spark, sf_dir):
    grain = deaths.Grain("month", "all", "national", "underlying_code", False)
    return _facts(spark, sf_dir, grain, provisional=True)


@query(f"""
WITH {RAW_DEATHS}, cells AS (
SELECT event_date IS NULL AS undated,
       CASE WHEN in_years OR below_one THEN 'completed_years' ELSE 'source_age_unknown' END AS unit,
       CASE WHEN in_years THEN CAST({COUNT} AS DOUBLE) WHEN below_one THEN 0.0 END AS quantity,
       region, {COMMUNE} AS commune, {GROUP_CAUSE} AS cause, {EXTERNAL} AS external
FROM deaths)
SELECT '{{' || concat_ws(',',
    CASE WHEN quantity IS NULL AND unit <> 'source_age_unknown'
         THEN '"decedent_age_quantity":"missing_in_source"' END,
    CASE WHEN unit = 'source_age_unknown' THEN '"decedent_age":"source_age_unknown"' END,
    CASE WHEN external = 'unknown_not_coded'
         THEN '"external_cause":"published_placeholder_not_coded"' END,
    CASE WHEN undated THEN '"occurrence_date":"missing_in_source_year_only"' END,
    '"registration_window":"not_available_in_current_deis_file"',
    CASE WHEN commune IS NULL THEN '"residence_commune":"blank_or_99999_source_commune"' END,
    CASE WHEN region = 'unknown'
         THEN '"residence_region":"blank_or_99999_source_commune_and_region"' END,
    CASE WHEN cause = 'unknown'
         THEN '"underlying_cause":"missing_at_requested_source_hierarchy"' END) || '}}'
    AS missingness_reason, count(*) AS value
FROM cells GROUP BY 1
""")
def missingness_json(spark, sf_dir):
    grain = deaths.Grain("year", "completed_year", "commune", "group", True, True)
    facts = _facts(spark, sf_dir, grain)
    return (
        facts.withColumn("missingness_reason", deaths.missingness(grain))
        .groupBy("missingness_reason")
        .agg(F.sum("value").alias("value"))
    )


@query(f"""
WITH {RAW_DEATHS}
SELECT 'year' AS audit, anio AS key, count(*) AS n FROM deaths GROUP BY 2
UNION ALL SELECT 'sex', sexo, count(*) FROM deaths GROUP BY 2
UNION ALL SELECT 'age_type', edad_tipo, count(*) FROM deaths GROUP BY 2
""")
def audit_one_pass(spark, sf_dir):
    return deaths.audit(raw_deaths(spark, sf_dir))


@query(f"""
WITH {RAW_DEATHS}
SELECT count(*) AS raw_rows,
  count(*) FILTER (WHERE edad_tipo = '1' AND edad_cant = '99') AS age_99_year_deaths,
  count(*) FILTER (WHERE diag2 <> '') AS nonblank_external_causes,
  count(*) FILTER (WHERE trim(diag2) <> '') AS meaningful_external_causes,
  count(*) FILTER (WHERE regexp_full_match(comuna, '[0-9]+') AND length(comuna) < 5)
    AS short_numeric_communes,
  count(*) FILTER (WHERE comuna = '') AS blank_communes,
  count(*) FILTER (WHERE comuna = '99999') AS missing_code_communes,
  count(*) FILTER (WHERE fecha = '') AS missing_occurrence_dates,
  count(*) FILTER (WHERE edad_tipo = '') AS missing_age_types,
  count(*) FILTER (WHERE diag1 <> '' AND (
      (event_year <= 1996 AND NOT regexp_full_match(upper(diag1), '[0-9]{{3,5}}|[EV][0-9]{{2,4}}'))
      OR (event_year >= 1997 AND NOT regexp_full_match(upper(diag1), '[A-Z][0-9]{{2}}[0-9X]'))))
    AS anomalous_underlying_codes,
  count(*) FILTER (WHERE trim(diag2) <> '' AND upper(trim(diag2)) NOT IN ('XXX','XXX1','XXX2','X')
      AND ((event_year <= 1996
            AND NOT regexp_full_match(upper(trim(diag2)), '[0-9]{{3,5}}|[EV][0-9]{{2,4}}'))
        OR (event_year >= 1997
            AND NOT regexp_full_match(upper(trim(diag2)), '[A-Z][0-9]{{2}}[0-9X]'))))
    AS anomalous_external_codes
FROM deaths
""")
def audit_scalars(spark, sf_dir):
    return deaths.scalars(raw_deaths(spark, sf_dir))


@query(f"""
WITH {RAW_DEATHS}
SELECT least(min(event_date), make_date(min(event_year) FILTER (WHERE event_date IS NULL), 1, 1))
         AS first_day,
       greatest(max(event_date),
                least(make_date(max(event_year) FILTER (WHERE event_date IS NULL), 12, 31),
                      DATE '2001-08-20')) AS last_day
FROM deaths
""")
def occurrence_bounds(spark, sf_dir):
    return deaths.bounds(raw_deaths(spark, sf_dir), CUTOFF)


@query(f"""
WITH {RAW_DEATHS}, broken AS (
  SELECT * REPLACE (CASE WHEN length(comuna) = 4 AND diag1 LIKE '%X' THEN 'A' || comuna
                         ELSE comuna END AS comuna,
                    CASE WHEN edad_tipo = '2' AND edad_cant = '11' THEN '13'
                         ELSE edad_cant END AS edad_cant,
                    CASE WHEN sexo = 'Mujer' AND edad_cant = '7' THEN 'mujer' ELSE sexo END AS sexo,
                    CASE WHEN diag1 = '150' THEN 'A150' ELSE diag1 END AS diag1)
  FROM deaths)
SELECT rule_id, failed FROM (
SELECT 'year_form' AS rule_id, count(*) FILTER (WHERE NOT regexp_full_match(anio, '[0-9]{{4}}'))
  AS failed FROM broken
UNION ALL SELECT 'date_valid', count(*) FILTER (WHERE fecha <> ''
  AND try_strptime(fecha, '%Y-%m-%d') IS NULL) FROM broken
UNION ALL SELECT 'date_in_year', count(*) FILTER (WHERE fecha <> ''
  AND event_year <> year(TRY_CAST(fecha AS DATE))) FROM broken
UNION ALL SELECT 'sex_known', count(*) FILTER (WHERE sexo NOT IN
  ('Hombre', 'Mujer', 'Indeterminado')) FROM broken
UNION ALL SELECT 'age_type_known', count(*) FILTER (WHERE edad_tipo NOT IN
  ('', '0', '1', '2', '3', '4')) FROM broken
UNION ALL SELECT 'age_count_range', count(*) FILTER (WHERE edad_cant <> '' AND (
  NOT regexp_full_match(edad_cant, '[0-9]+')
  OR (edad_tipo = '2' AND TRY_CAST(edad_cant AS INTEGER) > 11)
  OR (edad_tipo = '3' AND TRY_CAST(edad_cant AS INTEGER) > 31)
  OR (edad_tipo = '4' AND TRY_CAST(edad_cant AS INTEGER) > 24))) FROM broken
UNION ALL SELECT 'commune_form', count(*) FILTER (WHERE comuna NOT IN ('', '99999')
  AND NOT regexp_full_match(comuna, '[0-9]{{1,5}}')) FROM broken
UNION ALL SELECT 'cause_matches_era', count(*) FILTER (WHERE diag1 <> '' AND (
  (event_year <= 1996 AND regexp_matches(upper(diag1), '^[A-DF-UW-Z]'))
  OR (event_year >= 1997 AND regexp_full_match(diag1, '[0-9]{{3,5}}')))) FROM broken
UNION ALL SELECT 'inside_coverage', count(*) FILTER (WHERE NOT CASE WHEN fecha <> ''
  THEN TRY_CAST(fecha AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-08-20'
  ELSE event_year BETWEEN 1995 AND 2001 END) FROM broken)
""")
def death_row_rules(spark, sf_dir):
    commune, kind, count = F.col("COD_COMUNA"), F.col("EDAD_TIPO"), F.col("EDAD_CANT")
    sex, code = F.col("SEXO_NOMBRE"), F.col("DIAG1")
    broken = raw_deaths(spark, sf_dir).select(
        "AÑO",
        "FECHA_DEF",
        "EDAD_TIPO",
        F.when((F.length(commune) == 4) & code.endswith("X"), F.concat(F.lit("A"), commune))
        .otherwise(commune)
        .alias("COD_COMUNA"),
        F.when((kind == "2") & (count == "11"), "13").otherwise(count).alias("EDAD_CANT"),
        F.when((sex == "Mujer") & (count == "7"), "mujer").otherwise(sex).alias("SEXO_NOMBRE"),
        F.when(code == "150", "A150").otherwise(code).alias("DIAG1"),
    )
    rules = deaths.row_rules(date(1995, 6, 1), CUTOFF)
    return check(deaths.with_parsed(broken), rules).select("rule_id", "failed")


@query(f"""
WITH {RAW_DEATHS}, observed AS (
  SELECT 'year' AS audit, anio AS key, count(*) AS n FROM deaths GROUP BY 2
  UNION ALL SELECT 'sex', sexo, count(*) FROM deaths GROUP BY 2
  UNION ALL SELECT 'age_type', edad_tipo, count(*) FROM deaths GROUP BY 2),
expected AS (
  SELECT 'year' AS audit, CAST(year(l_shipdate) AS VARCHAR) AS key,
         count(*) + CASE WHEN year(l_shipdate) = 1999 THEN 1 ELSE 0 END AS expected
  FROM lineitem WHERE year(l_shipdate) <> 1996 GROUP BY year(l_shipdate))
SELECT e.audit, e.key, e.expected, o.n AS observed, e.expected = o.n AS agrees
FROM expected e LEFT JOIN observed o ON e.audit = o.audit AND e.key = o.key
""")
def control_check(spark, sf_dir):
    year = F.year("l_shipdate")
    expected = (
        table(spark, sf_dir, "lineitem")
        .where(year != 1996)
        .groupBy(year.alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.lit("year").alias("audit"),
            F.col("y").cast("string").alias("key"),
            (F.col("n") + F.when(F.col("y") == 1999, 1).otherwise(0)).alias("expected"),
        )
    )
    return counts.control_differences(expected, deaths.audit(raw_deaths(spark, sf_dir)))


@query(f"""
WITH {RAW_DEATHS}
SELECT comuna AS "COD_COMUNA", nombre_region AS "NOMBRE_REGION", count(*) AS events, region
FROM deaths GROUP BY 1, 2, 4
""")
def region_lookup(spark, sf_dir):
    return deaths.region_lookup(raw_deaths(spark, sf_dir))


@query(f"""
WITH {RAW_DEATHS}
SELECT region, count(*) AS events, count(DISTINCT comuna) AS communes FROM deaths GROUP BY 1
""")
def region_lookup_join(spark, sf_dir):
    raw = raw_deaths(spark, sf_dir)
    # written first, so its size is known and Spark decides how to join it
    lookup = stage(deaths.region_lookup(raw), "region-lookup")
    joined = deaths.with_region(raw, lookup)
    return joined.groupBy("region").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("COD_COMUNA").alias("communes")
    )


@query(f"""
WITH {RAW_DEATHS}
SELECT DISTINCT nombre_region AS "NOMBRE_REGION" FROM deaths
""")
def region_labels(spark, sf_dir):
    return deaths.region_labels(raw_deaths(spark, sf_dir))


@query(f"""
WITH {RAW_DEATHS}
SELECT 'count_conserved' AS rule_id, CAST(count(*) - (SELECT count(*) FROM lineitem) AS BIGINT)
  AS failed FROM deaths
""")
def count_conservation(spark, sf_dir):
    raw = raw_deaths(spark, sf_dir)
    facts = deaths.count_facts(raw, deaths.Grain(), CUTOFF)
    return counts.conservation(facts, raw).select("rule_id", "failed")


@query(f"""
WITH {RAW_DEATHS}
SELECT 'count_conserved' AS rule_id, count(*) FILTER (sex = 'female') AS failed FROM deaths
""")
def count_difference(spark, sf_dir):
    """Facts from which one sex was left out: as many events are missing as it has."""
    raw = raw_deaths(spark, sf_dir)
    facts = deaths.count_facts(raw, deaths.Grain(), CUTOFF).where("sex <> 'female'")
    return counts.conservation(facts, raw).select("rule_id", "failed")


@query("""
SELECT p_brand, p_type, p_size, count(*) AS rows FROM part
GROUP BY ALL HAVING count(*) > 1
""")
def duplicate_keys(spark, sf_dir):
    return counts.duplicates(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


# --- births --------------------------------------------------------------------

BIRTH_DIMS = """period_start, period_end, date_basis, age_lower, age_upper, age_open, sex,
       region, nationality"""


@query(f"WITH {BIRTHS} SELECT {BIRTH_DIMS}, count(*) AS value FROM births GROUP BY ALL")
def birth_facts(spark, sf_dir):
    return births.count_facts(raw_births(spark, sf_dir))


@query(f"""
WITH {BIRTHS}
SELECT 'year' AS audit, CAST(y AS VARCHAR) AS key, count(*) AS n FROM births GROUP BY 2
UNION ALL SELECT 'sex', CASE sex WHEN 'male' THEN '1' WHEN 'female' THEN '2' ELSE '9' END, count(*)
FROM births GROUP BY 2
""")
def birth_audit(spark, sf_dir):
    return births.audit(births.raw_groups(raw_births(spark, sf_dir)))


@query(f"""
WITH {BIRTHS}
SELECT count(*) AS raw_rows,
  count(*) FILTER (WHERE k % 5 = 3) AS lowercase_nationality_codes,
  count(*) FILTER (WHERE no_month) AS blank_birth_months,
  count(*) FILTER (WHERE k % 10 = 9) AS unknown_maternal_age_groups,
  count(*) FILTER (WHERE region = 'unknown') AS unknown_residence_regions,
  count(DISTINCT region) FILTER (WHERE region <> 'unknown') AS distinct_known_residence_regions
FROM births
""")
def birth_scalars(spark, sf_dir):
    return births.scalars(births.raw_groups(raw_births(spark, sf_dir)))


@query("""
SELECT 'year_in_coverage' AS rule_id,
       count(*) FILTER (WHERE NOT year(o_orderdate) BETWEEN 1995 AND 2000) AS failed FROM orders
UNION ALL SELECT 'month_valid', count(*) FILTER (WHERE false) FROM orders
UNION ALL SELECT 'sex_known', count(*) FILTER (WHERE o_orderkey % 37 = 0) FROM orders
UNION ALL SELECT 'maternal_age_known', count(*) FILTER (WHERE o_orderkey % 41 = 0) FROM orders
UNION ALL SELECT 'nationality_known', count(*) FILTER (WHERE o_orderkey % 43 = 0) FROM orders
UNION ALL SELECT 'region_agrees', count(*) FILTER (WHERE o_custkey % 17 = 3) FROM orders
""")
def birth_row_rules(spark, sf_dir):
    key, label = F.col("o_orderkey"), F.col("GLOSA_REGION_RESIDENCIA")
    wrong_label = F.when(F.col("REGION_RESIDENCIA") == "4", "De Arica y Parinacota")
    spoiled = raw_births(spark, sf_dir, "o_orderkey").withColumns(
        {
            "SEXO": F.when(key % 37 == 0, "3").otherwise(F.col("SEXO")),
            "GRUPO_ETARIO_MADRE": F.when(key % 41 == 0, "16 a 20 años").otherwise(
                F.col("GRUPO_ETARIO_MADRE")
            ),
            "NACIONALIDAD_MADRE": F.when(key % 43 == 0, "Z").otherwise(
                F.col("NACIONALIDAD_MADRE")
            ),
            "GLOSA_REGION_RESIDENCIA": wrong_label.otherwise(label),
        }
    )
    rules = births.row_rules(date(1995, 1, 1), date(2000, 12, 31))
    return check(spoiled, rules).select("rule_id", "failed")


@query(f"""
WITH {BIRTHS}
SELECT '{{"birth_day":"not_published",' ||
  CASE WHEN no_month THEN '"birth_month":"missing_in_source_year_only",' ELSE '' END ||
  '"birth_order":"not_published",' ||
  CASE WHEN age_lower IS NULL THEN '"maternal_age":"source_group_unknown",' ELSE '' END ||
  CASE WHEN nationality IS NULL THEN '"maternal_nationality":"missing_in_source",' ELSE '' END ||
  CASE WHEN region = 'unknown' THEN '"maternal_residence":"source_code_99",' ELSE '' END ||
  '"parity":"not_published","registration_window":"release_inclusion_metadata_only",' ||
  '"residence_commune":"not_published"}}' AS missingness_reason, count(*) AS value
FROM births GROUP BY 1
""")
def birth_missingness(spark, sf_dir):
    facts = births.count_facts(raw_births(spark, sf_dir))
    return (
        facts.withColumn("missingness_reason", births.missingness())
        .groupBy("missingness_reason")
        .agg(F.sum("value").alias("value"))
    )


# --- reconciliation ------------------------------------------------------------

COMPARE = """
counted AS (SELECT period_start, sex, nationality, count(*) AS value FROM births GROUP BY ALL),
published AS (SELECT period_start, sex, nationality,
    value + CASE WHEN sex = 'male' AND nationality IS NULL THEN 1 ELSE 0 END AS value FROM counted)
"""


def _compare_sides(spark, sf_dir):
    key = ["period_start", "sex", "nationality"]
    facts = counts.sum_by_key(births.count_facts(raw_births(spark, sf_dir)), key)
    counted = stage(facts, "counted")
    shift = F.when((F.col("sex") == "male") & F.col("nationality").isNull(), 1).otherwise(0)
    return key, counted, counted.withColumn("value", F.col("value") + shift)


@query(f"""
WITH {BIRTHS}, {COMPARE}
SELECT c.period_start, c.sex, c.nationality, c.value AS left_value, p.value AS right_value,
       c.value - p.value AS difference,
       CASE WHEN c.value = p.value THEN 'matched_provisional' ELSE 'different_provisional' END
         AS status,
       'provisional_annual' AS control_release_kind, true AS control_provisional
FROM counted c JOIN published p ON c.period_start = p.period_start AND c.sex = p.sex
  AND c.nationality IS NOT DISTINCT FROM p.nationality
""")
def null_safe_reconcile(spark, sf_dir):
    key, counted, published = _compare_sides(spark, sf_dir)
    return reconcile.compare_values(counted, published, key, "provisional_annual")


@query("""
WITH keyed AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day,
                      event_type, user_id FROM events),
cells AS (SELECT day, event_type,
                 count(*) FILTER (WHERE event_type <> 'error') AS in_left,
                 count(*) FILTER (WHERE user_id % 10 <> 0) AS in_right
          FROM keyed GROUP BY 1, 2)
SELECT * FROM cells WHERE in_left <> in_right
""")
def unmatched_keys(spark, sf_dir):
    keyed = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 97 != 0, F.to_date("ts")).alias("day"), "event_type", "user_id"
    )
    return reconcile.key_difference(
        keyed.where("event_type <> 'error'"),
        keyed.where("user_id % 10 <> 0"),
        ["day", "event_type"],
    )


@query("""
WITH a AS (SELECT l_suppkey AS name, count(*) AS rows, sum(CAST(l_quantity AS BIGINT)) AS units
           FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey + 1 AS name, count(*) AS rows, sum(CAST(l_quantity AS BIGINT)) AS units
      FROM lineitem GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name,
  CASE WHEN b.name IS NULL THEN 'only_left' WHEN a.name IS NULL THEN 'only_right'
       WHEN a.rows = b.rows AND a.units = b.units THEN 'equal' ELSE 'different' END AS status
FROM a FULL JOIN b ON a.name = b.name
""")
def set_equality(spark, sf_dir):
    a = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        )
    )
    a = stage(a, "supplier-sums")
    b = a.withColumn("name", F.col("name") + 1)
    return reconcile.set_status(a, b, ["name"], ["rows", "units"])


@query("""
WITH totals AS (SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers,
  sum(CAST(round(o_totalprice) AS BIGINT)) AS price FROM orders)
SELECT 'orders' AS name, CAST(15000 AS BIGINT) AS expected, orders AS observed,
       orders = 15000 AS agrees FROM totals
UNION ALL SELECT 'customers', 1, customers, customers = 1 FROM totals
UNION ALL SELECT 'price', 0, CAST(price AS BIGINT), price = 0 FROM totals
""")
def bundle_totals(spark, sf_dir):
    return reconcile.totals_check(
        table(spark, sf_dir, "orders"),
        {
            "orders": F.count(F.lit(1)),
            "customers": F.count_distinct("o_custkey"),
            "price": F.sum(F.round("o_totalprice").cast("bigint")),
        },
        {"orders": 15000, "customers": 1, "price": 0},
    )

