"""Files and payloads written from the tables, read back by the scans, and checked against the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.functions import dates, numbers, structures
from factspan.operators import exposure, metrics, rulesets
from factspan.operators.rules import check, report
from factspan.plans import batch, deaths, finance
from factspan.queries.base import BIRTHS, RAW_DEATHS, PENSIONERS, query, raw_births, raw_deaths, raw_pensioners, table
from factspan.queries.domains import RELEASE, SOURCE
from factspan.session import new_path, stage
from factspan.sources import files, payloads
from factspan.streaming import births as streams


def _delimited(spark, rows: DataFrame, columns, name: str, encoding: str = "UTF-8", filler: str = "x") -> str:
    """Rows as ``;``-delimited text with a header and all of ``columns``; those they lack hold ``filler``."""
    path = new_path(spark, name)
    whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(filler).alias(c) for c in columns])
    writer = whole.write.option("header", True).option("sep", ";").option("encoding", encoding)
    files._allow_charset(spark, encoding)
    writer.option("emptyValue", "").option("nullValue", "").csv(path)
    return path


# --- scans of raw files ---------------------------------------------------------


@query(f"""
WITH {RAW_DEATHS}
SELECT nombre_region AS region, sexo AS sex, anio AS year, count(*) AS n, count(*) FILTER (diag1 = '') AS no_cause,
       count(DISTINCT comuna) AS communes
FROM raw_deaths GROUP BY ALL
""")
def scan_death_files(spark, sf_dir):
    """Death events in windows-1252 files of all 27 columns."""
    path = _delimited(spark, raw_deaths(spark, sf_dir), files.DEATH_COLUMNS, "death-files", "windows-1252")
    files.require_header(files.header_of(spark, path, ";", "windows-1252"), files.DEATH_COLUMNS)
    raw = files.scan_deaths(spark, path)
    return raw.groupBy(
        F.col("NOMBRE_REGION").alias("region"), F.col("SEXO_NOMBRE").alias("sex"), F.col("AÑO").alias("year")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("DIAG1") == "").alias("no_cause"),
        F.count_distinct("COD_COMUNA").alias("communes"),
    )


@query(f"""
WITH {BIRTHS}
SELECT CASE WHEN k % 2 = 0 THEN 25 ELSE 29 END AS profile, y::VARCHAR AS year, CASE WHEN no_month THEN '' ELSE m::VARCHAR END AS month,
       count(*) AS n FROM births GROUP BY ALL
""")
def scan_birth_files(spark, sf_dir):
    """Birth records in files of either published layout."""
    raw, parts = raw_births(spark, sf_dir, "o_orderkey"), []
    for rest, profile in ((0, 25), (1, 29)):
        rows = raw.where(F.col("o_orderkey") % 2 == rest)
        path = _delimited(spark, rows, files.BIRTH_PROFILES[profile], f"birth-files-{profile}")
        own = files.scan_births(spark, path, profile)
        parts.append(own.select(F.lit(profile).alias("profile"), F.col("ANO_NAC").alias("year"), F.col("MES_NAC").alias("month")))
    return parts[0].unionAll(parts[1]).groupBy("profile", "year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {PENSIONERS}
SELECT CASE WHEN route < 3 THEN route + 1 ELSE 4 END AS kind, count(*) AS n, count(died) AS deaths,
       sum(year(vig))::BIGINT AS years FROM pensioners GROUP BY 1
""")
def scan_pensioner_files(spark, sf_dir):
    """Pensioner rows in files with a person identifier, which the scan leaves out."""
    path = _delimited(spark, raw_pensioners(spark, sf_dir), files.PENSIONER_SCHEMA.fieldNames(), "pensioner-files")
    rows = files.scan_pensioners(spark, path)
    if "ID" in rows.columns:
        raise AssertionError("the person identifier was read")
    return rows.groupBy(F.col("TABLA").cast("bigint").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("FEC_FALL") != 0).alias("deaths"),
        F.sum(F.floor(F.col("FEC_VIG") / 10000)).alias("years"),
    )


@query("""
WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'births_age' AS name, sum(n)::BIGINT AS total, count(*) AS rows, min(period) AS first FROM m UNION ALL
SELECT 'deaths_age', sum(n)::BIGINT, count(*), min(period) FROM m UNION ALL
SELECT 'population_age', sum(n)::BIGINT, count(DISTINCT f), min(f) FROM m UNION ALL
SELECT 'monthly', sum(n)::BIGINT, count(DISTINCT period), min(period) FROM m
""")
def bundle(spark, sf_dir):
    """The four bundled tables as CSV files with columns of their own besides the required ones."""
    month = F.date_format("l_shipdate", "yyyy-MM").alias("period")
    cells = table(spark, sf_dir, "lineitem").groupBy(month, F.col("l_returnflag").alias("age_group")).agg(F.count(F.lit(1)).alias("n"))
    cells, folder = stage(cells, "bundle-cells"), new_path(spark, "bundle")
    one, zero = F.col("n"), F.lit(0)
    by_age = cells.groupBy("age_group").agg(F.sum("n").alias("n"))
    by_month = cells.groupBy("period").agg(F.sum("n").alias("n"))
    shaped = {
        "births_age": cells.select("age_group", one.alias("births_total"), "period", F.lit("more").alias("extra")),
        "deaths_age": cells.select(
            "age_group", one.alias("deaths_total"), one.alias("deaths_male"), zero.alias("deaths_female"), "period"
        ),
        "population_age": by_age.select(
            F.lit("x").alias("extra"), "age_group", one.alias("population_total"), one.alias("population_male"),
            zero.alias("population_female"),
        ),
        "monthly": by_month.select("period", one.alias("births_total"), zero.alias("deaths_total"), F.lit("u").alias("source_url")),
    }
    for key, rows in shaped.items():
        files.write_csv(rows, f"{folder}/{files.BUNDLE[key][0]}")
    read = files.load_bundle(spark, folder)
    totals = {"births_age": ("births_total", "period"), "deaths_age": ("deaths_male", "period"),
              "population_age": ("population_total", "age_group"), "monthly": ("births_total", "period")}
    parts = [
        read[key].agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"), F.min(first).alias("first"))
        .select(F.lit(key).alias("name"), "total", "rows", "first")
        for key, (value, first) in totals.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


CURATED = [("c_custkey", "integer"), ("c_name", "string"), ("c_acctbal", "float64"), ("since", "date"), ("nation", "integer")]


@query("""
SELECT c_custkey, c_name, c_acctbal, DATE '2020-01-01' + (c_custkey % 700)::INTEGER AS since,
       CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey::BIGINT END AS nation FROM customer
""")
def curated_customers(spark, sf_dir):
    """Customers as a curated CSV of typed cells, one column with missing cells."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_acctbal", F.expr("date_add(DATE'2020-01-01', cast(c_custkey % 700 as int))").alias("since"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("nation"),
    )
    path = new_path(spark, "curated")
    files.write_csv(rows, path)
    return files.read_curated(spark, path, CURATED, optional=["nation"])


@query("""
SELECT o_orderstatus AS status, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def written_tables(spark, sf_dir):
    """Orders through both sinks: the CSV holds what the partitioned Parquet holds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    text, parquet = new_path(spark, "sink-csv"), new_path(spark, "sink-parquet")
    files.write_csv(orders, text)
    files.write_parquet(orders, parquet, "status")
    back = spark.read.schema(orders.schema).option("header", True).csv(text)
    whole = spark.read.parquet(parquet).select(*orders.columns)
    same = back.exceptAll(whole).unionAll(whole.exceptAll(back))
    extra = same.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total"))
    kept = whole.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return kept.unionAll(extra)


@query("""
WITH a AS (SELECT 'n' || o_custkey % 500 AS key FROM orders), c AS (SELECT DISTINCT key FROM a WHERE key NOT LIKE '%7'),
assets AS (SELECT key FROM c UNION ALL SELECT key FROM c WHERE key LIKE '%3')
SELECT 'asset_key_unique' AS rule_id, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM assets GROUP BY key HAVING count(*) > 1)) AS failed
UNION ALL SELECT 'acquired_unique', 0 UNION ALL SELECT 'available_unique', 0 UNION ALL SELECT 'unavailable_unique', 0
UNION ALL SELECT 'acquired_is_available', (SELECT count(*) FROM c WHERE key LIKE '%9')
UNION ALL SELECT 'unavailable_is_absent', (SELECT count(*) FROM c WHERE key LIKE '%11')
UNION ALL SELECT 'available_is_declared', (SELECT count(DISTINCT key) FROM a WHERE key LIKE '%7')
""")
def source_inventory(spark, sf_dir):
    """Inventory rules over keys of orders, with a breach of every kind that can occur."""
    key = F.concat(F.lit("n"), (F.col("o_custkey") % 500).cast("string")).alias("key")
    found = stage(table(spark, sf_dir, "orders").select(key).distinct(), "inventory")
    known = found.where("key not like '%7'")
    assets = known.unionAll(known.where("key like '%3'"))
    available = found.where("key not like '%9'")
    unavailable = found.where("key like '%9' or key like '%11'").where("key not like '%7'")
    result = files.inventory_report(assets, known, available, unavailable)
    return result.select("rule_id", "failed")


# --- payloads -------------------------------------------------------------------

_SERIES = """
WITH cells AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS d, count(*) AS n FROM orders GROUP BY 1, 2)
"""


def _series_documents(spark, sf_dir):
    """Per priority one observation document and one search document, and the contract of all."""
    cells = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "MM").alias("d")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells, "series-cells")
    dmy = lambda c: F.date_format(c, "dd-MM-yyyy")
    missing = F.col("n") % 5 == 0
    value = F.when(missing, "").otherwise(F.concat(F.col("n").cast("string"), F.lit(".5")))
    item = F.struct(
        dmy("d").alias("indexDateString"), value.alias("value"), F.when(missing, "ND").otherwise("OK").alias("statusCode")
    )
    # one document per priority holds a calendar of months
    series = cells.groupBy("p").agg(
        F.array_sort(F.collect_list(F.struct("d", item.alias("o")))).alias("os"), F.min("d").alias("first"), F.max("d").alias("last")
    )
    title = F.concat(F.lit("Serie  "), F.col("p"))
    nothing = F.array().cast("array<struct<a:string>>")
    body = F.struct(
        title.alias("descripEsp"), F.concat(F.lit("Series "), F.col("p")).alias("descripIng"), F.col("p").alias("seriesId"),
        F.transform("os", lambda x: x["o"]).alias("Obs"),
    )
    observed = F.to_json(F.struct(F.lit(0).alias("Codigo"), F.lit("Success").alias("Descripcion"), body.alias("Series"),
                                  nothing.alias("SeriesInfos")))
    info = F.struct(
        F.col("p").alias("seriesId"), F.lit("MONTHLY").alias("frequencyCode"), title.alias("spanishTitle"),
        F.concat(F.lit("Series "), F.col("p")).alias("englishTitle"), dmy("first").alias("firstObservation"),
        dmy("last").alias("lastObservation"), dmy("last").alias("updatedAt"), dmy("first").alias("createdAt"),
    )
    empty = F.struct(*[F.lit(None).cast("string").alias(f) for f in payloads.SERIES_FIELDS])
    searched = F.to_json(
        F.struct(F.lit(0).alias("Codigo"), F.lit("Success").alias("Descripcion"), empty.alias("Series"), F.array(info).alias("SeriesInfos")),
        {"ignoreNullFields": "false"},
    )
    contract = series.select(
        F.col("p").alias("series_id"), F.lit("MONTHLY").alias("frequency"), title.alias("spanish_title"),
        F.concat(F.lit("Series "), F.col("p")).alias("english_title"), F.col("first").alias("first_observation"),
        F.col("last").alias("last_observation"), F.col("last").alias("updated_on"), F.col("first").alias("created_on"),
    )
    return (*(_documents(spark, series.select("p", text.alias("value"))) for text in (observed, searched)), contract)


def _documents(spark, texts: DataFrame) -> DataFrame:
    """One file per row of (p, value), read back as documents."""
    path = new_path(spark, "documents")
    texts.repartition("p").write.partitionBy("p").text(path)
    return payloads.read_documents(spark, f"{path}/*/*.txt")


@query(_SERIES + """
SELECT p AS series_id, d AS observed_on, CASE WHEN n % 5 <> 0 THEN n + 0.5::DOUBLE END AS published,
       CASE WHEN n % 5 = 0 THEN 'ND' ELSE 'OK' END AS status_code FROM cells
""")
def series_payloads(spark, sf_dir):
    documents, _, contract = _series_documents(spark, sf_dir)
    return payloads.parse_series(documents, contract)


@query(_SERIES + """
SELECT p AS series_id, 'MONTHLY' AS frequency, 'Series ' || p AS english_title, min(d) AS first_observation, max(d) AS updated_on
FROM cells GROUP BY 1
""")
def series_metadata(spark, sf_dir):
    _, documents, contract = _series_documents(spark, sf_dir)
    found = payloads.parse_series_metadata(documents, contract)
    return found.select("series_id", "frequency", "english_title", "first_observation", "updated_on")


TABLES = ("A", "N", "R")


@query("""
WITH g AS (SELECT t AS table_id, a AS age FROM (VALUES ('A'), ('N'), ('R')) v(t), range(0, 111) r(a)),
c AS (SELECT l_returnflag AS table_id, l_partkey % 111 AS age, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1, 2)
SELECT table_id, age::INTEGER AS age, coalesce(n, 0)::BIGINT AS delta_exposed, coalesce(s, 0)::BIGINT AS delta_deaths
FROM g LEFT JOIN c USING (table_id, age)
""")
def deviation_payload(spark, sf_dir):
    """The deviation document: one row per table and age of a closed grid."""
    counted = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("table_id"), (F.col("l_partkey") % 111).cast("int").alias("age")
    ).agg(F.count(F.lit(1)).alias("delta_exposed"), F.sum("l_linenumber").cast("bigint").alias("delta_deaths"))
    grid = spark.createDataFrame([(t,) for t in TABLES], "table_id string").select("table_id", structures.integer_grid(0, 110).alias("age"))
    rows = grid.join(counted, ["table_id", "age"], "left").fillna(0, ["delta_exposed", "delta_deaths"])
    head = {f: F.lit("x").alias(f) for f in payloads.DEVIATION_ROOT if f != "rows"}
    # a grid of 333 cells is one document
    whole = rows.agg(F.collect_list(F.struct(*payloads.DEVIATION_ROW)).alias("rows"))
    text = F.to_json(F.struct(*[head.get(f, F.col("rows")) for f in payloads.DEVIATION_ROOT]))
    documents = _documents(spark, whole.select(F.lit("all").alias("p"), text.alias("value")))
    return payloads.parse_deviations(documents, TABLES)


# --- streams over written files ---------------------------------------------------


@query(f"""
WITH {BIRTHS}, seen AS (SELECT count(*) AS raw FROM births)
SELECT period_start, sex, region, count(*)::DOUBLE AS value, any_value(raw) AS raw FROM births, seen GROUP BY ALL
""")
def births_in_two_passes(spark, sf_dir):
    """Births checked as a whole, then streamed file by file into shards and merged; a sidecar sees every raw row."""
    path, sidecar = _delimited(spark, raw_births(spark, sf_dir).repartition(3), files.BIRTH_COLUMNS_25, "birth-stream"), new_path(spark, "sidecar")

    def keep(raw: DataFrame, batch_id: int) -> None:
        raw.select(F.lit(batch_id).alias("shard")).write.mode("overwrite").parquet(f"{sidecar}/batch={batch_id}")

    span = (date(1990, 1, 1), date(2030, 12, 31))
    merged = streams.two_pass(spark, path, RELEASE, "dpa-2019", span, sidecar=keep)
    seen = spark.read.parquet(f"{sidecar}/batch=*").agg(F.count(F.lit(1)).alias("raw"))
    return merged.groupBy("period_start", "sex", "region").agg(F.sum("value").alias("value")).crossJoin(seen)


# --- identifiers, evidence, cubes ---------------------------------------------------


@query(f"""
WITH {RAW_DEATHS}, facts AS (SELECT event_year, sex, region, CASE WHEN event_year <= 1996 THEN 'ICD-9' ELSE 'ICD-10' END AS code,
                                    event_date IS NULL AS basis FROM deaths GROUP BY ALL)
SELECT 'fact_id_reproduced' AS rule_id, count(*) FILTER (sex = 'male') AS failed FROM facts
UNION ALL SELECT 'observation_id_reproduced', count(*) FILTER (sex = 'female') FROM facts
""")
def reproduced_identifiers(spark, sf_dir):
    """Identifiers computed again from the rows of a written batch in which one sex was renamed and one vintage changed."""
    grain = deaths.Grain("year", "all", "region", "all", True)
    facts = deaths.normalise(raw_deaths(spark, sf_dir), RELEASE, grain, date(1990, 1, 1), date(2030, 12, 31), SOURCE)
    male, female = F.col("sex") == "male", F.col("sex") == "female"
    changed = facts.withColumns(
        {"vintage": F.when(female, "other").otherwise(F.col("vintage")), "sex": F.when(male, "men").otherwise(F.col("sex"))}
    )
    return batch.identifier_report(stage(changed, "changed-batch"), "demographic", SOURCE).select("rule_id", "failed")


@query("""
WITH a AS (SELECT o_orderpriority AS release_id, 'f' || o_custkey % 50 AS source_key, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
m AS (SELECT *, md5(k::VARCHAR) AS h FROM a WHERE source_key NOT LIKE '%4'),
f AS (SELECT release_id, source_key, CASE WHEN k % 7 = 0 THEN md5('x') ELSE md5(k::VARCHAR) END AS h FROM a WHERE source_key NOT LIKE '%5'),
p AS (SELECT release_id, source_key, md5(k::VARCHAR) AS h FROM a WHERE source_key NOT LIKE '%6')
SELECT coalesce(m.release_id, f.release_id, p.release_id) AS release_id, coalesce(m.source_key, f.source_key, p.source_key) AS source_key,
  CASE WHEN f.h IS NULL AND m.h IS NULL THEN NULL WHEN f.h IS NULL THEN 'only_left' WHEN m.h IS NULL THEN 'only_right'
       WHEN m.h = f.h THEN 'equal' ELSE 'different' END AS files,
  CASE WHEN p.h IS NULL AND m.h IS NULL THEN NULL WHEN p.h IS NULL THEN 'only_left' WHEN m.h IS NULL THEN 'only_right'
       WHEN m.h = p.h THEN 'equal' ELSE 'different' END AS provenance
FROM m FULL JOIN f USING (release_id, source_key) FULL JOIN p USING (release_id, source_key)
""")
def release_evidence(spark, sf_dir):
    """Manifest, acquired files and provenance in one status table: what each source key lacks or holds differently."""
    cells = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("release_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("source_key")
    ).agg(F.max("o_orderkey").alias("k"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    common = {"released_at": F.lit("2024-01-01").cast("date"), "release_missingness_reason": F.lit(None).cast("string"), "available_at": at}
    cells = stage(cells, "evidence").withColumns({"sha256": F.md5(F.col("k").cast("string")), **common})
    manifest = cells.where("source_key not like '%4'")
    acquired = cells.where("source_key not like '%5'").withColumn("sha256", F.when(F.col("k") % 7 == 0, F.md5(F.lit("x"))).otherwise(F.col("sha256")))
    named = cells.where("source_key not like '%6'")
    return batch.release_evidence(manifest, acquired, named)


@query("""
WITH c AS (SELECT l_returnflag AS f, l_linenumber AS n, count(*)::DOUBLE AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT f, n, 'lines' AS variable, lines AS value FROM c UNION ALL SELECT f, n, 'quantity', quantity FROM c WHERE true
""")
def cube_of_variables(spark, sf_dir):
    """A second variable added to a cube on the same coordinates."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n")).agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("quantity")
    )
    cells = stage(cells, "cube")
    one, two = (cells.select("f", "n", F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("lines", "quantity"))
    cube = exposure.add_variable(one, two, ["f", "n"])
    kept = [exposure.select_cells(cube, variable=v) for v in ("lines", "quantity")]
    return kept[0].unionAll(kept[1])


@query("""
WITH s AS (SELECT o_custkey % 90 AS age, count(*)::DOUBLE AS stock FROM orders GROUP BY 1)
SELECT a AS age, round(coalesce(stock, 0) / 12, 9) AS exposure FROM range(0, 111) r(a) LEFT JOIN s ON s.age = a
""")
def monthly_exposure(spark, sf_dir):
    """A month's exposure out of a stock, on the whole age grid."""
    stock = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 90).alias("age")).agg(F.count(F.lit(1)).cast("double").alias("stock"))
    grid = spark.range(1).select(structures.integer_grid(0, 110).alias("age"))
    filled = grid.join(stock, "age", "left").withColumn("stock", F.coalesce("stock", F.lit(0.0)))
    return filled.select("age", F.round(numbers.monthly_exposure(F.col("stock")), 9).alias("exposure"))


@query("""
WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  WHEN 2 THEN strftime(ts, '%d-%m-%Y') WHEN 3 THEN '' WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE 'soon' END AS x, ts FROM events)
SELECT event_id % 6 AS form, count(*) AS n, count(CASE WHEN event_id % 6 IN (0, 1, 4) THEN 1 END) AS read,
  max(CASE event_id % 6 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('minute', ts) END)::TIMESTAMP AS latest
FROM t GROUP BY 1
""")
def registration_times(spark, sf_dir):
    """Registration texts of six forms, three of them ISO-like."""
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "dd-MM-yyyy", None, "yyyy-MM-dd HH:mm", None)
    form, text = F.col("event_id") % 6, F.lit(None).cast("string")
    for number, pattern in enumerate(forms):
        own = F.date_format("ts", pattern) if pattern else F.lit("" if number == 3 else "soon")
        text = F.when(form == number, own).otherwise(text)
    rows = table(spark, sf_dir, "events").select(form.alias("form"), dates.registration_time(text).alias("at"))
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count("at").alias("read"), F.max("at").alias("latest"))


# --- rule sets of side tables ----------------------------------------------------------


@query("""
WITH t AS (SELECT o_orderkey AS k FROM orders)
SELECT 'source_key_snake_case' AS rule_id, count(*) FILTER (k % 13 = 0) AS failed FROM t
UNION ALL SELECT 'sha256_form', count(*) FILTER (k % 17 = 0) FROM t
UNION ALL SELECT 'available_at_present', count(*) FILTER (k % 19 = 0) FROM t
UNION ALL SELECT 'release_date_or_reason', count(*) FILTER (k % 23 = 0) FROM t
UNION ALL SELECT 'source_key_unique', (SELECT sum(n)::BIGINT FROM
  (SELECT CASE WHEN k % 13 = 0 THEN 'Bad' ELSE 'key_' || k END AS s, k % 50 AS r, count(*) AS n FROM t GROUP BY s, r HAVING count(*) > 1))
UNION ALL SELECT 'primary_asset_present', (SELECT count(DISTINCT k % 50) FROM t)
""")
def asset_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (k % 50).cast("string").alias("release_id"), F.when(k % 13 == 0, "Bad").otherwise(F.concat(F.lit("key_"), k.cast("string"))).alias("source_key"),
        F.when(k % 17 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"),
        F.when(k % 19 != 0, F.lit("2024-01-01").cast("timestamp")).alias("available_at"),
        F.when(k % 23 != 0, F.lit("2024-01-01").cast("date")).alias("released_at"), F.lit(None).cast("string").alias("release_missingness_reason"),
    )
    return rulesets.asset_report(stage(rows, "assets"), "primary").select("rule_id", "failed")


@query("""
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem)
SELECT 'stock_nonnegative' AS rule_id, count(*) FILTER (k % 7 = 0) AS failed FROM t
UNION ALL SELECT 'deaths_whole_nonnegative', count(*) FILTER (k % 7 = 0 OR k % 11 = 0) FROM t
UNION ALL SELECT 'exposure_positive', count(*) FILTER (k % 7 = 0 OR (k % 13 = 0 AND k % 11 <> 0)) FROM t
UNION ALL SELECT 'observed_nonnegative', count(*) FILTER (k % 7 = 0) FROM t
UNION ALL SELECT 'expected_positive', count(*) FILTER (k % 17 = 0) FROM t
UNION ALL SELECT 'lower_finite', count(*) FILTER (n = 7) FROM t
UNION ALL SELECT 'upper_above_lower', count(*) FILTER (n = 3) FROM t
UNION ALL SELECT 'count_nonnegative', count(*) FILTER (k % 7 = 0) FROM t
UNION ALL SELECT 'archive_binding', count(*) FILTER (k % 29 = 0) FROM t
UNION ALL SELECT 'coverage_ordered', count(*) FILTER (k % 31 = 0) FROM t
UNION ALL SELECT 'released_after_cutoff', count(*) FILTER (k % 37 = 0) FROM t
UNION ALL SELECT 'vintage_nonblank', count(*) FILTER (k % 41 = 0) FROM t
UNION ALL SELECT 'provisional_declared', count(*) FILTER (k % 43 = 0) FROM t
""")
def side_table_rules(spark, sf_dir):
    """Rules of stocks, deaths, exposure, fits, bins, archives and releases in one pass over lines with deliberate errors."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    day = lambda shift: F.expr(f"date_add(DATE'2020-01-01', {shift})")
    value = F.when(k % 7 == 0, -1.0).when(k % 11 == 0, 0.5).when(k % 13 == 0, 0.0).otherwise(3.0)
    rows = table(spark, sf_dir, "lineitem").select(
        value.alias("value"), F.when(k % 7 == 0, -1.0).otherwise(1.0).alias("observed"), F.when(k % 17 == 0, 0.0).otherwise(2.0).alias("expected"),
        F.when(n == 7, -1.0).otherwise(n.cast("double")).alias("age_lower"), F.when(n == 3, 2.0).when(n == 5, None).otherwise(n + 1.0).alias("age_upper"),
        value.alias("count"), F.when(k % 29 == 0, "other").otherwise("archive").alias("source_key"), F.lit("member.csv").alias("member"),
        F.when(k % 31 == 0, day(9)).otherwise(day(0)).alias("observation_start"), day(5).alias("observation_cutoff"),
        F.when(k % 37 == 0, day(1)).when(k % 2 == 0, day(8)).alias("released_at"), F.when(k % 41 == 0, " ").otherwise("v1").alias("vintage"),
        F.when(k % 43 != 0, True).alias("provisional"),
    )
    rules = [
        *exposure.stock_rules(), *exposure.death_rules(), *exposure.exposure_rules(), *metrics.input_rules(),
        *rulesets.grouped_count_rules(), *batch.archive_binding_rules(True, "archive", "member.csv"), *rulesets.release_rules(),
    ]
    return check(rows, rules).select("rule_id", "failed")


@query("""
WITH c AS (SELECT l_returnflag || l_linestatus AS audit, l_linenumber::VARCHAR AS key, l_suppkey % 100 - 1 AS expected FROM lineitem)
SELECT 'expected_nonnegative' AS rule_id, count(*) FILTER (expected < 0) AS failed FROM c
UNION ALL SELECT 'control_key_unique', (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM c GROUP BY audit, key HAVING count(*) > 1))
UNION ALL SELECT 'weight_finite', count(*) FILTER (l_orderkey % 7 = 0) FROM lineitem
UNION ALL SELECT 'weight_cell_unique', (SELECT sum(n)::BIGINT FROM
  (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1))
""")
def control_and_weight_rules(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    held = lines.select(
        F.concat("l_returnflag", "l_linestatus").alias("audit"), F.col("l_linenumber").cast("string").alias("key"),
        (F.col("l_suppkey") % 100 - 1).alias("expected"),
    )
    weights = lines.select(
        F.col("l_suppkey").alias("out"), F.col("l_partkey").alias("node"),
        F.when(F.col("l_orderkey") % 7 == 0, float("nan")).otherwise(F.col("l_tax")).alias("weight"),
    )
    return report(rulesets.control_report(held), rulesets.operator_report(weights)).select("rule_id", "failed")


@query("""
WITH t AS (SELECT o_orderkey AS k FROM orders)
SELECT 'series_id_matches_spec' AS rule_id, count(*) FILTER (k % 7 = 0) AS failed FROM t
UNION ALL SELECT 'dates_ordered', count(*) FILTER (k % 11 = 0) FROM t
UNION ALL SELECT 'dates_aligned', count(*) FILTER (k % 13 = 0) FROM t
UNION ALL SELECT 'assets_distinct', count(*) FILTER (k % 17 = 0) FROM t
UNION ALL SELECT 'digest_form', count(*) FILTER (k % 19 = 0) FROM t
UNION ALL SELECT 'series_units', count(*) FILTER (k % 23 = 0) FROM t
""")
def reviewed_series_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    first = F.when(k % 11 == 0, F.lit("2024-02-01")).otherwise(F.lit("2020-01-01")).cast("date")
    rows = table(spark, sf_dir, "orders").select(
        F.lit("s").alias("series_id"), F.when(k % 7 == 0, "z").otherwise("s").alias("spec_series_id"), F.lit("MONTHLY").alias("frequency"),
        F.when(k % 13 == 0, F.date_add(first, 1)).otherwise(first).alias("first_observation"), F.lit("2024-01-01").cast("date").alias("last_observation"),
        F.lit("a").alias("series_source_key"), F.when(k % 17 == 0, "a").otherwise("b").alias("search_source_key"),
        F.when(k % 19 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("digest"), F.lit("fixing").alias("quote_type"),
        F.lit("CLP").alias("source_unit"), F.when(k % 23 == 0, "UF").otherwise("CLP").alias("canonical_unit"),
    )
    return check(rows, [*finance.review_rules(), *finance.spec_rules()]).select("rule_id", "failed")
