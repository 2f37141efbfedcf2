"""Point-in-time selection and history checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspan.operators import history, release_log
from factspan.queries.base import ntz, query, rounded, table
from factspan.session import new_path

AS_OF = "2024-01-15 00:00:00"


def revisions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", "event_type", "event_id", F.col("ts").alias("available_at"), "value"
    )


@query(f"""
WITH known AS (SELECT user_id, event_type, event_id, ts AS available_at, value,
                      rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r
               FROM events WHERE ts <= TIMESTAMP '{AS_OF}')
SELECT user_id, event_type, max(event_id) AS event_id, max(available_at) AS available_at,
       arg_max(value, event_id) AS value, count(DISTINCT event_id) > 1 AS ambiguous
FROM known WHERE r = 1 GROUP BY user_id, event_type
""")
def latest_as_of(spark, sf_dir):
    """Events by their own clock; where several share the newest one, the fact is flagged."""
    return history.latest_as_of(
        revisions(spark, sf_dir), ntz(AS_OF), ("user_id", "event_type"), "available_at", "event_id", mode="report"
    )


@query(f"""
WITH known AS (SELECT user_id, event_type, event_id, ts AS available_at, value,
                      rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r
               FROM events WHERE ts <= TIMESTAMP '{AS_OF}')
SELECT user_id, event_type, max(event_id) AS event_id, max(available_at) AS available_at,
       arg_max(value, event_id) AS value, count(DISTINCT event_id) > 1 AS ambiguous
FROM known WHERE r = 1 GROUP BY user_id, event_type
""")
def newest_states(spark, sf_dir):
    return history.newest_states(
        revisions(spark, sf_dir), ntz(AS_OF), ("user_id", "event_type"), "available_at", "event_id"
    )


@query("""
WITH known AS (SELECT user_id, event_type, event_id, CAST(ts AS DATE) AS d FROM events
               WHERE CAST(ts AS DATE) <= DATE '2024-01-20'),
newest AS (SELECT user_id, event_type, max(d) AS d FROM known GROUP BY 1, 2)
SELECT k.user_id, k.event_type, k.d AS available_at, count(DISTINCT event_id) AS observations
FROM known k JOIN newest n ON k.user_id = n.user_id AND k.event_type = n.event_type AND k.d = n.d
GROUP BY 1, 2, 3 HAVING count(DISTINCT event_id) > 1
""")
def ambiguous_revisions(spark, sf_dir):
    daily = revisions(spark, sf_dir).withColumn("available_at", F.to_date("available_at"))
    return history.ambiguous_revisions(
        daily,
        F.expr("DATE'2024-01-20'"),
        ("user_id", "event_type"),
        "available_at",
        "event_id",
    )


@query(f"""
WITH latest AS (SELECT CAST(ts AS DATE) AS d FROM events WHERE ts <= TIMESTAMP '{AS_OF}'
  QUALIFY rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1)
SELECT CAST(ts AS DATE) AS release_day, count(*) AS rows FROM events
WHERE CAST(ts AS DATE) IN (SELECT d FROM latest) GROUP BY 1
""")
def contributing_releases(spark, sf_dir):
    events = revisions(spark, sf_dir).withColumn("release_day", F.to_date("available_at"))
    releases = events.groupBy("release_day").agg(F.count(F.lit(1)).alias("rows"))
    newest = history.newest_states(
        events, ntz(AS_OF), ("user_id", "event_type"), "available_at", "event_id"
    )
    return history.contributing_releases(newest, releases, "release_day")


CONFLICTS = """
FROM (SELECT l_orderkey * 3 + l_linenumber % 3 AS observation_id,
             l_orderkey AS fact_id, l_suppkey % 2 AS content, l_returnflag AS key_field
      FROM lineitem)
"""


@query(f"""
SELECT 'observation_id' AS conflict, observation_id AS id {CONFLICTS}
GROUP BY observation_id
HAVING count(DISTINCT (fact_id, content, key_field)) > 1
UNION ALL
SELECT 'fact_id', fact_id {CONFLICTS} GROUP BY fact_id HAVING count(DISTINCT key_field) > 1
""")
def history_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 3 + F.col("l_linenumber") % 3).alias("observation_id"),
        F.col("l_orderkey").alias("fact_id"),
        (F.col("l_suppkey") % 2).alias("content"),
        F.col("l_returnflag").alias("key_field"),
    )
    return history.history_conflicts(rows, ["key_field"])


@query("""
SELECT id, min(payload) AS payload FROM (
  SELECT 'c' || o_custkey AS id, 'customer ' || o_custkey AS payload FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'customer ' || c_custkey FROM customer)
GROUP BY id
""")
def merge_identities(spark, sf_dir):
    def records(df, key):
        return df.select(
            F.concat(F.lit("c"), F.col(key).cast("string")).alias("id"),
            F.concat(F.lit("customer "), F.col(key).cast("string")).alias("payload"),
        )

    return history.merge_identities(
        records(table(spark, sf_dir, "orders"), "o_custkey"),
        records(table(spark, sf_dir, "customer"), "c_custkey"),
    )


@query("""
SELECT l_shipdate::DATE AS release_id, max(l_shipdate + INTERVAL (l_linenumber) DAY)::DATE
         AS available_at, count(*) AS assets
FROM lineitem GROUP BY 1
""")
def release_clocks(spark, sf_dir):
    assets = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("release_id"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("available_at"),
    )
    return history.manifests(assets)


@query("""
SELECT user_id, event_type, round(sum(value), 4) AS value FROM (
  SELECT user_id, event_type, value FROM events WHERE event_type <> 'error'
  UNION ALL
  SELECT user_id, event_type, -value FROM events WHERE event_type = 'error')
GROUP BY 1, 2
""")
def strict_union(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    kept = events.where("event_type <> 'error'")
    turned = events.where("event_type = 'error'").withColumn("value", -F.col("value"))
    both = history.strict_union(kept, turned)
    return both.groupBy("user_id", "event_type").agg(rounded(F.sum("value"), 4).alias("value"))


# --- a history written out in releases and read back ----------------------------


def event_history(spark, sf_dir) -> DataFrame:
    """Every event as a state of the fact (user, type), one release per day."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("domain"),
        F.date_format("ts", "yyyy-MM-dd").alias("release_id"),
        F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("observation_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("fact_id"),
        F.expr("timestampadd(MICROSECOND, event_id, ts)").alias("available_at"),
        "value",
    )


def written_history(spark, sf_dir) -> tuple[str, DataFrame]:
    """The history appended in two parts, the first of them twice, and one append that was killed."""
    path, rows = new_path(spark, "release-log"), event_history(spark, sf_dir)
    first = F.pmod(F.xxhash64("observation_id"), F.lit(2)) == 0
    for part in (rows.where(first), rows.where(first), rows.where(~first)):
        history.append_release(part, path)
    changed = rows.withColumn("value", F.col("value") + 1).withColumn("observation_id", F.concat("observation_id", F.lit("x")))
    changed.write.partitionBy(*release_log.LAYOUT).parquet(release_log.folder(path, "killed"))
    return path, rows


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS release_id, count(*) AS states, count(DISTINCT (user_id, event_type)) AS facts,
       round(sum(value), 4) AS value, max(ts + to_microseconds(event_id)) AS available_at
FROM events GROUP BY 1
""")
def release_log_totals(spark, sf_dir):
    path, rows = written_history(spark, sf_dir)
    return history.read_history(spark, path, rows.schema).groupBy("release_id").agg(
        F.count(F.lit(1)).alias("states"), F.count_distinct("fact_id").alias("facts"),
        rounded(F.sum("value"), 4).alias("value"), F.max("available_at").alias("available_at"),
    )


@query(f"""
WITH states AS (SELECT user_id || '/' || event_type AS fact_id, 'o' || event_id AS observation_id,
                       strftime(ts, '%Y-%m-%d') AS release_id, ts + to_microseconds(event_id) AS available_at FROM events)
SELECT fact_id, observation_id, release_id, available_at FROM states WHERE available_at <= TIMESTAMP '{AS_OF}'
QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY available_at DESC) = 1
""")
def release_log_as_of(spark, sf_dir):
    path, rows = written_history(spark, sf_dir)
    states = history.latest_as_of(history.read_history(spark, path, rows.schema), ntz(AS_OF))
    return states.select("fact_id", "observation_id", "release_id", "available_at")


@query(f"""
WITH chosen AS (SELECT user_id || '/' || event_type AS fact_id, 'o' || event_id AS observation_id,
                       strftime(ts, '%Y-%m-%d') AS release_id FROM events WHERE ts + to_microseconds(event_id) <= TIMESTAMP '{AS_OF}'
                QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts + to_microseconds(event_id) DESC) = 1)
SELECT fact_id AS id, 'fact' AS payload FROM chosen UNION SELECT observation_id, 'observation' FROM chosen
UNION SELECT release_id, 'release' FROM chosen
""")
def selected_identities(spark, sf_dir):
    rows = event_history(spark, sf_dir)
    kinds = {"fact_id": "fact", "observation_id": "observation", "release_id": "release"}
    records = [rows.select(F.col(c).alias("id"), F.lit(kind).alias("payload")) for c, kind in kinds.items()]
    snapshot = history.merge_identities(records[0], history.strict_union(*records[1:]))
    return history.minimal_identities(history.latest_as_of(rows, ntz(AS_OF)), snapshot)
