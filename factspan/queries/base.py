"""Registry of the example queries, each with the SQL that states its answer.

The tables at hand are general business tables; the recasts below read them as death
events, birth records and pensioner rows, in Spark and in SQL side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL when the answer has one."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql is not None:
            SQL[key] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def rounded(column: Column, digits: int = 6) -> Column:
    return F.round(column.cast("double"), digits)


# fixed values: published labels of the 16 regions, by code
REGION_LABELS = (
    "De Tarapacá",
    "De Antofagasta",
    "De Atacama",
    "De Coquimbo",
    "De Valparaíso",
    "Del Libertador B. O'Higgins",
    "Del Maule",
    "Del Biobío",
    "De La Araucanía",
    "De Los Lagos",
    "De Aisén del Gral. C. Ibáñez del Campo",
    "De Magallanes y de La Antártica Chilena",
    "Metropolitana de Santiago",
    "De Los Ríos",
    "De Arica y Parinacota",
    "De Ñuble",
)


def region_label(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in REGION_LABELS]), number.cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


REGION_SQL = _sql_list(REGION_LABELS)


# --- death events out of lineitem ----------------------------------------------


def raw_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem read as raw death events, all text, with every kind of gap."""
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line, day = F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    quantity, year = F.col("l_quantity").cast("int"), F.year("l_shipdate")
    region = supp % 16 + 1
    kind = (
        F.when(part % 53 == 0, "")
        .when(part % 20 < 15, "1")
        .when(part % 20 == 15, "2")
        .when(part % 20 == 16, "3")
        .when(part % 20 == 17, "4")
        .otherwise("0")
    )
    count = (
        F.when(kind == "1", quantity * 2 - 1)
        .when(kind == "2", quantity % 12)
        .when(kind == "3", quantity % 32)
        .when(kind == "4", quantity % 25)
        .otherwise(quantity)
    )
    text = lambda c: c.cast("string")
    late_code = F.concat(
        F.char(65 + part % 26),
        F.lpad(text(supp % 100), 2, "0"),
        F.when(part % 11 == 0, "X").otherwise(text(line)),
    )
    code = F.when(order % 71 == 0, "").otherwise(
        F.when(year <= 1996, text(100 + part % 900)).otherwise(late_code)
    )
    return table(spark, sf_dir, "lineitem").select(
        text(year).alias("AÑO"),
        F.when(order % 97 == 0, "").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("FECHA_DEF"),
        F.when(F.col("l_returnflag") == "A", "Hombre")
        .when(F.col("l_returnflag") == "N", "Mujer")
        .otherwise("Indeterminado")
        .alias("SEXO_NOMBRE"),
        kind.alias("EDAD_TIPO"),
        F.when(supp % 41 == 0, "").otherwise(text(count)).alias("EDAD_CANT"),
        F.when(order % 89 == 0, "")
        .when(order % 83 == 0, "99999")
        .otherwise(text(region * 1000 + 101 + part % 40))
        .alias("COD_COMUNA"),
        F.when(((order % 89 == 0) | (order % 83 == 0)) & (order % 2 == 0), "Ignorada")
        .otherwise(region_label(region))
        .alias("NOMBRE_REGION"),
        code.alias("DIAG1"),
        F.concat(F.lit("C"), text(part % 20)).alias("CAPITULO_DIAG1"),
        F.when(part % 29 == 0, " ")
        .otherwise(F.concat(F.lit("G"), text(part % 40)))
        .alias("CODIGO_GRUPO_DIAG1"),
        F.concat(F.lit("K"), text(part % 60)).alias("CODIGO_CATEGORIA_DIAG1"),
        F.concat(F.lit("S"), text(part % 80)).alias("CODIGO_SUBCATEGORIA_DIAG1"),
        F.when(part % 3 == 0, "")
        .when(part % 3 == 1, F.when(part % 2 == 0, "xxx1").otherwise(" "))
        .otherwise(F.concat(F.lit("W"), F.lpad(text(part % 100), 2, "0"), F.lit("X")))
        .alias("DIAG2"),
    )


RAW_DEATHS = f"""
raw_deaths AS (
  SELECT CAST(y AS VARCHAR) AS anio,
         CASE WHEN l_orderkey % 97 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS fecha,
         CASE l_returnflag WHEN 'A' THEN 'Hombre' WHEN 'N' THEN 'Mujer'
              ELSE 'Indeterminado' END AS sexo,
         kind AS edad_tipo,
         CASE WHEN l_suppkey % 41 = 0 THEN '' ELSE CAST(CASE kind
              WHEN '1' THEN q * 2 - 1 WHEN '2' THEN q % 12 WHEN '3' THEN q % 32
              WHEN '4' THEN q % 25 ELSE q END AS VARCHAR) END AS edad_cant,
         CASE WHEN l_orderkey % 89 = 0 THEN '' WHEN l_orderkey % 83 = 0 THEN '99999'
              ELSE CAST(r * 1000 + 101 + l_partkey % 40 AS VARCHAR) END AS comuna,
         CASE WHEN (l_orderkey % 89 = 0 OR l_orderkey % 83 = 0) AND l_orderkey % 2 = 0
              THEN 'Ignorada' ELSE ({REGION_SQL})[r] END AS nombre_region,
         CASE WHEN l_orderkey % 71 = 0 THEN ''
              WHEN y <= 1996 THEN CAST(100 + l_partkey % 900 AS VARCHAR)
              ELSE chr(CAST(65 + l_partkey % 26 AS INTEGER))
                   || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0')
                   || CASE WHEN l_partkey % 11 = 0 THEN 'X'
                           ELSE CAST(l_linenumber AS VARCHAR) END END AS diag1,
         'C' || CAST(l_partkey % 20 AS VARCHAR) AS chapter,
         CASE WHEN l_partkey % 29 = 0 THEN ' '
              ELSE 'G' || CAST(l_partkey % 40 AS VARCHAR) END AS grupo,
         CASE l_partkey % 3 WHEN 0 THEN ''
              WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'xxx1' ELSE ' ' END
              ELSE 'W' || lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || 'X' END AS diag2
  FROM (SELECT *, year(l_shipdate) AS y, CAST(l_quantity AS INTEGER) AS q,
               CAST(l_suppkey % 16 + 1 AS INTEGER) AS r,
               CASE WHEN l_partkey % 53 = 0 THEN '' WHEN l_partkey % 20 < 15 THEN '1'
                    WHEN l_partkey % 20 = 15 THEN '2' WHEN l_partkey % 20 = 16 THEN '3'
                    WHEN l_partkey % 20 = 17 THEN '4' ELSE '0' END AS kind
        FROM lineitem)
),
deaths AS (
  SELECT *, CAST(anio AS INTEGER) AS event_year,
         CASE WHEN fecha <> '' THEN CAST(fecha AS DATE) END AS event_date,
         CASE WHEN comuna IN ('', '99999') THEN
                CASE WHEN nombre_region = 'Ignorada' THEN 'unknown'
                     ELSE 'CL-' || lpad(CAST(list_position({REGION_SQL}, nombre_region) AS VARCHAR),
                                        2, '0') END
              ELSE 'CL-' || substr(lpad(comuna, 5, '0'), 1, 2) END AS region,
         CASE sexo WHEN 'Hombre' THEN 'male' WHEN 'Mujer' THEN 'female'
              ELSE 'indeterminate' END AS sex,
         (edad_tipo = '1' AND edad_cant <> '') AS in_years,
         (edad_tipo IN ('2', '3', '4') AND edad_cant <> '') AS below_one
  FROM raw_deaths
)
"""


# --- birth records out of orders -----------------------------------------------

# fixed values: published maternal age groups
MATERNAL_LABELS = (
    "Menores 15 años",
    "15 a 19 años",
    "20 a 24 años",
    "25 a 29 años",
    "30 a 34  años",
    "35 A 39 AÑOS",
    "40 a 44 años",
    "45 a 49 años",
    "50 o más años",
    "No especificado",
)


def raw_births(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """orders read as raw birth records, all text; ``keep`` passes order columns on."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    region = customer % 17 + 1
    labels = F.array(*[F.lit(label) for label in MATERNAL_LABELS])
    priority = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        *keep,
        text(F.year("o_orderdate")).alias("ANO_NAC"),
        F.when(order % 61 == 0, "").otherwise(text(F.month("o_orderdate"))).alias("MES_NAC"),
        F.when(priority.isin("1", "2"), "1")
        .when(priority.isin("3", "4"), "2")
        .otherwise("9")
        .alias("SEXO"),
        F.element_at(labels, (order % 10 + 1).cast("int")).alias("GRUPO_ETARIO_MADRE"),
        F.element_at(F.array(*[F.lit(x) for x in ("C", "E", "N", "e", "")]),
                     (order % 5 + 1).cast("int")).alias("NACIONALIDAD_MADRE"),
        F.when(region == 17, "99").otherwise(text(region)).alias("REGION_RESIDENCIA"),
        F.when(region == 17, "Ignorada")
        .otherwise(region_label(F.least(region, F.lit(16))))
        .alias("GLOSA_REGION_RESIDENCIA"),
    )


BIRTHS = """
births AS (
  SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m,
         o_orderkey % 61 = 0 AS no_month,
         CASE WHEN o_orderkey % 61 = 0 THEN make_date(year(o_orderdate), 1, 1)
              ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS period_start,
         CASE WHEN o_orderkey % 61 = 0 THEN make_date(year(o_orderdate) + 1, 1, 1)
              ELSE CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) END
              AS period_end,
         CASE WHEN o_orderkey % 61 = 0 THEN 'birth_occurrence_year_when_month_missing'
              ELSE 'birth_occurrence_month' END AS date_basis,
         CASE WHEN o_orderkey % 10 = 9 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0.0
              ELSE CAST(10 + 5 * (o_orderkey % 10) AS DOUBLE) END AS age_lower,
         CASE WHEN o_orderkey % 10 >= 8 THEN NULL
              ELSE CAST(15 + 5 * (o_orderkey % 10) AS DOUBLE) END AS age_upper,
         o_orderkey % 10 = 8 AS age_open,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'male'
              WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'female'
              ELSE 'indeterminate' END AS sex,
         CASE WHEN o_custkey % 17 = 16 THEN 'unknown'
              ELSE 'CL-' || lpad(CAST(o_custkey % 17 + 1 AS VARCHAR), 2, '0') END AS region,
         CASE o_orderkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'E' WHEN 2 THEN 'N' WHEN 3 THEN 'E'
              ELSE NULL END AS nationality
  FROM orders
)
"""


# --- pensioner rows out of orders ----------------------------------------------


def _int_day(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def raw_pensioners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders read as pensioner rows with integer dates."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    start = F.add_months(F.col("o_orderdate").cast("date"), 12 * 14)
    birth = F.date_sub(F.add_months(start, -12 * 60), (customer % 9000).cast("int"))
    birth = F.date_add(birth, 4000)
    death = F.date_add(start, (order % 4000).cast("int"))
    end = F.date_add(start, (customer % 5000).cast("int"))
    route = order % 7
    return table(spark, sf_dir, "orders").select(
        F.lit(1).alias("ORIGEN"),
        F.when(route < 3, route + 1).otherwise(4).cast("int").alias("TABLA"),
        _int_day(start).alias("FEC_VIG"),
        F.when(customer % 4 == 0, _int_day(end)).otherwise(99991231).alias("FIN_EXPOSIC"),
        F.when(route.isin(2, 5, 6), "M").otherwise("F").alias("SEXO"),
        F.when(order % 5 == 0, 99).when(order % 5 == 1, 30).otherwise(10).alias("COD_REL"),
        F.when(route < 3, "N").when(route % 2 == 0, "T").otherwise("P").alias("BEN_COD_INV"),
        _int_day(birth).alias("FEC_NAC"),
        F.when(order % 6 == 0, _int_day(death)).otherwise(0).alias("FEC_FALL"),
    )


PENSIONERS = """
pensioners AS (
  SELECT o_orderkey % 7 AS route, o_orderkey % 5 AS rel,
         vig, fin, died, nac,
         CAST(floor((year(vig) - year(nac)) + (month(vig) - month(nac)) / 12.0::DOUBLE
               + (day(vig) - day(nac)) / 365.25::DOUBLE + 0.5) AS BIGINT) AS insured
  FROM (SELECT *, CAST(o_orderdate + INTERVAL 168 MONTH AS DATE) AS vig,
               CAST(CAST(o_orderdate + INTERVAL 168 MONTH AS DATE) - INTERVAL 720 MONTH AS DATE)
                 - CAST(o_custkey % 9000 AS INTEGER) + 4000 AS nac,
               CASE WHEN o_orderkey % 6 = 0
                    THEN CAST(o_orderdate + INTERVAL 168 MONTH AS DATE)
                         + CAST(o_orderkey % 4000 AS INTEGER) END AS died,
               CASE WHEN o_custkey % 4 = 0
                    THEN CAST(o_orderdate + INTERVAL 168 MONTH AS DATE)
                         + CAST(o_custkey % 5000 AS INTEGER) END AS fin
        FROM orders)
),
pension_spells AS (
  SELECT CASE WHEN route = 0 THEN 'B-M-2020' WHEN route = 1 THEN 'RV-M-2020'
              WHEN route = 2 THEN 'CB-H-2020' WHEN route IN (5, 6) THEN 'MI-H-2020'
              ELSE 'MI-M-2020' END AS table_id,
         greatest(greatest(2014, CASE WHEN route IN (4, 6) AND rel = 0 THEN year(vig) + 3
                                      ELSE year(vig) END) - (year(vig) - insured), 0) AS lo,
         least(2018 - (year(vig) - insured), coalesce(death_age, 10000),
               coalesce(year(fin) - (year(vig) - insured) - 1, 10000),
               CASE WHEN rel = 1 AND route < 3 THEN 23 ELSE 10000 END, 110) AS hi,
         death_age
  FROM (SELECT *, CASE WHEN died IS NOT NULL THEN CAST(ceil(insured + (year(died) - year(vig))
                       + (month(died) - month(vig)) / 12.0::DOUBLE
                       + (day(died) - day(vig)) / 365.25::DOUBLE) AS BIGINT) - 1 END AS death_age
        FROM pensioners)
)
"""
