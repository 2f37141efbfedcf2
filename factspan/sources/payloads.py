"""Strict JSON payloads: market series, series metadata, published deviations.

A payload is one document; its rows come out by ``inline``/``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.functions import dates
from factspan.functions.structures import exact_object
from factspan.functions.text import same_description
from factspan.operators.rules import Rule, check, check_absent, check_unique, require

# fixed values: documented field names
ROOT_FIELDS = ("Codigo", "Descripcion", "Series", "SeriesInfos")
SERIES_FIELDS = ("descripEsp", "descripIng", "seriesId", "Obs")
OBSERVATION_FIELDS = ("indexDateString", "value", "statusCode")
INFO_FIELDS = (
    "seriesId",
    "frequencyCode",
    "spanishTitle",
    "englishTitle",
    "firstObservation",
    "lastObservation",
    "updatedAt",
    "createdAt",
)
DEVIATION_ROOT = (
    "schema_version",
    "descriptor_source_key",
    "descriptor_sha256",
    "matrix_convention",
    "table_order",
    "age_start",
    "age_end",
    "statistics",
    "rows",
)
DEVIATION_ROW = ("table_id", "age", "delta_exposed", "delta_deaths")
DECIMAL = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
STATUS = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"
ROOT = "Codigo INT, Descripcion STRING, Series STRING, SeriesInfos ARRAY<STRING>"
STRICT = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document: path and raw text."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


def _root_rules(raw: Column, code: Column, note: Column) -> list[Rule]:
    return [
        Rule("root_fields_exact", exact_object(raw, ROOT_FIELDS)),
        Rule("code_is_zero", code == 0),
        Rule("note_nonblank", note.rlike(r"\S")),
    ]


def parse_series(documents: DataFrame, contract: DataFrame) -> DataFrame:
    """Observations of every series document: (series_id, observed_on, published, status_code).

    ``contract`` has one row per series: series_id, frequency, spanish_title,
    english_title, first_observation, last_observation. Any breach fails the call.
    """
    series = "descripEsp STRING, descripIng STRING, seriesId STRING, Obs ARRAY<STRING>"
    root = documents.withColumn("root", F.from_json("raw", ROOT, STRICT)).withColumn(
        "series", F.from_json("root.Series", series, STRICT)
    )
    heads = root.join(
        contract.withColumnRenamed("series_id", "__id"),
        F.col("series.seriesId") == F.col("__id"),
        "left",
    )
    rules = [
        *_root_rules(F.col("raw"), F.col("root.Codigo"), F.col("root.Descripcion")),
        Rule("infos_empty", F.size("root.SeriesInfos") == 0),
        Rule("series_fields_exact", exact_object(F.col("root.Series"), SERIES_FIELDS)),
        Rule("series_known", F.col("__id").isNotNull()),
        Rule(
            "spanish_title",
            same_description(F.col("series.descripEsp"), F.col("spanish_title")),
        ),
        Rule(
            "english_title",
            same_description(F.col("series.descripIng"), F.col("english_title")),
        ),
        Rule("has_observations", F.size("series.Obs") > 0),
    ]
    require(check(heads, rules))
    items = heads.select(
        F.col("__id").alias("series_id"),
        "frequency",
        "first_observation",
        "last_observation",
        F.explode("series.Obs").alias("item"),
    )
    body = F.from_json("item", "indexDateString STRING, value STRING, statusCode STRING", STRICT)
    parsed = items.withColumn("o", body).withColumns(
        {
            "observed_on": dates.strict_dmy(F.col("o.indexDateString")),
            "status_code": F.col("o.statusCode"),
        }
    )
    present = (F.col("status_code") == "OK") & F.col("o.value").rlike(r"\S")
    number = F.when(F.col("o.value").rlike(DECIMAL), F.col("o.value").try_cast("double"))
    aligned = F.lit(False)
    for frequency in ("DAILY", *dates.FREQUENCY_MONTHS):
        end = dates.frequency_end(F.col("observed_on"), frequency)
        aligned = F.when(F.col("frequency") == frequency, end.isNotNull()).otherwise(aligned)
    rows = [
        Rule("observation_fields_exact", exact_object(F.col("item"), OBSERVATION_FIELDS)),
        Rule("date_valid", F.col("observed_on").isNotNull()),
        Rule("date_aligned", aligned),
        Rule(
            "date_in_bounds",
            F.col("observed_on").between(F.col("first_observation"), F.col("last_observation")),
        ),
        Rule("status_token", F.col("status_code").rlike(STATUS)),
        Rule("value_is_text", F.col("item").rlike(r'"value"\s*:\s*"')),
        Rule(
            "value_decimal",
            ~present | (number.isNotNull() & (F.abs(number) < F.lit(float("inf")))),
        ),
    ]
    require(
        check(parsed, rows),
        check_unique(parsed, ["series_id", "observed_on"], "date_unique"),
    )
    return parsed.select(
        "series_id", "observed_on", F.when(present, number).alias("published"), "status_code"
    )


def parse_series_metadata(documents: DataFrame, contract: DataFrame) -> DataFrame:
    """Metadata rows of search documents that match the contract, each exactly once."""
    root = documents.withColumn("root", F.from_json("raw", ROOT, STRICT))
    fields = ", ".join(f"{f} STRING" for f in INFO_FIELDS)
    infos = root.select("path", F.explode("root.SeriesInfos").alias("item")).withColumn(
        "i", F.from_json("item", fields, STRICT)
    )
    wanted = contract.select("series_id", "frequency", "spanish_title", "english_title",
                             "first_observation", "last_observation", "updated_on", "created_on")
    found = infos.join(wanted, F.col("i.seriesId") == F.col("series_id"))
    agrees = (
        (F.col("i.frequencyCode") == F.col("frequency"))
        & (F.col("i.spanishTitle") == F.col("spanish_title"))
        & (F.col("i.englishTitle") == F.col("english_title"))
        & (dates.strict_dmy(F.col("i.firstObservation")) == F.col("first_observation"))
        & (dates.strict_dmy(F.col("i.lastObservation")) == F.col("last_observation"))
        & (dates.strict_dmy(F.col("i.updatedAt")) == F.col("updated_on"))
        & (dates.strict_dmy(F.col("i.createdAt")) == F.col("created_on"))
    )
    dummy_null = F.forall(
        F.array(*[F.get_json_object("root.Series", f"$.{f}").isNull() for f in SERIES_FIELDS]),
        lambda x: x,
    )
    unmatched = wanted.join(
        found.select("series_id").distinct(), "series_id", "left_anti"
    )
    require(
        check(
            root,
            [
                *_root_rules(F.col("raw"), F.col("root.Codigo"), F.col("root.Descripcion")),
                Rule("dummy_series_fields", exact_object(F.col("root.Series"), SERIES_FIELDS)),
                Rule("dummy_series_null", dummy_null),
            ],
        ),
        check(infos, [Rule("info_fields_exact", exact_object(F.col("item"), INFO_FIELDS))]),
        check(found, [Rule("metadata_agrees", agrees)]),
        check_unique(found, ["series_id"], "series_matched_once"),
        check_absent(unmatched, "series_matched"),
    )
    return found.select(*wanted.columns)


def parse_deviations(
    documents: DataFrame, tables: tuple[str, ...], ages: tuple[int, int] = (0, 110)
) -> DataFrame:
    """Published deviations (table_id, age, delta_exposed, delta_deaths) on a complete grid."""
    rows = documents.select(
        F.explode(F.from_json("raw", "rows ARRAY<STRING>", STRICT)["rows"]).alias("item")
    )
    body = F.from_json(
        "item", "table_id STRING, age INT, delta_exposed BIGINT, delta_deaths BIGINT", STRICT
    )
    parsed = rows.withColumn("r", body)
    flat = parsed.select("r.*")
    grid = (
        documents.select(F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_id"))
        .distinct()
        .withColumn("age", F.explode(F.sequence(F.lit(ages[0]), F.lit(ages[1]))))
    )
    missing = grid.join(flat, ["table_id", "age"], "left_anti")
    extra = flat.join(grid, ["table_id", "age"], "left_anti")
    whole = F.col("r.age").isNotNull() & F.col("r.delta_exposed").isNotNull() & F.col(
        "r.delta_deaths"
    ).isNotNull()
    require(
        check(documents, [Rule("root_fields_exact", exact_object(F.col("raw"), DEVIATION_ROOT))]),
        check(
            parsed,
            [
                Rule("row_fields_exact", exact_object(F.col("item"), DEVIATION_ROW)),
                Rule("row_numbers_whole", whole),
            ],
        ),
        check_unique(flat, ["table_id", "age"], "cell_unique"),
        check_absent(missing.unionByName(extra.select(*missing.columns)), "grid_complete"),
    )
    return flat
