from __future__ import annotations

import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factspan import contracts as C
from factspan.operators.reconcile import null_safe_join
from factspan.operators.rules import ContractViolation, check
from factspan.plans import batch, births, controls, deaths, finance, stocks
from factspan.plans.batch import Release
from factspan.sources import files, payloads

RELEASE = Release("main_file", "v1", datetime(2025, 2, 2), (("main_file", "b" * 64),),
                  released_at=date(2025, 2, 1))
PROVISIONAL = Release("main_file", "v1", datetime(2025, 2, 2), (("main_file", "b" * 64),),
                      released_at=date(2025, 2, 1), provisional=True)


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


# --- deaths --------------------------------------------------------------------

DEATH = {
    "AÑO": "2024", "FECHA_DEF": "2024-02-03", "SEXO_NOMBRE": "Mujer", "EDAD_TIPO": "1",
    "EDAD_CANT": "99", "COD_COMUNA": "8111", "COMUNA": "Tomé", "NOMBRE_REGION": "Del Bíobío",
    "DIAG1": "I64X", "CAPITULO_DIAG1": "I00-I99", "CODIGO_GRUPO_DIAG1": "I60-I69",
    "CODIGO_CATEGORIA_DIAG1": "I64", "CODIGO_SUBCATEGORIA_DIAG1": "I64X",
}


def death_file(folder, *changes, columns=files.DEATH_COLUMNS):
    lines = [";".join(columns)]
    for change in changes:
        row = {**DEATH, **change}
        lines.append(";".join(row.get(c, "") for c in columns))
    return write(folder / "deaths.csv", "\n".join(lines) + "\n", "windows-1252")


def run_deaths(spark, path, release=RELEASE, grain=None, cutoff=date(2024, 12, 31), **kw):
    raw = files.scan_deaths(spark, path)
    return deaths.normalise(raw, release, grain or deaths.Grain(), date(2023, 1, 1), cutoff, **kw)


def test_deaths_from_file_to_facts(spark, tmp_path):
    path = death_file(
        tmp_path, {}, {}, {"SEXO_NOMBRE": "Indeterminado"}, {"FECHA_DEF": ""},
        {"COD_COMUNA": "", "NOMBRE_REGION": "Ignorada"}, {"EDAD_TIPO": "2", "EDAD_CANT": "3"},
        {"DIAG1": "", "CODIGO_GRUPO_DIAG1": " ", "DIAG2": "XXX1"},
    )
    grain = deaths.Grain("month", "source_reported", "commune", "group", True, True)
    facts = run_deaths(spark, path, grain=grain,
                       totals={"raw_rows": 7, "age_99_year_deaths": 6, "blank_communes": 1},
                       pairs={"year": {"2024": 7}, "sex": {"Mujer": 6}})
    assert facts.columns == C.domain_schema("demographic").fieldNames()
    got = {(r["date_basis"], r["sex"], r["region"], r["cause"], r["age_quantity"]): r
           for r in facts.collect()}
    assert sum(r["value"] for r in got.values()) == 7
    plain = got["death_occurrence", "female", "CL-08", "I60-I69", 99.0]
    assert plain["value"] == 2
    assert plain["commune"] == "08111"
    assert plain["period_end"] == date(2024, 3, 1)
    assert json.loads(plain["missingness_reason"]) == {
        "registration_window": "not_available_in_current_deis_file"}
    undated = got[deaths.YEAR_ONLY, "female", "CL-08", "I60-I69", 99.0]
    assert (undated["period_start"], undated["period_end"]) == (date(2024, 1, 1), date(2025, 1, 1))
    assert "occurrence_date" in undated["missingness_reason"]
    lost = got["death_occurrence", "female", "unknown", "I60-I69", 99.0]
    assert {"residence_region", "residence_commune"} <= set(json.loads(lost["missingness_reason"]))
    uncoded = got["death_occurrence", "female", "CL-08", "unknown", 99.0]
    assert uncoded["external_cause"] == "unknown_not_coded"
    assert batch.identifier_report(facts, "demographic", {"source_key": "main_file"}).where(
        "failed > 0").count() == 0


def test_facts_keep_their_id_across_releases(spark, tmp_path):
    path = death_file(tmp_path, {})
    later = Release("main_file", "v2", datetime(2026, 1, 1), (("main_file", "c" * 64),),
                    released_at=date(2026, 1, 1))
    a, b = (run_deaths(spark, path, r).first() for r in (RELEASE, later))
    assert a["fact_id"] == b["fact_id"]
    assert a["observation_id"] != b["observation_id"]
    assert a["release_id"] != b["release_id"]


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"AÑO": "24"}, "year_form"),
        ({"FECHA_DEF": "2024-02-30"}, "date_valid"),
        ({"FECHA_DEF": "2023-02-03"}, "date_in_year"),
        ({"SEXO_NOMBRE": "mujer"}, "sex_known"),
        ({"EDAD_TIPO": "7"}, "age_type_known"),
        ({"EDAD_TIPO": "2", "EDAD_CANT": "12"}, "age_count_range"),
        ({"EDAD_CANT": "x"}, "age_count_range"),
        ({"COD_COMUNA": "123456"}, "commune_form"),
        ({"DIAG1": "123"}, "cause_matches_era"),
        ({"AÑO": "2025", "FECHA_DEF": "2025-01-01"}, "inside_coverage"),
        ({"NOMBRE_REGION": "De Los Lagos"}, "region_agrees_with_commune"),
    ],
)
def test_bad_death_rows_stop_the_file(spark, tmp_path, change, rule):
    with pytest.raises(ContractViolation, match=rule):
        run_deaths(spark, death_file(tmp_path, {}, change))


def test_controls_and_clip(spark, tmp_path):
    path = death_file(tmp_path, {"FECHA_DEF": "2024-07-04"}, {"FECHA_DEF": ""})
    with pytest.raises(ContractViolation, match="release_controls"):
        run_deaths(spark, path, totals={"raw_rows": 3})
    with pytest.raises(ContractViolation, match="release_controls"):
        run_deaths(spark, path, pairs={"year": {"2023": 0}})
    facts = run_deaths(spark, path, PROVISIONAL, deaths.Grain("month"), date(2024, 7, 7))
    assert {r["period_end"] for r in facts.collect()} == {date(2024, 7, 8)}
    bounds = deaths.bounds(files.scan_deaths(spark, path), date(2024, 7, 7)).first()
    assert tuple(bounds) == (date(2024, 1, 1), date(2024, 7, 7))


def test_every_grain_keeps_the_total(spark, tmp_path):
    raw = files.scan_deaths(spark, death_file(tmp_path, {}, {"DIAG1": ""}, {"FECHA_DEF": ""}))
    for grain in (deaths.Grain(), deaths.Grain("day", "all", "national", "all", False),
                  deaths.Grain("month", "completed_year", "commune", "subcategory", True, True)):
        facts = deaths.count_facts(raw, grain, date(2024, 12, 31))
        assert facts.agg(F.sum("value")).first()[0] == 3
    with pytest.raises(ValueError):
        deaths.Grain(temporal="week")


def test_header_is_exact(spark, tmp_path):
    swapped = (files.DEATH_COLUMNS[1], files.DEATH_COLUMNS[0], *files.DEATH_COLUMNS[2:])
    path = death_file(tmp_path, {}, columns=swapped)
    with pytest.raises(Exception):
        files.scan_deaths(spark, path).collect()
    found = files.header_of(spark, path, ";", "windows-1252")
    with pytest.raises(ContractViolation, match="header"):
        files.require_header(found, files.DEATH_COLUMNS)


def test_provenance(spark, tmp_path):
    raw = files.scan_deaths(spark, death_file(tmp_path, {}))
    row = deaths.provenance(raw, RELEASE, deaths.Grain(), date(2024, 12, 31))
    from factspan.operators.rulesets import provenance_rules

    assert check(row, provenance_rules()).where("failed > 0").count() == 0
    got = row.first()
    assert (got["observation_start"], got["observation_end"]) == (date(2024, 2, 3), date(2024, 2, 4))
    merged = batch.merged_provenance(row.unionAll(row), ["release_id"], "divide", "rate-v1").first()
    assert merged["aggregation_rules"][-1] == "divide"
    assert merged["transformation_ids"] == [deaths.TRANSFORMATION, "rate-v1"]
    other = row.withColumn("sources", F.transform(
        "sources", lambda s: s.withField("sha256", F.lit("d" * 64))))
    assert batch.conflicting_sources(row.unionAll(row)).count() == 0
    assert batch.conflicting_sources(row.unionAll(other)).count() == 1
    assets = batch.provenance_assets(row)
    assert {r["status"] for r in batch.evidence_status(assets, assets).collect()} == {"equal"}


# --- births --------------------------------------------------------------------

BIRTH = {
    "MES_NAC": "2", "ANO_NAC": "2022", "SEXO": "1", "GRUPO_ETARIO_MADRE": "20 a 24 años",
    "NACIONALIDAD_MADRE": "C", "REGION_RESIDENCIA": "8",
    "GLOSA_REGION_RESIDENCIA": "Del Biobío",
}


def birth_file(path, *changes, columns=files.BIRTH_COLUMNS_25, bom=True):
    lines = [";".join(columns)]
    for change in changes:
        row = {**BIRTH, **change}
        lines.append(";".join(row.get(c, "") for c in columns))
    return write(path, ("﻿" if bom else "") + "\n".join(lines) + "\n")


SPAN = (date(2022, 1, 1), date(2022, 12, 31))


def test_births_from_file_to_facts(spark, tmp_path):
    path = birth_file(
        tmp_path / "b.csv", {}, {}, {"MES_NAC": ""}, {"NACIONALIDAD_MADRE": "e"},
        {"NACIONALIDAD_MADRE": ""}, {"GRUPO_ETARIO_MADRE": "No especificado"},
        {"REGION_RESIDENCIA": "99", "GLOSA_REGION_RESIDENCIA": "Ignorada"},
    )
    raw = files.scan_births(spark, path)
    facts = births.normalise(raw, RELEASE, *SPAN, "dpa-2019",
                             totals={"raw_rows": 7, "lowercase_nationality_codes": 1,
                                     "blank_birth_months": 1, "unknown_maternal_age_groups": 1,
                                     "unknown_residence_regions": 1,
                                     "distinct_known_residence_regions": 1},
                             pairs={"year": {"2022": 7}, "sex": {"1": 7}})
    got = facts.collect()
    assert sum(r["value"] for r in got) == 7
    assert max(r["value"] for r in got) == 2
    assert {r["nationality"] for r in got} == {"C", "E", None}
    assert {r["transformation_id"] for r in got} == {births.SUM_TRANSFORMATION}
    blank = next(r for r in got if "birth_month" in r["missingness_reason"])
    assert (blank["period_start"], blank["period_end"]) == (date(2022, 1, 1), date(2023, 1, 1))


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"ANO_NAC": "2021"}, "year_in_coverage"),
        ({"MES_NAC": "13"}, "month_valid"),
        ({"SEXO": "3"}, "sex_known"),
        ({"GRUPO_ETARIO_MADRE": "16 a 20 años"}, "maternal_age_known"),
        ({"NACIONALIDAD_MADRE": "X"}, "nationality_known"),
        ({"GLOSA_REGION_RESIDENCIA": "Del Maule"}, "region_agrees"),
    ],
)
def test_bad_birth_rows_stop_the_file(spark, tmp_path, change, rule):
    raw = files.scan_births(spark, birth_file(tmp_path / "b.csv", {}, change))
    with pytest.raises(ContractViolation, match=rule):
        births.normalise(raw, RELEASE, *SPAN, "dpa-2019")


def test_sidecar_rows_are_numbered_in_file_order(spark, tmp_path):
    rows = [{"HIJ_VIVOS": str(i)} for i in range(400)]
    path = birth_file(tmp_path / "b.csv", *rows, columns=files.BIRTH_COLUMNS_29, bom=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        sidecar = files.child_sidecar(spark, path, "profile_2001_2019")
        got = sidecar.orderBy("archive_row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["archive_row_number"] for r in got] == list(range(1, 401))
    assert [r["HIJ_VIVOS"] for r in got] == [str(i) for i in range(400)]


def test_shards_merge_to_the_whole(spark, tmp_path):
    rows = [{"MES_NAC": str(i % 12 + 1), "NACIONALIDAD_MADRE": "" if i % 3 else "C"}
            for i in range(50)]
    path = birth_file(tmp_path / "b.csv", *rows, bom=False)
    numbered = files.number_rows(files.scan_with_position(spark, path, files.BIRTH_COLUMNS_25, "a"))
    shards = births.shard_payloads(numbered, RELEASE, "dpa-2019", 20)
    assert {r[0].split("rows ")[1].split(";")[0]
            for r in shards.select("aggregation_rule").distinct().collect()} == {
        "1-20", "21-40", "41-50"}
    merged = births.aggregate_shards(shards)
    whole = births.count_facts(files.scan_births(spark, path))
    key = list(births.CANONICAL_KEY)
    both = null_safe_join(merged.select(*key, F.col("value").alias("a")),
                          whole.select(*key, F.col("value").alias("b")), key, "full_outer")
    assert both.where("a IS NULL OR b IS NULL OR a <> b").count() == 0
    mixed = shards.unionAll(shards.withColumn("vintage", F.lit("other")))
    with pytest.raises(ContractViolation, match="one_release"):
        births.aggregate_shards(mixed)


# --- controls ------------------------------------------------------------------

CONTROL = ("year int, month int, sex string, region string, geography_vintage string, "
           "births bigint")


def test_birth_controls_reconcile(spark, tmp_path):
    table = spark.createDataFrame([(2022, 2, "male", "CL-08", "dpa-2019", 3),
                                   (2022, 2, "female", "CL-08", "dpa-2019", 4)], CONTROL)
    published = controls.controls(table, PROVISIONAL, "coyuntural_monthly", date(2022, 1, 1),
                                  date(2023, 1, 1))
    counted = published.withColumns({
        "observation_role": F.lit("observed_fact"), "parity_scope": F.lit("unknown_order"),
        "value": F.when(F.col("sex") == "male", 3.0).otherwise(9.0)})
    got = {r["sex"]: (r["difference"], r["status"]) for r in
           controls.compare_births(counted, published, "coyuntural_monthly").collect()}
    assert got == {"male": (0.0, "matched_coyuntural"), "female": (5.0, "different_coyuntural")}
    with pytest.raises(ContractViolation, match="same_key_set"):
        controls.compare_births(counted.where("sex = 'male'"), published, "coyuntural_monthly")
    with pytest.raises(ContractViolation, match="basis_matches_kind"):
        controls.compare_births(counted, published, "provisional_annual")


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        ((2022, None, "male", "CL", None, 1), "month_state"),
        ((2022, 13, "male", "CL", None, 1), "month_state"),
        ((2022, 1, "boy", "CL", None, 1), "sex_known"),
        ((2022, 1, "male", "CL-17", "v", 1), "region_known"),
        ((2022, 1, "male", "CL-16", None, 1), "vintage_state"),
        ((2022, 1, "male", "CL", None, -1), "births_nonnegative"),
        ((2024, 1, "male", "CL", None, 1), "inside_coverage"),
    ],
)
def test_bad_control_rows(spark, row, rule):
    table = spark.createDataFrame([row], CONTROL)
    with pytest.raises(ContractViolation, match=rule):
        controls.controls(table, PROVISIONAL, "coyuntural_monthly", date(2022, 1, 1), date(2023, 1, 1))


# --- stocks --------------------------------------------------------------------


def test_census(spark):
    table = spark.createDataFrame(
        [("0 a 4", 3, 1, 2, 2024), ("85 o más", 7, 3, 4, 2024)],
        "age_group string, population_total bigint, population_male bigint, "
        "population_female bigint, census_year int")
    facts = stocks.census(table, RELEASE)
    assert facts.count() == 6
    assert {(r["sex"], r["age_lower"]): r["value"] for r in facts.collect()}["all", 85.0] == 7.0
    wrong = table.withColumn("population_total", F.lit(9).cast("bigint"))
    with pytest.raises(ContractViolation, match="total_is_male_plus_female"):
        stocks.census(wrong, RELEASE)
    overlap = table.withColumn("age_group", F.lit("0 a 4"))
    with pytest.raises(ContractViolation, match="age_groups_disjoint"):
        stocks.census(overlap, RELEASE)


def test_population(spark):
    columns = "year int, age string, sex string, population double"
    table = spark.createDataFrame(
        [(2020, "0", "Hombres", 5.0), (2020, "1", "hombre", 6.0), (2020, "85 o más", "Hombre", 7.0),
         (2060, "0", "Ambos sexos", 9.0)], columns)
    got = {(r["period_start"], r["age_lower"], r["sex"]): r for r in
           stocks.population(table, RELEASE, 2024).collect()}
    assert got[date(2020, 6, 30), 0.0, "male"]["observation_role"] == "observed_fact"
    assert got[date(2060, 6, 30), 0.0, "all"]["observation_role"] == "external_projection"
    assert got[date(2020, 6, 30), 85.0, "male"]["age_quantity"] is None
    assert {r["region"] for r in got.values()} == {"CL"}
    for row, rule in [((2020, "0 a 4", "Hombre", 1.0), "age_single_or_open"),
                      ((1991, "0", "Hombre", 1.0), "year_range"),
                      ((2020, "0", "niño", 1.0), "sex_known"),
                      ((2020, "0", "Hombre", -1.0), "population_nonnegative"),
                      ((2020, "0", "Hombre", 1.0), "population_key_unique"),
                      ((2020, "90", "Hombre", 1.0), "open_age_last")]:
        bad = table.unionAll(spark.createDataFrame([row], columns))
        with pytest.raises(ContractViolation, match=rule):
            stocks.population(bad, RELEASE, 2024)
    blank = table.withColumn("region", F.lit(" "))
    with pytest.raises(ContractViolation, match="region_nonblank"):
        stocks.population(blank, RELEASE, 2024)


# --- market series -------------------------------------------------------------


def series_document(tmp_path, obs=None, **root):
    body = {
        "Codigo": 0, "Descripcion": "Success",
        "Series": {"descripEsp": "Tasa  BCP", "descripIng": "BCP rate", "seriesId": "S1",
                   "Obs": obs if obs is not None else [
                       {"indexDateString": "01-01-2024", "value": "5.5", "statusCode": "OK"},
                       {"indexDateString": "01-02-2024", "value": "", "statusCode": "ND"}]},
        "SeriesInfos": [], **root,
    }
    write(tmp_path / "series" / "s.json", json.dumps(body))
    return str(tmp_path / "series")


def contract(spark):
    return spark.createDataFrame(
        [("S1", "MONTHLY", "Tasa BCP", "BCP rate", date(2024, 1, 1), date(2024, 12, 1),
          date(2024, 12, 2), date(2020, 1, 1))],
        "series_id string, frequency string, spanish_title string, english_title string, "
        "first_observation date, last_observation date, updated_on date, created_on date")


def specs(spark):
    return spark.createDataFrame(
        [("S1", "MONTHLY", "official_benchmark_yield", "benchmark_yield", "percent", "1 / year",
          5.0, "CLP", "nominal", "bcp_benchmark_bond", None, None)],
        "series_id string, frequency string, variable string, quote_type string, "
        "source_unit string, canonical_unit string, tenor_years double, currency string, "
        "indexation string, instrument_type string, compounding string, day_count string")


def test_market_series(spark, tmp_path):
    documents = payloads.read_documents(spark, series_document(tmp_path))
    observations = payloads.parse_series(documents, contract(spark))
    facts = finance.market(observations, specs(spark), RELEASE, (date(2024, 1, 1), date(2025, 1, 1)))
    got = {r["period_start"]: r for r in facts.collect()}
    assert got[date(2024, 1, 1)]["value"] == pytest.approx(0.055)
    assert got[date(2024, 1, 1)]["period_end"] == date(2024, 2, 1)
    assert got[date(2024, 2, 1)]["value"] is None
    assert got[date(2024, 2, 1)]["missingness_reason"] == "bcch_source_observation_missing"
    with pytest.raises(ContractViolation, match="inside_reference_interval"):
        finance.market(observations, specs(spark), RELEASE, (date(2024, 1, 1), date(2024, 2, 1)))


@pytest.mark.parametrize(
    ("obs", "root", "rule"),
    [
        (None, {"Codigo": "0"}, "code_is_zero"),
        (None, {"Extra": 1}, "root_fields_exact"),
        (None, {"SeriesInfos": [1]}, "infos_empty"),
        ([], {}, "has_observations"),
        ([{"indexDateString": "1-1-2024", "value": "5", "statusCode": "OK"}], {}, "date_valid"),
        ([{"indexDateString": "02-01-2024", "value": "5", "statusCode": "OK"}], {}, "date_aligned"),
        ([{"indexDateString": "01-01-2023", "value": "5", "statusCode": "OK"}], {}, "date_in_bounds"),
        ([{"indexDateString": "01-01-2024", "value": "05", "statusCode": "OK"}], {}, "value_decimal"),
        ([{"indexDateString": "01-01-2024", "value": 5, "statusCode": "OK"}], {}, "value_is_text"),
        ([{"indexDateString": "01-01-2024", "value": "5", "statusCode": "O K"}], {}, "status_token"),
        ([{"indexDateString": "01-01-2024", "value": "5"}], {}, "observation_fields_exact"),
        ([{"indexDateString": "01-01-2024", "value": "5", "statusCode": "OK"}] * 2, {}, "date_unique"),
    ],
)
def test_bad_series_documents(spark, tmp_path, obs, root, rule):
    documents = payloads.read_documents(spark, series_document(tmp_path, obs, **root))
    with pytest.raises(ContractViolation, match=rule):
        payloads.parse_series(documents, contract(spark))


def test_series_metadata(spark, tmp_path):
    info = {"seriesId": "S1", "frequencyCode": "MONTHLY", "spanishTitle": "Tasa BCP",
            "englishTitle": "BCP rate", "firstObservation": "01-01-2024",
            "lastObservation": "01-12-2024", "updatedAt": "02-12-2024", "createdAt": "01-01-2020"}
    empty = {f: None for f in payloads.SERIES_FIELDS}

    def read(infos):
        body = {"Codigo": 0, "Descripcion": "Success", "Series": empty, "SeriesInfos": infos}
        write(tmp_path / f"{len(infos)}-{infos[0]['updatedAt']}" / "m.json", json.dumps(body))
        return payloads.read_documents(spark, str(tmp_path / f"{len(infos)}-{infos[0]['updatedAt']}"))

    other = {**info, "seriesId": "S2"}
    found = payloads.parse_series_metadata(read([info, other]), contract(spark))
    assert found.first()["series_id"] == "S1"
    with pytest.raises(ContractViolation, match="metadata_agrees"):
        payloads.parse_series_metadata(read([{**info, "updatedAt": "03-12-2024"}]), contract(spark))
    with pytest.raises(ContractViolation, match="series_matched_once"):
        payloads.parse_series_metadata(read([info, info, other]), contract(spark))


# --- mortality and pensioners --------------------------------------------------


def test_mortality_tables(spark):
    blocks = spark.createDataFrame(
        [("a", True, "CB-H-2020", 20, "male", 0.1, 0.02), ("b", False, "CB-H-2020", 20, "male", 0.1, 0.02)],
        "block string, emit boolean, table_id string, age int, sex string, qx double, `2021` double")
    assert finance.duplicate_block_report(blocks, "b", "a").first()["failed"] == 0
    changed = blocks.withColumn("qx", F.when(F.col("block") == "b", 0.2).otherwise(F.col("qx")))
    assert finance.duplicate_block_report(changed, "b", "a").first()["failed"] == 2
    long = finance.improvement_long(finance.emitted(blocks), [2021])
    facts = finance.mortality(long, RELEASE, expected_rows=2)
    got = {r["variable"]: r for r in facts.collect()}
    assert got["regulatory_mortality_probability"]["period_start"] == date(2020, 1, 1)
    assert got["regulatory_mortality_improvement_factor"]["period_start"] == date(2021, 1, 1)
    with pytest.raises(ContractViolation, match="row_count"):
        finance.mortality(long, RELEASE, expected_rows=3)


PERSON = "ORIGEN;ID;TABLA;FEC_VIG;FIN_EXPOSIC;SEXO;COD_REL;BEN_COD_INV;FEC_NAC;FEC_FALL"
PEOPLE = [
    "1;p;1;20150101;99991231;F;10;N;19550101;0",
    "1;p;2;20100101;99991231;F;10;N;19450101;20160701",
    "1;p;3;20120615;20170101;M;10;N;19520101;0",
    "1;p;4;20150101;99991231;F;99;T;19600101;0",
    "1;p;4;20150101;99991231;F;10;P;19600101;0",
    "2;p;4;20130101;99991231;M;99;T;19600101;0",
    "2;p;4;20130101;99991231;M;10;P;19600101;0",
]


def test_pensioner_spells_and_reconciliation(spark, tmp_path):
    path = write(tmp_path / "p.csv", "\n".join([PERSON, *PEOPLE]) + "\n")
    people = files.scan_pensioners(spark, path)
    assert "ID" not in people.columns
    lives = {r["table_id"] + str(i): tuple(r)[1:] for i, r in
             enumerate(finance.spells(people).orderBy("table_id", "lower_age").collect())}
    assert lives["B-M-20200"] == (60, 63, None)
    # died in mid 2016 aged 71.5: present through age 71
    assert lives["RV-M-20206"] == (69, 71, 71)
    # censored in 2017: last full age reached in 2016
    assert lives["CB-H-20201"] == (62, 64, None)
    public = finance.public_counts(people)
    assert public.count() == 555
    assert public.agg(F.sum("exposed")).first()[0] == 4 + 3 + 3 + 1 + 4 + 3 + 5
    assert public.columns == ["table_id", "age", "exposed", "deaths"]
    workbook = public.withColumn("qx", F.when(F.col("exposed") > 0, F.col("deaths") / F.col("exposed")))
    zero = public.select("table_id", "age", F.lit(0).cast("bigint").alias("delta_exposed"),
                         F.lit(0).cast("bigint").alias("delta_deaths"))
    done = finance.reconcile_pensioners(people, workbook, zero, expected_rows=7)
    assert done.where("qx_reconciled").count() == 555
    with pytest.raises(ContractViolation, match="row_count") as error:
        finance.reconcile_pensioners(people, workbook, zero, expected_rows=8)
    assert "1955" not in str(error.value)
    with pytest.raises(ContractViolation, match="route_combinations"):
        finance.reconcile_pensioners(people.where("TABLA <> 1"), workbook, zero, expected_rows=6)
    with pytest.raises(ContractViolation, match="deaths_within_exposed"):
        worse = workbook.withColumn("deaths", F.col("deaths") + 99)
        finance.reconcile_pensioners(people, worse, zero, expected_rows=7)


def test_deviation_sidecar(spark, tmp_path):
    rows = [{"table_id": t, "age": a, "delta_exposed": 0, "delta_deaths": 0}
            for t in finance.TABLES for a in range(111)]
    root = dict.fromkeys(payloads.DEVIATION_ROOT, "x")

    def read(name, listed):
        write(tmp_path / name / "d.json", json.dumps({**root, "rows": listed}))
        return payloads.read_documents(spark, str(tmp_path / name))

    assert payloads.parse_deviations(read("a", rows), finance.TABLES).count() == 555
    for name, listed, rule in [("b", rows[1:], "grid_complete"),
                               ("c", [*rows, rows[0]], "cell_unique"),
                               ("d", [{**rows[0], "age": 0.5}, *rows[1:]], "row_numbers_whole"),
                               ("e", [{**rows[0], "z": 1}, *rows[1:]], "row_fields_exact")]:
        with pytest.raises(ContractViolation, match=rule):
            payloads.parse_deviations(read(name, listed), finance.TABLES)


# --- files ---------------------------------------------------------------------


def archive(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text.encode("windows-1252"))
    return str(path)


def test_archives_land_as_text(spark, tmp_path):
    good = archive(tmp_path / "z" / "a.zip", {"deaths.csv": "AÑO;x\n2024;ñ\n", "readme.pdf": "x"})
    landing = str(tmp_path / "landing")
    files.land_member(spark, good, "deaths.csv", landing, "windows-1252")
    assert sorted(r["value"] for r in spark.read.text(landing).collect()) == ["2024;ñ", "AÑO;x"]
    for name, members, rule in [("b", {"other.csv": "x"}, "one_exact_member"),
                                ("c", {"deaths.csv": "x", "more.csv": "y"}, "no_other_table")]:
        bad = archive(tmp_path / name / "a.zip", members)
        with pytest.raises(ContractViolation, match=rule):
            files.land_member(spark, bad, "deaths.csv", str(tmp_path / f"l{name}"))


def test_attestation(spark, tmp_path):
    write(tmp_path / "f" / "a.txt", "one")
    write(tmp_path / "f" / "b.txt", "two")
    found = files.attest_files(spark, str(tmp_path / "f" / "*.txt"))
    import hashlib

    listed = spark.createDataFrame(
        [("a.txt", hashlib.sha256(b"one").hexdigest(), 3), ("b.txt", "0" * 64, 3), ("c.txt", "1", 1)],
        "name string, sha256 string, bytes bigint")
    assert {r["name"]: r["status"] for r in files.attestation_status(found, listed).collect()} == {
        "a.txt": "equal", "b.txt": "different", "c.txt": "only_right"}


def test_large_files_are_hashed_in_rounds(spark, tmp_path):
    import hashlib
    import random

    noise = random.Random(5).randbytes(70_000)
    contents = {
        "noise.parquet": noise, "marked.csv": b"\xef\xbb\xbf" + b"a;b\n" * 9000, "marked_open.csv": b"\xef\xbb\xbf" + b"a;b\n" * 9000 + b"x",
        "feeds.bin": b"\n" * 6000, "returns.txt": b"a\r\n\xff\x00" * 5000, "long.txt": b"x" * 30_000 + b"\n" + b"y" * 9000,
        "noise.csv.gz": noise, "small.txt": b"one", "a b%20ü.txt": b"two", "large b%20ü+.txt": noise, "mark.txt": b"\xef\xbb\xbf",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = files.attest_files(spark, str(tmp_path / "*"), reach=5000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["name"]: (r["sha256"], r["bytes"]) for r in found} == {
        name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in contents.items()}


def test_bundle_and_totals(spark, tmp_path):
    write(tmp_path / "births_by_maternal_age.csv",
          "age_group,births_total,births_male,period\nMenores de 15,8,4,2026-04\n15 a 19,420,204,2026-04\n")
    write(tmp_path / "deaths_by_age_sex.csv",
          "age_group,deaths_total,deaths_male,deaths_female,period\nMenores de 1 año,77,39,38,2026-04\n")
    write(tmp_path / "population_by_age_sex.csv",
          "age_group,population_total,population_male,population_female\n85 o más,3,1,2\n")
    write(tmp_path / "monthly_births_deaths.csv",
          "period,births_total,deaths_total,source_url\n2025-02,2,3,u\n2025-01,1,1,u\n")
    bundle = files.load_bundle(spark, str(tmp_path))
    assert [r["period"] for r in bundle["monthly"].collect()] == ["2025-01", "2025-02"]
    assert dict(bundle["births_age"].dtypes)["births_male"] == "string"
    assert bundle["births_age"].agg(F.sum("births_total")).first()[0] == 428
    write(tmp_path / "short.csv", "age_group\nx\n")
    with pytest.raises(ContractViolation, match="births_total"):
        files.read_table(spark, str(tmp_path / "short.csv"), files.BUNDLE["births_age"][1])


def test_curated_intake(spark, tmp_path):
    columns = [("year", "integer"), ("when", "date"), ("value", "float64"), ("at", "timestamp_utc")]
    header = "year,when,value,at\n"
    good = write(tmp_path / "g.csv", header + "2024,2024-01-01,1.5,2024-01-01T00:00:00Z\n")
    assert files.read_curated(spark, good, columns).first()["when"] == date(2024, 1, 1)
    for i, (line, rule) in enumerate([("x,2024-01-01,1.5,2024-01-01T00:00:00Z", "year_integer"),
                                      ("1,2024-02-30,1.5,2024-01-01T00:00:00Z", "when_date"),
                                      ("1,2024-01-01,NaN,2024-01-01T00:00:00Z", "value_float64"),
                                      ("1,2024-01-01,1,2024-01-01T00:00:00", "at_timestamp_utc"),
                                      ("", "not_empty")]):
        bad = write(tmp_path / f"{i}.csv", header + line + "\n")
        with pytest.raises(ContractViolation, match=rule):
            files.read_curated(spark, bad, columns)


def test_checksum_follows_row_order_and_digest_does_not(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "i bigint, v string")
    turned = df.withColumn("i", 49 - F.col("i"))
    same = df.repartition(7)
    a, b, c = (files.table_checksum(t, "i", fan=8).collect() for t in (df, same, turned))
    assert a == b
    assert len(a) == 1
    assert a != c
    assert files.content_digest(df.select("v")).first() == files.content_digest(
        turned.select("v")).first()


def test_digest_changes_with_any_column_of_a_row(spark):
    from factspan.queries import QUERIES
    from factspan.queries.jobs import text_hash

    rows = [(i, f"v{i}", i / 4, datetime(2024, 1, 1 + i)) for i in range(9)]
    schema = "i bigint, v string, x double, t timestamp"
    changed = [(90, "v0", 0.0, rows[0][3]), (0, "w", 0.0, rows[0][3]), (0, "v0", 0.5, rows[0][3]), (0, None, 0.0, None)]
    for row_hash in (lambda df: None, text_hash):
        first, *others = (
            files.content_digest(df, row_hash(df)).first()["digest"]
            for df in (spark.createDataFrame([row, *rows[1:]], schema) for row in [rows[0], *changed])
        )
        assert len({first, *others}) == 5
    plan = QUERIES["content_digest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" in plan


def test_inventory(spark):
    def keys(*names):
        return spark.createDataFrame([(n,) for n in names], "key string")

    fired = {r["rule_id"] for r in files.inventory_report(
        keys("a", "b", "a"), keys("a", "c"), keys("a"), keys("a")).where("failed > 0").collect()}
    assert fired == {"asset_key_unique", "acquired_is_available", "unavailable_is_absent"}
