from __future__ import annotations

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factspan.functions import text
from factspan.queries import labels

X = F.col("x")


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("  De Valparaíso ", "de valparaiso"),
        ("Del Libertador B. O'Higgins", "del libertador b o higgins"),
        ("DE ÑUBLE", "de nuble"),
        ("Aysén  del-General", "aysen del general"),
        ("ﬁn ½", "fin 1 2"),
        ("Ａ", "a"),
        ("", ""),
    ],
)
def test_region_label(one, label, expected):
    assert one(text.region_label(X), x=label) == expected


def test_region_code(one):
    assert one(text.region_code(X), x="Metropolitana de Santiago") == "13"
    assert one(text.region_code(X), x="Atlantis") is None


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cc"])),
                min_size=1, max_size=30))
def test_fold_equals_unicode_tables(spark, texts):
    """Folded ASCII words agree with the Unicode decomposition for any text."""
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    kept = F.regexp_replace(text.fold(X), "[^A-Za-z0-9]", "")
    got = [r["v"] for r in df.select(kept.alias("v")).collect()]

    def plain(t):
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)
        )
        return "".join(c for c in folded if c.isascii() and c.isalnum())

    assert got == [plain(t) for t in texts]


def test_spanish_label(one):
    assert one(text.spanish_label(X), x="  35 A 39   AÑOS ") == "35 a 39 anos"
    assert one(text.spanish_label(X), x="15–19") is None
    assert one(text.spanish_label(X), x="años") == "anos"


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("Menores de 1 año", (0.0, 1.0, False)),
        ("Menores de 15", (0.0, 1.0, False)),
        ("85 o más", (85.0, None, True)),
        ("50 y más", (50.0, None, True)),
        ("100 años y más", (100.0, None, True)),
        ("100", (100.0, None, True)),
        ("0 a 4", (0.0, 5.0, False)),
        ("De 15  a  19 años", (15.0, 20.0, False)),
        ("sin dato", None),
    ],
)
def test_age_bin(one, label, expected):
    got = one(text.age_bin(X), x=label)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("Menores 15 años", (0.0, 15.0, False)),
        ("15 a 19 años", (15.0, 20.0, False)),
        ("45 a 49 años", (45.0, 50.0, False)),
        ("50 o más años", (50.0, None, True)),
        ("No especificado", (None, None, False)),
        ("16 a 20 años", None),
        ("15 a 20 años", None),
        ("10 a 14 años", None),
        ("15 a 19", None),
    ],
)
def test_maternal_age(one, label, expected):
    got = one(text.maternal_age(X), x=label)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("7", (7.0, 8.0, False)),
        ("7.0", (7.0, 8.0, False)),
        ("7 años", (7.0, 8.0, False)),
        ("Menores de 1 año", (0.0, 1.0, False)),
        ("85 o más", (85.0, None, True)),
        ("0 a 4", None),
        ("4 a 4", (4.0, 5.0, False)),
        ("", None),
    ],
)
def test_single_age(one, label, expected):
    got = one(text.single_age(X), x=label)
    assert (tuple(got) if got else None) == expected


def test_census_bin_refuses_other_labels(one):
    assert one(text.census_bin(X), x="85 o más") is not None
    assert one(text.census_bin(X), x="50 y más") is None


@pytest.mark.parametrize(
    ("code", "label", "expected"),
    [
        ("8111", "Del Bíobío", "CL-08"),
        ("08111", "Del Biobío", "CL-08"),
        ("", "Ignorada", "unknown"),
        ("99999", "", "unknown"),
        ("99999", "De Los Lagos", "CL-10"),
        ("8111", "De Los Lagos", None),
        ("17101", "De Los Lagos", None),
        ("abc", "De Los Lagos", None),
        ("", "Atlantis", None),
    ],
)
def test_death_region(one, code, label, expected):
    assert one(text.death_region(F.col("a"), F.col("b")), a=code, b=label) == expected


@pytest.mark.parametrize(
    ("code", "label", "expected"),
    [
        ("8", "Del Biobío", "CL-08"),
        ("13", "Metropolitana de Santiago", "CL-13"),
        ("99", "Ignorada", "unknown"),
        ("99", "Del Biobío", None),
        ("17", "Del Biobío", None),
        ("8", "Del Maule", None),
    ],
)
def test_birth_region(one, code, label, expected):
    assert one(text.birth_region(F.col("a"), F.col("b")), a=code, b=label) == expected


def test_nationality(one):
    assert [one(text.nationality(X), x=v) for v in ("C", "e", " N ", "", "Z")] == [
        "C", "E", "N", None, None,
    ]
    assert not one(text.nationality_ok(X), x="Z")


def test_cause_and_external(one):
    assert one(text.cause(X), x=" ") == "unknown"
    assert [one(text.external_cause(X), x=v) for v in ("", " ", "xxx1", "W01X")] == [
        "not_applicable", "not_applicable", "unknown_not_coded", "W01X",
    ]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("12.345.678-5", "cl-rut:12345678-5"),
        ("12345678-5", "cl-rut:12345678-5"),
        ("123456785", "cl-rut:12345678-5"),
        (" 00012345678-5", None),
        ("6-k", "cl-rut:6-K"),
        ("cl-rut:6-K", "cl-rut:6-K"),
        ("cl-rut:06-K", None),
        ("12345678-4", None),
        ("0-0", None),
        ("12​345678-5", None),
    ],
)
def test_entity_rut(one, raw, expected):
    assert one(text.entity_rut(X), x=raw) == expected


@pytest.mark.parametrize("raw", ["100000000-7", "1000000007", "100.000.000-7", "cl-rut:100000000-7"])
def test_entity_rut_of_wider_bodies(one, raw):
    assert one(text.entity_rut(X), x=raw) is None
    assert one(text.entity_rut(X, 9), x=raw) == "cl-rut:100000000-7"
    assert one(text.entity_rut(X, 19), x=raw) == "cl-rut:100000000-7"


def test_rut_check_holds_for_any_key(spark, tmp_path):
    keys = [0, 1, 7, 12627, 12628, 12632, 15000, 126277, 1262784, 900002, 10**12 + 2]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))

    def expected(key):
        body = str(key * 7919 + 1)
        left = 11 - sum(int(c) * (2 + i % 6) for i, c in enumerate(reversed(body))) % 11
        return None if key % 5 == 4 else f"cl-rut:{body}-{'0' if left == 11 else 'K' if left == 10 else left}"

    got = {r["c_custkey"]: r["entity_id"] for r in labels.rut_check(spark, str(tmp_path)).collect()}
    assert got == {k: expected(k) for k in keys}


def test_nfc(spark):
    df = spark.createDataFrame([("é",), (None,)], "x string")
    assert [r[0] for r in df.select(text.nfc("x")).collect()] == ["é", None]


def test_fold_reaches_beyond_the_basic_plane(spark):
    import unicodedata

    wide = [chr(c) for c in (*range(0x1D400, 0x1D4A0), *range(0x1F100, 0x1F16C), 0x1D165, 0x11046, 0x2F800, 0x1EE00)]
    texts = [f"a{c}b" for c in wide if unicodedata.category(c) != "Cn"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for row in df.select("x", F.regexp_replace(text.fold(F.col("x")), "[^A-Za-z0-9]", "").alias("y")).collect():
        plain = "".join(c for c in unicodedata.normalize("NFKD", row["x"]) if not unicodedata.combining(c))
        assert row["y"] == "".join(c for c in plain if c.isascii() and c.isalnum()), ascii(row["x"])
