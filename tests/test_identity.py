"""Canonical bytes against fixed vectors and an independent plain-Python statement."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions import identity
from factspan.functions.text import nfc

# fixed values: canonical text of one value of each kind
VECTORS = {
    "null": (F.lit(None).cast("string"), T.StringType(), '{"t":"null"}'),
    "bool": (F.lit(True), T.BooleanType(), '{"t":"bool","v":true}'),
    "int": (F.lit(1), T.IntegerType(), '{"t":"int","v":"1"}'),
    "float": (F.lit(1.0), T.DoubleType(), '{"t":"float64","v":"3ff0000000000000"}'),
    "minus_zero": (F.lit(-0.0), T.DoubleType(), '{"t":"float64","v":"0000000000000000"}'),
    "date": (F.lit(date(2026, 7, 1)), T.DateType(), '{"t":"date","v":"2026-07-01"}'),
    "list": (
        F.array(F.lit("x"), F.lit("y")),
        T.ArrayType(T.StringType()),
        '{"t":"list","v":[{"t":"str","v":"x"},{"t":"str","v":"y"}]}',
    ),
    "mapping": (
        F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)),
        T.MapType(T.StringType(), T.IntegerType()),
        '{"t":"mapping","v":[[{"t":"str","v":"a"},{"t":"int","v":"1"}],'
        '[{"t":"str","v":"b"},{"t":"int","v":"2"}]]}',
    ),
}


@pytest.mark.parametrize("name", VECTORS)
def test_vectors(one, name):
    column, kind, expected = VECTORS[name]
    assert one(identity.atom(column, kind)) == expected


def test_known_digests(one):
    null = identity.atom(F.lit(None).cast("string"), T.StringType())
    assert one(F.sha2(null, 256)) == (
        "d33e6a78120356d0e2068636fa37fb1e674b4ac1e478009ade964ed1216d7206"
    )
    composed = identity.text_atom(F.lit("é"))
    assert one(F.sha2(composed, 256)) == (
        "e4c1635402659facd144fc6eac5033d8478d05f0de74fe76f5bfcc529f7fe114"
    )


def test_composed_and_decomposed_text_agree(spark):
    df = spark.createDataFrame([("é",), ("é",)], "x string").withColumn("x", nfc("x"))
    assert df.select(identity.text_atom(F.col("x")).alias("v")).distinct().count() == 1


def test_instant_is_utc_with_nanoseconds(one):
    value = identity.instant_atom(F.lit(datetime(2026, 7, 1, 12)).cast("timestamp"))
    assert one(value) == '{"t":"timestamp_utc_ns","v":"2026-07-01T12:00:00.000000000Z"}'


def test_tuple_and_set(one):
    atoms = F.array(identity.int_atom(F.lit(2)), identity.int_atom(F.lit(1)))
    assert one(identity.set_atom(atoms)) == (
        '{"t":"set","v":[{"t":"int","v":"1"},{"t":"int","v":"2"}]}'
    )
    assert one(identity.list_atom(atoms, "tuple")) == (
        '{"t":"tuple","v":[{"t":"int","v":"2"},{"t":"int","v":"1"}]}'
    )


@pytest.mark.parametrize("text", ['a"b', "back\\slash", "tab\tnew\nline", "\x01\x1f", "ñ€", "\x7f/"])
def test_text_escapes_like_json(spark, text):
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(identity.text_atom(F.col("x")).alias("v")).first()["v"]
    body = json.dumps(text, ensure_ascii=False)
    assert got == '{"t":"str","v":' + body + "}"


def _plain(value):
    if value is None:
        return {"t": "null"}
    if isinstance(value, dict):
        pairs = sorted(
            ([_plain(k), _plain(v)] for k, v in value.items()),
            key=lambda p: json.dumps(p[0], separators=(",", ":")).encode(),
        )
        return {"t": "mapping", "v": pairs}
    if isinstance(value, list):
        return {"t": "list", "v": [_plain(v) for v in value]}
    if isinstance(value, int):
        return {"t": "int", "v": str(value)}
    return {"t": "str", "v": value}


def _wrapped(kind, payload):
    body = {"namespace": f"factspan:{kind}", "payload": payload, "schema_version": "v1"}
    text = json.dumps(body, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    return f"factspan:{kind}:v1:" + hashlib.sha256(text.encode()).hexdigest()


def test_fact_id_is_the_hash_of_its_content(one):
    key = {"b": (F.lit("x"), T.StringType()), "a": (F.lit(3), T.IntegerType())}
    got = one(identity.fact_id("market_quote", {"publisher": "p"}, key))
    payload = _plain({"key_fields": {"a": 3, "b": "x"}, "source_identity": {"publisher": "p"}})
    domain = [
        {"t": "str", "v": "domain"},
        {"n": "factspan.Domain", "t": "enum", "v": "market_quote"},
    ]
    payload["v"].insert(0, domain)
    assert got == _wrapped("fact", payload)


def test_release_id_ignores_asset_order(one):
    def listed(*keys):
        return F.array(
            *[F.struct(F.lit(k).alias("source_key"), F.lit(k * 64).alias("sha256")) for k in keys]
        )

    forward, backward = one(identity.release_id(listed("a", "b"))), one(
        identity.release_id(listed("b", "a"))
    )
    assets = [{"sha256": k * 64, "source_key": k} for k in "ab"]
    assert forward == backward == _wrapped("release", _plain({"assets": assets}))


def test_observation_id_depends_on_the_clock_and_fact_id_does_not(one):
    def observation(day):
        return one(
            identity.observation_id(
                F.lit("f"), F.lit("r"), F.lit("v"), F.lit(None).cast("string"),
                F.lit(None).cast("string"), F.lit(datetime(2024, 1, day)).cast("timestamp"),
            )
        )

    assert observation(1) != observation(2)


def test_a_caller_may_issue_under_another_name(one):
    scheme = identity.Scheme(prefix="other", domain_enum="other.Domain")
    key = {"a": (F.lit(1), T.IntegerType())}
    made = one(identity.fact_id("demographic", {"p": "q"}, key, scheme))
    assert made.startswith("other:fact:v1:")
