"""Content-addressed identifiers as column expressions.

A value is written as typed canonical JSON, wrapped with a namespace, and hashed with
SHA-256. Equal content gives equal identifiers on any cluster, in any row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions.text import respell


@dataclass(frozen=True)
class Scheme:
    """Name under which identifiers are issued; ``domain_enum`` types the domain atom."""

    prefix: str = "factspan"
    version: str = "v1"
    domain_enum: str = "factspan.Domain"

    def pattern(self, kind: str) -> str:
        return f"^{self.prefix}:{kind}:{self.version}:[0-9a-f]{{64}}$"


DEFAULT = Scheme()


_SHORT = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_ESCAPES = {
    **{chr(point): _SHORT.get(chr(point), f"\\u{point:04x}") for point in range(32)},
    '"': '\\"',
    "\\": "\\\\",
}


def _quoted(text: Column) -> Column:
    """JSON string body with quotes; control characters escaped, other text kept."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.when(text.rlike(r"[\x00-\x1f]"), respell(text, _ESCAPES)).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _text_literal(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def text_atom(text: Column) -> Column:
    return F.concat(F.lit('{"t":"str","v":'), _quoted(text), F.lit("}"))


def int_atom(number: Column) -> Column:
    return F.concat(F.lit('{"t":"int","v":"'), number.cast("string"), F.lit('"}'))


def bool_atom(flag: Column) -> Column:
    return F.concat(F.lit('{"t":"bool","v":'), flag.cast("string"), F.lit("}"))


def float_bits(number: Column) -> Column:
    """Sixteen hex digits of the IEEE value; negative zero reads as zero."""
    bits = F.call_function(
        "reflect",
        F.lit("java.lang.Double"),
        F.lit("doubleToLongBits"),
        number + F.lit(0.0),
    )
    return F.lpad(F.lower(F.hex(bits.cast("bigint"))), 16, "0")


def float_atom(number: Column) -> Column:
    return F.concat(F.lit('{"t":"float64","v":"'), float_bits(number), F.lit('"}'))


def date_atom(day: Column) -> Column:
    return F.concat(
        F.lit('{"t":"date","v":"'), F.date_format(day, "yyyy-MM-dd"), F.lit('"}')
    )


def instant_atom(instant: Column) -> Column:
    text = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.lit('{"t":"timestamp_utc_ns","v":"'), text, F.lit('000Z"}'))


def enum_atom(name: str, value: Column) -> Column:
    return F.concat(
        F.lit('{"n":' + _text_literal(name) + ',"t":"enum","v":'), _quoted(value), F.lit("}")
    )


NULL_ATOM = '{"t":"null"}'


def atom(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of one column; null has its own atom."""
    if isinstance(kind, T.StringType):
        body = text_atom(value)
    elif isinstance(kind, T.BooleanType):
        body = bool_atom(value)
    elif isinstance(kind, T.IntegralType):
        body = int_atom(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = float_atom(value.cast("double"))
    elif isinstance(kind, T.DateType):
        body = date_atom(value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        body = instant_atom(value)
    elif isinstance(kind, T.ArrayType):
        body = list_atom(F.transform(value, lambda x: atom(x, kind.elementType)))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        body = _map_atom(value, kind.valueType)
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit(NULL_ATOM)).otherwise(body)


def list_atom(atoms: Column, kind: str = "list") -> Column:
    """List (``kind="tuple"`` for a tuple) of already canonical atoms, order kept."""
    return F.concat(F.lit('{"t":"' + kind + '","v":['), F.concat_ws(",", atoms), F.lit("]}"))


def set_atom(atoms: Column) -> Column:
    """Set of canonical atoms, ordered by their bytes."""
    return F.concat(F.lit('{"t":"set","v":['), F.concat_ws(",", F.array_sort(atoms)), F.lit("]}"))


def _map_atom(value: Column, kind: T.DataType) -> Column:
    pairs = F.transform(
        F.map_entries(value),
        lambda e: F.struct(text_atom(e["key"]).alias("k"), atom(e["value"], kind).alias("v")),
    )
    cells = F.transform(
        F.array_sort(pairs), lambda p: F.concat(F.lit("["), p["k"], F.lit(","), p["v"], F.lit("]"))
    )
    return F.concat(F.lit('{"t":"mapping","v":['), F.concat_ws(",", cells), F.lit("]}"))


def mapping_atom(fields: Mapping[str, Column]) -> Column:
    """Mapping with keys known up front: sorted while the plan is built, not per row."""
    parts: list[Column] = [F.lit('{"t":"mapping","v":[')]
    spelled = {'{"t":"str","v":' + _text_literal(key) + "}": fields[key] for key in fields}
    for index, key in enumerate(sorted(spelled, key=lambda k: k.encode())):
        lead = "" if index == 0 else ","
        parts += [F.lit(f"{lead}[{key},"), spelled[key], F.lit("]")]
    return F.concat(*parts, F.lit("]}"))


def wrapped(kind: str, payload: Column, scheme: Scheme = DEFAULT) -> Column:
    head = '{"namespace":' + _text_literal(f"{scheme.prefix}:{kind}") + ',"payload":'
    tail = ',"schema_version":' + _text_literal(scheme.version) + "}"
    return F.concat(F.lit(head), payload, F.lit(tail))


def _issue(kind: str, payload: Column, scheme: Scheme) -> Column:
    return F.concat(
        F.lit(f"{scheme.prefix}:{kind}:{scheme.version}:"),
        F.sha2(wrapped(kind, payload, scheme), 256),
    )


def fact_payload(
    domain: str,
    source: Mapping[str, str | Column],
    key: Mapping[str, tuple[Column, T.DataType]],
    scheme: Scheme = DEFAULT,
) -> Column:
    if not source or not key:
        raise ValueError("a fact needs a source identity and key fields")
    origin = {k: text_atom(v if isinstance(v, Column) else F.lit(v)) for k, v in source.items()}
    return mapping_atom(
        {
            "domain": enum_atom(scheme.domain_enum, F.lit(domain)),
            "key_fields": mapping_atom({k: atom(c, t) for k, (c, t) in key.items()}),
            "source_identity": mapping_atom(origin),
        }
    )


def fact_id(
    domain: str,
    source: Mapping[str, str | Column],
    key: Mapping[str, tuple[Column, T.DataType]],
    scheme: Scheme = DEFAULT,
) -> Column:
    """Identifier of what is measured: domain, source and key, never the value or the release."""
    return _issue("fact", fact_payload(domain, source, key, scheme), scheme)


def release_id(assets: Column, scheme: Scheme = DEFAULT) -> Column:
    """Identifier of a release from an array of (source_key, sha256) structs.

    The array is one release's manifest: one entry per source file, so its length is
    the number of distinct source keys.
    """
    cells = F.transform(
        F.array_sort(F.transform(assets, lambda a: F.struct(a["source_key"], a["sha256"]))),
        lambda a: mapping_atom(
            {"sha256": text_atom(a["sha256"]), "source_key": text_atom(a["source_key"])}
        ),
    )
    return _issue("release", mapping_atom({"assets": list_atom(cells)}), scheme)


def observation_id(
    fact: Column,
    release: Column,
    vintage: Column,
    transformation_id: Column,
    transformation_version: Column,
    available_at: Column,
    scheme: Scheme = DEFAULT,
) -> Column:
    """Identifier of one published state of a fact; its clock is part of it."""
    text = T.StringType()
    payload = mapping_atom(
        {
            "available_at": instant_atom(available_at),
            "fact_id": text_atom(fact),
            "release_id": text_atom(release),
            "transformation": mapping_atom(
                {
                    "transformation_id": atom(transformation_id, text),
                    "transformation_version": atom(transformation_version, text),
                }
            ),
            "vintage": text_atom(vintage),
        }
    )
    return _issue("observation", payload, scheme)


def row_digest(columns: Sequence[tuple[str, T.DataType]]) -> Column:
    """Digest of a whole row over named, typed columns (spec and registry rows)."""
    return F.sha2(mapping_atom({name: atom(F.col(name), kind) for name, kind in columns}), 256)
