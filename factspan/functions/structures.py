"""JSON, array and map expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons_json(reasons: Mapping[str, Column | str | None]) -> Column:
    """Compact JSON of the reasons that apply, keys sorted.

    A string value always applies; a Column value applies where it is not null.
    """
    entries = [
        F.when(value.isNotNull(), F.struct(F.lit(key).alias("k"), value.alias("v")))
        if isinstance(value, Column)
        else F.struct(F.lit(key).alias("k"), F.lit(value).alias("v"))
        for key, value in sorted(reasons.items())
        if value is not None
    ]
    present = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return F.to_json(F.map_from_entries(present))


def display_json(columns: Mapping[str, Column]) -> Column:
    """JSON object of display dimensions: keys sorted, nulls kept."""
    fields = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def ordered_union(*arrays: Column) -> Column:
    """Union of string lists that keeps first appearances in order."""
    return F.array_distinct(F.concat(*arrays))


def append_once(items: Column, item: str) -> Column:
    return F.when(F.array_contains(items, item), items).otherwise(F.array_append(items, item))


def integer_grid(lower: int, upper: int) -> Column:
    """One row per integer of the closed range (use inside ``select``)."""
    return F.explode(F.sequence(F.lit(lower), F.lit(upper)))


def exact_object(json: Column, fields: Sequence[str]) -> Column:
    """True when the JSON object has exactly these keys, each once."""
    keys = F.json_object_keys(json)
    wanted = F.array(*[F.lit(f) for f in sorted(fields)])
    return F.coalesce(F.array_sort(keys) == wanted, F.lit(False))
