"""Text expressions: folding, label parsing, code lookups.

Everything here maps ``Column`` to ``Column`` and stays in the JVM, except ``nfc``, which
``composed`` runs on distinct spellings only.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.session import stage

# fixed values: published region labels (folded) and their two-digit codes
REGION_CODES = {
    "de tarapaca": "01",
    "de antofagasta": "02",
    "de atacama": "03",
    "de coquimbo": "04",
    "de valparaiso": "05",
    "del libertador general bernardo ohiggins": "06",
    "del libertador general bernardo o higgins": "06",
    "del libertador b ohiggins": "06",
    "del libertador b o higgins": "06",
    "del maule": "07",
    "del biobio": "08",
    "de la araucania": "09",
    "de los lagos": "10",
    "aysen del general carlos ibanez del campo": "11",
    "de aysen del general carlos ibanez del campo": "11",
    "de aisen del gral c ibanez del campo": "11",
    "de magallanes y de la antartica chilena": "12",
    "metropolitana de santiago": "13",
    "de los rios": "14",
    "de arica y parinacota": "15",
    "de nuble": "16",
}
# fixed values: sex spellings per source
DEATH_SEX = {"Hombre": "male", "Mujer": "female", "Indeterminado": "indeterminate"}
BIRTH_SEX = {"1": "male", "2": "female", "9": "indeterminate"}
POPULATION_SEX = {
    "male": "male",
    "hombre": "male",
    "hombres": "male",
    "female": "female",
    "mujer": "female",
    "mujeres": "female",
    "all": "all",
    "ambos sexos": "all",
    "total": "all",
}
# fixed values: placeholders of the external cause field
EXTERNAL_PLACEHOLDERS = ("XXX", "XXX1", "XXX2", "X")

_SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Compatibility decompositions and combining marks, derived from the Unicode tables.

    Beyond the first two planes only the compatibility ideographs have any.
    """
    single_from, single_to, several, marks = [], [], {}, []
    for point in (*range(0x80, 0x20000), *range(0x2F800, 0x2FA20)):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(point)
            continue
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if plain == char:
            continue
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        elif any(c.isascii() and c.isalnum() for c in plain):
            several[char] = plain
    spans, start = [], None
    for point in [*marks, sys.maxunicode + 2]:
        if start is None:
            start = previous = point
        elif point == previous + 1:
            previous = point
        else:
            spans.append(f"\\x{{{start:x}}}-\\x{{{previous:x}}}")
            start = previous = point
    return "".join(single_from), "".join(single_to), several, "[" + "".join(spans) + "]"


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL, _MARKS = _fold_tables()


def lookup(col: Column, values: Mapping[str, str]) -> Column:
    """Value of a small fixed mapping; null for anything not listed."""
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    return F.element_at(F.create_map(*pairs), col)


def strip(col: Column) -> Column:
    """Trim every Unicode space, as raw text fields need it."""
    return F.btrim(col, F.lit(_SPACES))


def squeeze(col: Column) -> Column:
    return F.regexp_replace(strip(col), f"{_SPACE}+", " ")


def respell(col: Column, spelling: Mapping[str, str]) -> Column:
    """Every character replaced by its spelling in a table, if it has one.

    The table is two constant strings, so the expression stays small however long it is.
    """
    mark = "\ue000"
    table = F.map_from_arrays(
        F.split(F.lit(mark.join(spelling)), mark), F.split(F.lit(mark.join(spelling.values())), mark)
    )
    return F.concat_ws(
        "", F.transform(F.split(col, ""), lambda c: F.coalesce(F.element_at(table, c), c))
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


_LATIN = [(a, b) for a, b in zip(_FOLD_FROM, _FOLD_TO, strict=True) if ord(a) <= 0xFF]
_LATIN_FROM, _LATIN_TO = "".join(a for a, _ in _LATIN), "".join(b for _, b in _LATIN)


def fold(col: Column) -> Column:
    """NFKD with combining marks dropped.

    ASCII passes through and Latin-1 letters take one short translation; only text beyond
    them (or holding a fraction sign) meets the full tables.
    """
    spelled = respell(col, _FOLD_SEVERAL)
    general = F.regexp_replace(F.translate(spelled, _FOLD_FROM, _FOLD_TO), _MARKS, "")
    return (
        F.when(~col.rlike(r"[^\x00-\x7f]"), col)
        .when(~col.rlike(r"[^\x00-\xbb\xbf-\xff]"), F.translate(col, _LATIN_FROM, _LATIN_TO))
        .otherwise(general)
    )


def region_label(col: Column) -> Column:
    """Folded lower-case words of a region label, joined by one space."""
    words = F.regexp_replace(fold(F.lower(strip(col))), "[^a-z0-9]+", " ")
    return F.trim(words)


def region_code(col: Column) -> Column:
    """Two-digit region code of a published label, null when the label is unknown."""
    return lookup(region_label(col), REGION_CODES)


_SPANISH_FROM, _SPANISH_TO = "áéíóúüñ", "aeiouun"


def _spanish_lower(col: Column) -> Column:
    """Lower case with the documented accents composed (decomposed input included)."""
    text = F.lower(col)
    for char in _SPANISH_FROM:
        text = F.replace(text, F.lit(unicodedata.normalize("NFD", char)), F.lit(char))
    return strip(text)


def spanish_label(col: Column) -> Column:
    """Strict label form; null where the text holds a character outside the documented set."""
    text = _spanish_lower(col)
    allowed = text.rlike(rf"^(?:[a-z0-9.{_SPANISH_FROM}]|{_SPACE})*$")
    return F.when(allowed, squeeze(F.translate(text, _SPANISH_FROM, _SPANISH_TO)))


def age_label(col: Column) -> Column:
    """Loose label form used before parsing an age bin: ASCII fold, lower, squeezed."""
    ascii_only = F.regexp_replace(fold(col), r"[^\x00-\x7f]", "")
    return squeeze(F.lower(ascii_only))


def _bin(lower: Column, upper: Column, is_open: Column) -> Column:
    return F.struct(
        lower.cast("double").alias("age_lower"),
        upper.cast("double").alias("age_upper"),
        is_open.alias("age_open"),
    )


def _closed(lower: Column, upper: Column) -> Column:
    return _bin(lower, upper, F.lit(False))


def _open(lower: float) -> Column:
    return _bin(F.lit(lower), F.lit(None), F.lit(True))


def age_bin(col: Column) -> Column:
    """Half-open age bin of a published label; null when the label cannot be parsed."""
    return let(age_label(col), _parsed_bin)


def _parsed_bin(text: Column) -> Column:
    span = r"(\d+)\s+a\s+(\d+)"
    low = F.regexp_extract(text, span, 1).try_cast("double")
    high = F.regexp_extract(text, span, 2).try_cast("double")
    return (
        # this test comes first in the published order, so it also claims "menores de 15"
        F.when(text.startswith("menores de 1"), _closed(F.lit(0.0), F.lit(1.0)))
        .when(text.contains("85 o mas"), _open(85.0))
        .when(text.contains("50 y mas"), _open(50.0))
        .when(text.contains("100 anos y mas") | text.startswith("100"), _open(100.0))
        .when(text.rlike(span), _closed(low, high + 1))
    )


def fertility_label(col: Column) -> Column:
    """True for the seven closed maternal groups 15-19 to 45-49 (raw label prefix)."""
    return F.coalesce(col.rlike(r"^(15|20|25|30|35|40|45) a"), F.lit(False))


def census_bin(col: Column) -> Column:
    """Census label (``L a U`` or ``85 o mas``) as a bin; null when not allowed."""
    return F.when(spanish_label(col).rlike(r"^(?:\d+ a \d+|85 o mas)$"), age_bin(col))


def maternal_age(col: Column) -> Column:
    """Maternal group as (age_lower, age_upper, age_open); null struct when invalid.

    ``no especificado`` is valid and gives a struct of nulls.
    """
    return let(spanish_label(col), _maternal_bin)


def _maternal_bin(label: Column) -> Column:
    low = F.regexp_extract(label, r"^(\d+) a (\d+) anos$", 1).try_cast("int")
    high = F.regexp_extract(label, r"^(\d+) a (\d+) anos$", 2).try_cast("int")
    return (
        F.when(label.isin("menores 15 ano", "menores 15 anos"), _closed(F.lit(0.0), F.lit(15.0)))
        .when(label == "50 o mas anos", _open(50.0))
        .when(label == "no especificado", _closed(F.lit(None), F.lit(None)))
        .when(low.isin(*range(15, 50, 5)) & (high == low + 4), _closed(low, high + 1))
    )


def single_age(col: Column) -> Column:
    """Single year of age or an open terminal group; null when neither."""
    return let(spanish_label(col), lambda label: let(age_bin(col), lambda b: _single(label, b)))


def _single(label: Column, parsed: Column) -> Column:
    number = r"^(\d+(?:\.0+)?)(?:\s+(?:ano|anos))?$"
    years = F.regexp_extract(label, number, 1).try_cast("double")
    grouped = label.rlike(
        r"^(?:\d+\s+a\s+\d+|menores\s+de\s+(?:1|15)(?:\s+(?:ano|anos))?"
        r"|85\s+o\s+mas|50\s+y\s+mas|100\s+anos\s+y\s+mas)$"
    )
    narrow = parsed["age_open"] | (parsed["age_upper"] - parsed["age_lower"] == 1)
    return F.when(label.rlike(number), _closed(years, years + 1)).when(grouped & narrow, parsed)


def nationality(col: Column) -> Column:
    """C, E or N; blank gives null. Use ``nationality_ok`` to tell blank from invalid."""
    code = strip(col)
    code = F.when(code == "e", "E").otherwise(code)
    return F.when(code.isin("C", "E", "N"), code)


def nationality_ok(col: Column) -> Column:
    return strip(col).isin("", "C", "E", "N", "e")


def commune(col: Column) -> Column:
    """Five-digit commune code; null for the blank and 99999 codes."""
    code = F.trim(col)
    return F.when(~code.isin("", "99999"), F.lpad(code, 5, "0"))


def death_region(code: Column, label: Column) -> Column:
    """Region of residence from commune code and label; null where they conflict."""
    return let(region_label(label), lambda named: _death_region(strip(code), named))


def _death_region(raw: Column, named: Column) -> Column:
    named_code = lookup(named, REGION_CODES)
    padded = F.lpad(raw, 5, "0")
    prefix = F.substring(padded, 1, 2)
    known = (
        raw.rlike(r"^\d{1,5}$")
        & prefix.isin(*[f"{n:02d}" for n in range(1, 17)])
        & (padded != "00000")
        & (named_code == prefix)
    )
    return (
        F.when(raw.isin("", "99999") & named.isin("", "ignorada"), "unknown")
        .when(raw.isin("", "99999"), F.concat(F.lit("CL-"), named_code))
        .when(known, F.concat(F.lit("CL-"), prefix))
    )


def birth_region(code: Column, label: Column) -> Column:
    """Region of the mother's residence from code and label; null where they conflict."""
    return let(region_label(label), lambda named: _birth_region(strip(code), named))


def _birth_region(raw: Column, named: Column) -> Column:
    number = F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))
    text = F.lpad(number.cast("string"), 2, "0")
    return F.when(raw == "99", F.when(named.isin("", "ignorada"), "unknown")).when(
        number.between(1, 16) & (lookup(named, REGION_CODES) == text),
        F.concat(F.lit("CL-"), text),
    )


def cause(col: Column) -> Column:
    return F.when(F.trim(col) == "", "unknown").otherwise(F.trim(col))


def external_cause(col: Column) -> Column:
    code = F.trim(col)
    return (
        F.when(code == "", "not_applicable")
        .when(F.upper(code).isin(*EXTERNAL_PLACEHOLDERS), "unknown_not_coded")
        .otherwise(code)
    )


def cause_code_system(year: Column) -> Column:
    return F.when(year <= 1996, "ICD-9").otherwise("ICD-10")


def region_text_ok(col: Column) -> Column:
    return col.rlike(r"^(?:CL|CL-(?:0[1-9]|1[0-6])|unknown)$")


def same_description(left: Column, right: Column) -> Column:
    """Equality of two descriptions up to white space (compose with ``nfc`` upstream)."""
    return squeeze(left) == squeeze(right)


def rut_digit(body: Column) -> Column:
    """Modulus-11 check digit of a body of digits: weights 2..7 from the right."""
    digits = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    weighted = F.transform(digits, lambda c, i: c.cast("int") * (F.lit(2) + i % F.lit(6)))
    left = 11 - F.aggregate(weighted, F.lit(0), lambda total, x: total + x) % 11
    return F.when(left == 11, "0").when(left == 10, "K").otherwise(left.cast("string"))


def entity_rut(col: Column, digits: int = 8) -> Column:
    """Canonical ``cl-rut:<body>-<digit>``; null when the spelling or digit is wrong.

    A body has at most ``digits`` digits: eight in the register, more in numbers issued past it.
    """
    return F.when(~col.rlike(r"\p{C}"), let(strip(col), lambda raw: _entity_rut(raw, digits)))


def _entity_rut(raw: Column, digits: int) -> Column:
    spelled = (
        raw.rlike(rf"^cl-rut:[1-9]\d{{0,{digits - 1}}}-[0-9Kk]$")
        | raw.rlike(rf"^\d{{1,3}}(?:\.\d{{3}}){{1,{(digits - 1) // 3}}}-[0-9Kk]$")
        | raw.rlike(rf"^\d{{1,{digits}}}-?[0-9Kk]$")
    )
    bare = F.upper(F.regexp_replace(raw, r"^cl-rut:|[.\-]", ""))
    body = F.regexp_extract(bare, r"^0*(\d*)[0-9K]$", 1)
    digit = F.substring(bare, -1, 1)
    sized = F.length(bare).between(2, digits + 1) & (F.length(body) > 0)
    return F.when(
        spelled & sized & (rut_digit(body) == digit),
        F.concat(F.lit("cl-rut:"), body, F.lit("-"), digit),
    )


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed Unicode form; the one text step Spark has no built-in for."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the text of ``columns`` in composed Unicode form.

    Distinct spellings beyond ASCII are composed once, those that change are written as a small
    table and joined back, so Python sees no row and no text twice; with none to change, the rows
    are left as they are. The join is Spark's to plan by the size of that table.
    """
    texts = df.select(F.explode(F.array(*columns)).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]")).distinct()
    changed = stage(texts.withColumn("composed", nfc("text")).where("text <> composed"), "composed")
    if changed.isEmpty():
        return df
    for name in columns:
        spelled = changed.select(F.col("text").alias("__text"), F.col("composed").alias("__composed"))
        joined = df.join(spelled, F.col(name) == F.col("__text"), "left")
        whole = F.coalesce("__composed", name)
        df = joined.select(*[whole.alias(c) if c == name else F.col(c) for c in df.columns])
    return df


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_each(lists: pd.Series) -> pd.Series:
    one = lambda t: t if t is None else unicodedata.normalize("NFC", t)
    return lists.map(lambda texts: None if texts is None else [one(t) for t in texts])


def composed_map(mapping: Column) -> Column:
    """Text-to-text map in composed form; two keys that compose to one fail the query."""
    wide = lambda texts: F.exists(texts, lambda t: F.coalesce(t.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    form = lambda texts: F.coalesce(_nfc_each(F.when(wide(texts), texts)), texts)
    keys, values = form(F.map_keys(mapping)), form(F.map_values(mapping))
    message = F.lit("two keys of a mapping compose to one")
    whole = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values))
    return F.when(mapping.isNotNull(), whole.otherwise(F.raise_error(message).cast("map<string,string>")))
