"""Finish a payload as a one-release batch: stamp, identify, validate, explain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan import contracts as C
from factspan.functions import identity
from factspan.functions.identity import DEFAULT, Scheme
from factspan.functions.text import composed
from factspan.operators.history import content_digests, inconsistent
from factspan.operators.reconcile import null_safe_join, set_status
from factspan.operators.rules import Rule, check, check_absent, enforce_each, report, require
from factspan.operators.rulesets import one_release_report, validate
from factspan.session import stage


@dataclass(frozen=True)
class Release:
    """Metadata of one published release; the data itself is never in here."""

    source_key: str
    vintage: str
    available_at: datetime
    assets: tuple[tuple[str, str], ...]
    released_at: date | None = None
    release_missingness_reason: str | None = None
    provisional: bool = False

    def id_column(self, scheme: Scheme = DEFAULT) -> Column:
        listed = F.array(
            *[
                F.struct(F.lit(k).alias("source_key"), F.lit(h).alias("sha256"))
                for k, h in self.assets
            ]
        )
        return identity.release_id(listed, scheme)

    def stamp(self) -> dict[str, Column]:
        return {
            "source_key": F.lit(self.source_key),
            "vintage": F.lit(self.vintage),
            "released_at": F.lit(self.released_at).cast("date"),
            "release_missingness_reason": F.lit(self.release_missingness_reason).cast("string"),
            "available_at": F.lit(self.available_at).cast("timestamp"),
            "provisional": F.lit(self.provisional),
        }


def complete(df: DataFrame, domain: str, constants: Mapping[str, object]) -> DataFrame:
    """Payload with every non-identity column of the domain, typed and ordered.

    Columns neither in ``df`` nor in ``constants`` are null.
    """
    wanted = [f for f in C.domain_schema(domain).fields if f.name not in C.ID_COLUMNS]
    columns = []
    for field in wanted:
        if field.name in constants:
            value = constants[field.name]
            column = value if isinstance(value, Column) else F.lit(value)
        elif field.name in df.columns:
            column = F.col(field.name)
        else:
            column = F.lit(None)
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def with_ids(
    payload: DataFrame,
    domain: str,
    release: Release,
    source: Mapping[str, str],
    compose: Sequence[str] = (),
    scheme: Scheme = DEFAULT,
) -> DataFrame:
    """Stamp the publisher columns and add the three identifiers.

    ``compose`` names the raw text columns that may hold decomposed characters; all
    others come from closed vocabularies.
    """
    schema = C.domain_schema(domain)
    if any(c in payload.columns for c in C.ID_COLUMNS):
        raise ValueError("identifiers must be absent before they are assigned")
    stamped = payload.withColumns(release.stamp())
    if compose:
        stamped = composed(stamped, compose)
    kinds = {f.name: f.dataType for f in schema.fields}
    key = {c: (F.col(c), kinds[c]) for c in C.DOMAIN_KEY[domain]}
    with_fact = stamped.withColumns(
        {
            "release_id": release.id_column(scheme),
            "fact_id": identity.fact_id(domain, source, key, scheme),
        }
    )
    observation = identity.observation_id(
        F.col("fact_id"),
        F.col("release_id"),
        F.col("vintage"),
        F.col("transformation_id"),
        F.col("transformation_version"),
        F.col("available_at"),
        scheme,
    )
    return with_fact.withColumn("observation_id", observation).select(*schema.fieldNames())


def key_rules(domain: str) -> list[Rule]:
    """Key columns must be null or a real value before they are hashed."""
    doubles = [
        f.name for f in C.DOMAIN_LAYOUT[domain].fields if isinstance(f.dataType, T.DoubleType)
    ]
    return [
        Rule(
            f"{n}_canonical",
            F.col(n).isNull() | ~(F.isnan(n) | (F.abs(F.col(n)) == F.lit(float("inf")))),
        )
        for n in doubles
    ]


def finish(
    payload: DataFrame,
    domain: str,
    release: Release,
    source: Mapping[str, str],
    compose: Sequence[str] = (),
    scheme: Scheme = DEFAULT,
    checked: bool = True,
) -> DataFrame:
    """Validated one-release batch, written once to the shared folder and read back.

    Identifiers are computed in that one write; validation and every later reader use the
    written rows. ``checked=False`` returns the lazy batch and leaves both to the caller.
    """
    batch = with_ids(payload, domain, release, source, compose, scheme)
    if not checked:
        return batch
    written = stage(batch, f"batch-{domain}")
    require(one_release_report(written), release_report(written, release_assets(written, release, scheme), release.source_key))
    return validate(written, domain, scheme, key_rules(domain))


def release_assets(batch: DataFrame, release: Release, scheme: Scheme = DEFAULT) -> DataFrame:
    """The release's own files as manifest assets, one row each."""
    rows = [
        (key, sha, release.released_at, release.release_missingness_reason, release.available_at)
        for key, sha in release.assets
    ]
    kind = "source_key string, sha256 string, released_at date, release_missingness_reason string, available_at timestamp"
    return batch.sparkSession.createDataFrame(rows, kind).withColumn("release_id", release.id_column(scheme))


def identifier_report(
    batch: DataFrame, domain: str, source: Mapping[str, str], scheme: Scheme = DEFAULT
) -> DataFrame:
    """Recompute both identifiers from the stored content and compare."""
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    key = {c: (F.col(c), kinds[c]) for c in C.DOMAIN_KEY[domain]}
    fact = identity.fact_id(domain, source, key, scheme)
    observation = identity.observation_id(
        F.col("fact_id"),
        F.col("release_id"),
        F.col("vintage"),
        F.col("transformation_id"),
        F.col("transformation_version"),
        F.col("available_at"),
        scheme,
    )
    return check(
        batch,
        [
            Rule("fact_id_reproduced", fact == F.col("fact_id")),
            Rule("observation_id_reproduced", observation == F.col("observation_id")),
        ],
    )


# --- provenance ----------------------------------------------------------------

SOURCE = C.layout(
    *C.texts("source_key", "name", "url"),
    ("release_date", C.DT),
    ("release_missingness_reason", C.S),
    ("retrieved_at", C.TS),
    *C.texts("sha256", "vintage"),
    ("provisional", C.B),
)
_LIST = T.ArrayType(T.StringType())
PROVENANCE = C.layout(
    ("sources", T.ArrayType(SOURCE)),
    ("release_id", C.S),
    ("available_at", C.TS),
    ("observation_start", C.DT),
    ("observation_end", C.DT),
    ("dimensions", _LIST),
    ("aggregation_rules", _LIST),
    ("missingness_reason", C.S),
    ("transformation_ids", _LIST),
    ("notes", _LIST),
)


def provenance_row(
    spark: SparkSession,
    release: Release,
    start: date,
    end: date,
    dimensions: Sequence[str],
    rules: Sequence[str],
    missingness: str,
    transformations: Sequence[str] = (),
    notes: Sequence[str] = (),
    names: Mapping[str, tuple[str, str]] | None = None,
    scheme: Scheme = DEFAULT,
) -> DataFrame:
    """One provenance row of a result. ``names`` maps source keys to (name, url)."""
    sources = [
        (
            key,
            (names or {}).get(key, (key, None))[0],
            (names or {}).get(key, (key, None))[1],
            release.released_at,
            release.release_missingness_reason,
            release.available_at,
            sha,
            release.vintage,
            release.provisional,
        )
        for key, sha in release.assets
    ]
    row = (
        sources,
        None,
        release.available_at,
        start,
        end,
        list(dimensions),
        list(rules),
        missingness,
        list(transformations),
        list(notes),
    )
    return spark.createDataFrame([row], PROVENANCE).withColumn(
        "release_id", release.id_column(scheme)
    )


def merged_provenance(
    provenance: DataFrame,
    group: Sequence[str],
    rule: str,
    transformation: str,
) -> DataFrame:
    """Provenance of a result derived from several inputs.

    Latest clock, widest dates, ordered unions. The lists hold names of sources and rules,
    a few per release; each is reduced to distinct values while it is combined.
    """
    def union_of(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))

    return provenance.groupBy(*group).agg(
        F.max("available_at").alias("available_at"),
        F.min("observation_start").alias("observation_start"),
        F.max("observation_end").alias("observation_end"),
        F.array_distinct(F.concat(union_of("aggregation_rules"), F.array(F.lit(rule)))).alias(
            "aggregation_rules"
        ),
        F.array_distinct(
            F.concat(union_of("transformation_ids"), F.array(F.lit(transformation)))
        ).alias("transformation_ids"),
    )


_ROOM = 1 << 31  # entries of one list


def first_seen(lists: DataFrame, group: Sequence[str], columns: Sequence[str], position: str) -> DataFrame:
    """Ordered unions of list columns: per group, every element once, by where it stands first.

    Elements are reduced to (element, least place) rows in the map tasks; an array is only built of
    the distinct ones that are left. ``position`` numbers the rows of a group from 0; null lists
    are empty and null elements are left out.
    """
    def entries(name: str) -> Column:
        def entry(element: Column, index: Column) -> Column:
            place = (F.col(position) * F.lit(_ROOM) + index).cast("bigint")
            return F.struct(F.lit(name).alias("field"), element.alias("element"), place.alias("place"))

        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), entry)

    sides = [entries(c) for c in columns]
    parts = lists.select(*group, F.inline(F.concat(*sides))).where("element is not null")
    least = parts.groupBy(*group, "field", "element").agg(F.min("place").alias("place"))
    held = lambda c: F.collect_list(F.when(F.col("field") == c, F.struct("place", "element")))
    ordered = lambda c: F.transform(F.array_sort(held(c)), lambda x: x["element"])
    return least.groupBy(*group).agg(*[ordered(c).alias(c) for c in columns])


def derived_provenance(
    provenance: DataFrame,
    group: Sequence[str],
    position: str,
    dimensions: Sequence[str],
    rule: str,
    transformation: str,
    missingness: str,
    role: str = "role",
    scheme: Scheme = DEFAULT,
) -> DataFrame:
    """One provenance row per group for a result derived from the rows of the group.

    ``position`` orders the inputs from 0 and ``role`` names them. Sources, rules, transformations
    and notes are united in the order of their first appearance, the result's own rule and
    transformation last; one source key with two artifacts fails the query. The clock is the latest,
    the dates are the widest, the release is issued anew from the sources' artifacts, and the
    reason for missing values names every input's.
    """
    lists = ["aggregation_rules", "transformation_ids", "notes"]
    united = first_seen(provenance, group, lists, position)
    spans = provenance.groupBy(*group).agg(
        F.max("available_at").alias("available_at"),
        F.min("observation_start").alias("observation_start"),
        F.max("observation_end").alias("observation_end"),
        F.concat_ws("; ", F.transform(
            F.array_sort(F.collect_list(F.struct(
                F.col(position).alias("p"), F.concat(F.col(role), F.lit("="), F.col("missingness_reason")).alias("m")
            ))), lambda x: x["m"],
        ), F.lit(missingness)).alias("missingness_reason"),
    )
    fields = [f.name for f in SOURCE]
    sources = provenance.select(*group, position, F.posexplode("sources").alias("__i", "__source"))
    place = (F.col(position) * F.lit(_ROOM) + F.col("__i")).cast("bigint")
    flat = sources.select(*group, place.alias("place"), *[F.col(f"__source.{f}").alias(f) for f in fields])
    d1, d2 = content_digests(flat, fields)
    artifact = F.struct("place", F.struct(*fields).alias("s"))
    one = flat.withColumns({"d1": d1, "d2": d2}).groupBy(*group, "source_key").agg(
        F.min(artifact).alias("first"), F.expr("min(d1) = max(d1) AND min(d2) = max(d2)").alias("same")
    )
    one = enforce_each(one, F.col("same"), "a source key stands for two artifacts")
    kept = one.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list("first")), lambda x: x["s"]).alias("sources")
    )
    own = lambda c, name: F.array_distinct(F.concat(F.col(c), F.array(F.lit(name))))
    joined = null_safe_join(null_safe_join(spans, united, list(group), "left"), kept, list(group), "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumns({c: F.coalesce(c, none) for c in lists})
    # the release is one of the columns; a group by it keeps its old name as ``input_release_id``
    columns = {
        "sources": F.col("sources"), "release_id": identity.release_id(F.col("sources"), scheme),
        "available_at": F.col("available_at"), "observation_start": F.col("observation_start"),
        "observation_end": F.col("observation_end"), "dimensions": F.array(*map(F.lit, dimensions)),
        "aggregation_rules": own("aggregation_rules", rule), "missingness_reason": F.col("missingness_reason"),
        "transformation_ids": own("transformation_ids", transformation), "notes": F.col("notes"),
    }
    keys = [F.col(g).alias("input_release_id" if g == "release_id" else g) for g in group]
    return joined.select(*keys, *[c.alias(n) for n, c in columns.items()])


def conflicting_sources(provenance: DataFrame) -> DataFrame:
    """Source keys that stand for two different artifacts."""
    sources = provenance.select(F.inline("sources"))
    return inconsistent(sources, "source_key", [c for c in sources.columns if c != "source_key"])


def release_report(
    batch: DataFrame, assets: DataFrame, primary: str, scheme: Scheme = DEFAULT
) -> DataFrame:
    """Publisher columns of a batch against the primary asset and the manifest clock."""
    clock = assets.groupBy("release_id").agg(F.max("available_at").alias("m_available_at"))
    first = assets.where(F.col("source_key") == primary).select(
        "release_id",
        F.col("released_at").alias("m_released_at"),
        F.col("release_missingness_reason").alias("m_reason"),
    )
    distinct = batch.select(
        "release_id", "source_key", "released_at", "release_missingness_reason", "available_at"
    ).distinct()
    joined = distinct.join(clock, "release_id", "left").join(first, "release_id", "left")
    return report(
        check(
            joined,
            [
                Rule("source_is_primary", F.col("source_key") == primary),
                Rule("released_at_equal", F.col("released_at").eqNullSafe(F.col("m_released_at"))),
                Rule(
                    "reason_equal",
                    F.col("release_missingness_reason").eqNullSafe(F.col("m_reason")),
                ),
                Rule("clock_is_latest_asset", F.col("available_at") == F.col("m_available_at")),
            ],
        ),
        check_absent(
            distinct.groupBy("release_id").count().where("count > 1"), "one_stamp_per_release"
        ),
    )


def archive_binding_rules(official: bool, key: str, member: str) -> list[Rule]:
    """An archive is bound to its official key and member, or openly a local fixture."""
    named = (F.col("source_key") == key) & (F.col("member") == member)
    local = F.col("source_key").startswith("local_fixture_")
    return [Rule("archive_binding", named if official else local)]


def evidence_status(assets: DataFrame, other: DataFrame) -> DataFrame:
    """Manifest assets against acquired files or provenance sources, per release and key.

    Both sides carry release_id, source_key, sha256, released_at,
    release_missingness_reason and available_at.
    """
    return set_status(
        assets,
        other,
        ["release_id", "source_key"],
        ["sha256", "released_at", "release_missingness_reason", "available_at"],
    )


def release_evidence(manifest: DataFrame, acquired: DataFrame, provenance: DataFrame) -> DataFrame:
    """Manifest, acquired files and provenance sources in one table, per release and source key.

    ``files`` and ``provenance`` tell how each compares with the manifest (equal, different,
    only_left where the manifest alone has the key, only_right); null where neither has it.
    """
    sides = [
        evidence_status(manifest, other).withColumnRenamed("status", name)
        for other, name in ((acquired, "files"), (provenance, "provenance"))
    ]
    return null_safe_join(sides[0], sides[1], ["release_id", "source_key"], "full_outer")


def provenance_assets(provenance: DataFrame) -> DataFrame:
    """Sources of provenance rows in the shape of manifest assets."""
    return provenance.select("release_id", F.inline("sources")).select(
        "release_id",
        "source_key",
        "sha256",
        F.col("release_date").alias("released_at"),
        "release_missingness_reason",
        F.col("retrieved_at").alias("available_at"),
    )


def validation_record(batch: DataFrame, domain: str, scheme: Scheme = DEFAULT) -> DataFrame:
    """Validate a batch once and record it; readers trust the record instead of repeating."""
    validate(batch, domain, scheme)
    return batch.groupBy("domain", "release_id", "available_at").agg(
        F.count(F.lit(1)).alias("rows"), F.current_timestamp().alias("validated_at")
    )
