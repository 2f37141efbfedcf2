"""Raw file scans, archives, attestation and sinks.

Every scan passes an explicit schema; nothing is inferred.
"""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions import dates, identity
from factspan.operators.reconcile import key_difference, set_status
from factspan.operators.rules import (
    ContractViolation,
    check,
    check_absent,
    check_unique,
    enforce_each,
    report,
    require,
)
from factspan.operators.rulesets import LOGICAL_TYPES, curated_type_rules
from factspan.operators.series import archive_row_numbers, block_offsets
from factspan.session import new_path, stage

# fixed values: column names and order of the published death file
DEATH_COLUMNS = (
    "AÑO",
    "FECHA_DEF",
    "SEXO_NOMBRE",
    "EDAD_TIPO",
    "EDAD_CANT",
    "COD_COMUNA",
    "COMUNA",
    "NOMBRE_REGION",
    "DIAG1",
    "CAPITULO_DIAG1",
    "GLOSA_CAPITULO_DIAG1",
    "CODIGO_GRUPO_DIAG1",
    "GLOSA_GRUPO_DIAG1",
    "CODIGO_CATEGORIA_DIAG1",
    "GLOSA_CATEGORIA_DIAG1",
    "CODIGO_SUBCATEGORIA_DIAG1",
    "GLOSA_SUBCATEGORIA_DIAG1",
    "DIAG2",
    "CAPITULO_DIAG2",
    "GLOSA_CAPITULO_DIAG2",
    "CODIGO_GRUPO_DIAG2",
    "GLOSA_GRUPO_DIAG2",
    "CODIGO_CATEGORIA_DIAG2",
    "GLOSA_CATEGORIA_DIAG2",
    "CODIGO_SUBCATEGORIA_DIAG2",
    "GLOSA_SUBCATEGORIA_DIAG2",
    "LUGAR_DEFUNCION",
)
STAGED_DEATH_COLUMNS = (
    "AÑO",
    "FECHA_DEF",
    "SEXO_NOMBRE",
    "EDAD_TIPO",
    "EDAD_CANT",
    "COD_COMUNA",
    "COMUNA",
    "NOMBRE_REGION",
    "DIAG1",
    "CAPITULO_DIAG1",
    "CODIGO_GRUPO_DIAG1",
    "CODIGO_CATEGORIA_DIAG1",
    "CODIGO_SUBCATEGORIA_DIAG1",
    "DIAG2",
)
# fixed values: column names and order of the published birth files
CHILD_COLUMNS = ("HIJ_VIVOS", "HIJ_FALL", "HIJ_MORT", "HIJ_TOTAL")
BIRTH_COLUMNS_25 = (
    "MES_NAC",
    "ANO_NAC",
    "SEXO",
    "TIPO_PARTO",
    "TIPO_ATEN",
    "PARTO_LOCAL",
    "SEMANAS",
    "RANGO_PESO",
    "TALLA",
    "GRUPO_ETARIO_PADRE",
    "CURSO_PADRE",
    "NIVEL_PADRE",
    "ACTIV_PADRE",
    "OCUPA_PADRE",
    "CATEG_PADRE",
    "GRUPO_ETARIO_MADRE",
    "EST_CIV_MADRE",
    "CURSO_MADRE",
    "NIVEL_MADRE",
    "ACTIV_MADRE",
    "OCUPA_MADRE",
    "CATEG_MADRE",
    "NACIONALIDAD_MADRE",
    "REGION_RESIDENCIA",
    "GLOSA_REGION_RESIDENCIA",
)
BIRTH_COLUMNS_29 = (*BIRTH_COLUMNS_25[:22], *CHILD_COLUMNS, *BIRTH_COLUMNS_25[22:])
BIRTH_PROFILES = {25: BIRTH_COLUMNS_25, 29: BIRTH_COLUMNS_29}
# fixed values: columns of the pensioner extract
PENSIONER_SCHEMA = T.StructType(
    [
        T.StructField("ORIGEN", T.IntegerType()),
        T.StructField("ID", T.StringType()),
        T.StructField("TABLA", T.IntegerType()),
        T.StructField("FEC_VIG", T.IntegerType()),
        T.StructField("FIN_EXPOSIC", T.IntegerType()),
        T.StructField("SEXO", T.StringType()),
        T.StructField("COD_REL", T.IntegerType()),
        T.StructField("BEN_COD_INV", T.StringType()),
        T.StructField("FEC_NAC", T.IntegerType()),
        T.StructField("FEC_FALL", T.IntegerType()),
    ]
)
# fixed values: bundled tables and the columns each must have
BUNDLE = {
    "births_age": (
        "births_by_maternal_age.csv",
        {"age_group": "string", "births_total": "bigint", "period": "string"},
    ),
    "deaths_age": (
        "deaths_by_age_sex.csv",
        {
            "age_group": "string",
            "deaths_total": "bigint",
            "deaths_male": "bigint",
            "deaths_female": "bigint",
            "period": "string",
        },
    ),
    "population_age": (
        "population_by_age_sex.csv",
        {
            "age_group": "string",
            "population_total": "bigint",
            "population_male": "bigint",
            "population_female": "bigint",
        },
    ),
    "monthly": (
        "monthly_births_deaths.csv",
        {
            "period": "string",
            "births_total": "bigint",
            "deaths_total": "bigint",
            "source_url": "string",
        },
    ),
}


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of one delimited file; reads its first line only."""
    _allow_charset(spark, encoding)
    line = (
        spark.read.option("sep", "\u0001")
        .option("encoding", encoding)
        .option("quote", "")
        .schema("line string")
        .csv(path)
        .limit(1)
        .collect()
    )
    if not line or line[0]["line"] is None:
        raise ContractViolation([("header present", 1)])
    return [name.strip('"') for name in line[0]["line"].lstrip("\ufeff").split(sep)]


def require_header(found: Sequence[str], expected: Sequence[str]) -> None:
    if list(found) != list(expected):
        raise ContractViolation([("header names and order", 1)])


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    if encoding.lower().startswith("windows"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def scan_text(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    keep: Sequence[str] | None = None,
    sep: str = ";",
    encoding: str = "UTF-8",
) -> DataFrame:
    """Delimited file with a header as text columns; an empty field is '', never null.

    The scan itself compares every file's header with the schema and fails on a difference.
    """
    _allow_charset(spark, encoding)
    raw = (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in keep or columns])


def scan_deaths(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    return scan_text(spark, path, DEATH_COLUMNS, STAGED_DEATH_COLUMNS, ";", encoding)


def scan_births(spark: SparkSession, path: str, profile: int = 25) -> DataFrame:
    return scan_text(spark, path, BIRTH_PROFILES[profile])


def scan_pensioners(spark: SparkSession, path: str) -> DataFrame:
    """Pensioner rows without the person identifier, which is never read."""
    return (
        spark.read.schema(PENSIONER_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", ";")
        .option("mode", "FAILFAST")
        .csv(path)
        .drop("ID")
    )


def read_table(spark: SparkSession, path: str, required: Mapping[str, str]) -> DataFrame:
    """CSV with required typed columns; extra columns come as text."""
    found = header_of(spark, path)
    missing = [c for c in required if c not in found]
    if missing:
        raise ContractViolation([(f"missing column {c}", 1) for c in missing])
    schema = ", ".join(f"`{c}` {required.get(c, 'string')}" for c in found)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def load_bundle(
    spark: SparkSession, directory: str, names: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """The four bundled tables; the monthly one is sorted by period."""
    tables = {
        key: read_table(spark, f"{directory}/{(names or {}).get(key, file)}", columns)
        for key, (file, columns) in BUNDLE.items()
    }
    tables["monthly"] = tables["monthly"].orderBy("period")
    return tables


def read_curated(
    spark: SparkSession,
    path: str,
    columns: Sequence[tuple[str, str]],
    optional: Sequence[str] = (),
) -> DataFrame:
    """Attested curated CSV: exact header, every cell of its logical type, not empty."""
    raw = (
        spark.read.schema(text_schema([c for c, _ in columns]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    empty = raw.limit(1).groupBy().count().select(
        F.lit("not_empty").alias("rule_id"),
        F.when(F.col("count") == 0, 1).otherwise(0).cast("bigint").alias("failed"),
        F.lit(None).cast("string").alias("sample_key"),
    )
    require(check(raw, curated_type_rules(columns, optional)), empty)
    typed = [
        (dates.strict_iso(F.col(c)) if kind == "date" else F.col(c).try_cast(LOGICAL_TYPES[kind]))
        .alias(c)
        for c, kind in columns
    ]
    return raw.select(*typed)


# --- archives ------------------------------------------------------------------

LISTING = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("crc_ok", T.BooleanType()),
    ]
)
LINES = T.StructType(
    [T.StructField("archive", T.StringType()), T.StructField("value", T.StringType())]
)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of every ZIP archive under ``path``: name, size, checksum state."""

    def listing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        crc = 0
                        with archive.open(info) as member:
                            try:
                                while block := member.read(1 << 20):
                                    crc = zlib.crc32(block, crc)
                                sound = crc == info.CRC
                            except zipfile.BadZipFile:
                                sound = False
                        rows.append((name, info.filename, info.file_size, sound))
            yield pd.DataFrame(rows, columns=LISTING.fieldNames())

    return _archives(spark, path).mapInPandas(listing, LISTING)


def member_report(listing: DataFrame, expected: str) -> DataFrame:
    """Every archive holds exactly the expected member, sound, and no other table file."""
    per_archive = listing.groupBy("archive").agg(
        F.count_if(F.col("member") == expected).alias("exact"),
        F.count_if(
            F.lower("member").rlike(r"\.(csv|txt)$") & (F.col("member") != expected)
        ).alias("others"),
        F.count_if((F.col("member") == expected) & ~F.col("crc_ok")).alias("damaged"),
    )
    return report(
        check_absent(per_archive.where("exact <> 1"), "one_exact_member"),
        check_absent(per_archive.where("others > 0"), "no_other_table"),
        check_absent(per_archive.where("damaged > 0"), "member_sound"),
    )


def land_member(
    spark: SparkSession, path: str, member: str, landing: str, encoding: str = "UTF-8"
) -> None:
    """Write one member of every archive as UTF-8 text, so later scans split it freely.

    A ZIP stream cannot be split: one task reads one archive, passing lines on in small
    batches. Lines keep their order in the one file each archive gives.
    """
    require(member_report(list_members(spark, path), member))

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as raw:
                    text = io.TextIOWrapper(
                        raw, encoding="utf-8-sig" if encoding == "UTF-8" else encoding
                    )
                    while batch := text.readlines(1 << 20):
                        yield pd.DataFrame(
                            {"archive": name, "value": [row.rstrip("\r\n") for row in batch]}
                        )

    _archives(spark, path).mapInPandas(lines, LINES).select("value").write.text(landing)


# --- attestation ---------------------------------------------------------------


REACH = 128 << 20
PIECE = 4 << 20
BOM = b"\xef\xbb\xbf"
#: Spark's text reader unpacks files of these names, so their bytes cannot be read in splits.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|lz4|snappy|zst)$"


def attest_files(spark: SparkSession, path: str, reach: int = REACH) -> DataFrame:
    """Name, SHA-256 and size of every file under ``path``.

    SHA-256 is a chain: every block needs the state after the one before. A file of more than
    ``reach`` bytes is read in splits by many tasks and hashed in rounds of ``reach`` bytes, each
    going on from the state of the last, so no task holds more than a few splits; all files advance
    in the same round. Smaller ones, and large ones that a codec's name ends, are read whole.
    """
    place, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    chained = (size > reach) & ~place.rlike(PACKED)
    # conditions on the metadata alone choose files before any content is read
    # (which spells paths as URLs, so names come from the path itself)
    every, name = spark.read.format("binaryFile").load(path), F.element_at(F.split("path", "/"), -1).alias("name")
    found = every.where(~chained).select(name, F.sha2("content", 256).alias("sha256"), size.alias("bytes"))
    large = every.where(chained).select(name, place.alias("file"), size.alias("bytes"))
    if large.isEmpty():
        return found
    large = stage(large, "large-files")
    digests = _chained(spark, path, chained, large.select(F.col("file").alias("path"), "bytes"), reach)
    named = large.select("name", "file").join(digests, F.col("file") == F.col("path"))
    return found.unionAll(named.select("name", "sha256", "bytes"))


def _chained(spark: SparkSession, path: str, chained: Column, large: DataFrame, reach: int) -> DataFrame:
    """(path, sha256, bytes) of large files, hashed over their splits in order."""
    lines = spark.read.option("lineSep", "\n").text(path).where(chained).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("path", "start", "value")), strict=True)
            for split, group in groupby(rows, itemgetter(0, 1)):
                at = at if split == here else 0
                here = split
                body = b"".join([part for r in group for part in (r[2], b"\n")])
                for i in range(0, len(body), PIECE):
                    piece = body[i : i + PIECE]
                    cells = {"path": split[0], "start": split[1], "at": at + i, "length": len(piece), "piece": piece}
                    yield pa.RecordBatch.from_pylist([cells], schema=layout)
                at += len(body)

    layout = pa.schema([("path", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("piece", pa.binary())])
    folder = new_path(spark, "file-pieces")
    pieces = lines.mapInArrow(packed, "path string, start bigint, at bigint, length bigint, piece binary")
    pieces.withColumn("round", F.floor(F.col("start") / reach)).write.partitionBy("round").parquet(folder)
    pieces = spark.read.parquet(folder)
    # every line counts one line feed, which the last may lack, and the reader drops a byte order mark
    total = pieces.groupBy("path").agg(F.sum("length").alias("total"))
    extra = F.col("total") - F.col("bytes")
    known = enforce_each(large.join(total, "path", "left"), extra.isin(-3, -2, 0, 1), "a file changed while it was read")
    states = stage(
        known.select("path", "bytes", extra.isin(-3, -2).alias("marked"), F.lit(0).cast("bigint").alias("done"),
                     F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256")), "file-states"
    )

    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # hashlib keeps its state to itself; the library below it has it as 112 plain bytes
        library = ctypes.CDLL(_hashlib.__file__)
        rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        for name, group in groupby(rows, itemgetter("path")):
            done = None
            for r in group:
                if done is None:
                    done, end, marked, state = r["done"], r["bytes"], r["marked"], ctypes.create_string_buffer(r["state"] or b"", 112)
                    if r["state"] is None:
                        library.SHA256_Init(state)
                piece = (BOM if marked and not done else b"") + r["piece"]
                piece = piece[: end - done]
                library.SHA256_Update(state, piece, ctypes.c_size_t(len(piece)))
                done += len(piece)
            digest, kept = None, state.raw
            if done == end:
                out = ctypes.create_string_buffer(32)
                library.SHA256_Final(out, state)
                digest = out.raw.hex()
            cells = {"path": name, "bytes": end, "marked": marked, "done": done, "state": kept, "sha256": digest}
            yield pa.RecordBatch.from_pylist([cells], schema=after)

    after = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("marked", pa.bool_()), ("done", pa.int64()),
                       ("state", pa.binary()), ("sha256", pa.string())])
    for number in range(pieces.agg(F.max("round")).first()[0] + 1):
        turn = pieces.where(F.col("round") == number).select("path", "start", "at", "piece").join(states, "path")
        ordered = turn.repartition("path").sortWithinPartitions("path", "start", "at")
        new = stage(ordered.mapInArrow(advanced, states.schema), "file-states")
        states = stage(new.unionAll(states.join(new, "path", "left_anti")), "file-states")
    return enforce_each(states, F.col("sha256").isNotNull(), "a file was not read to its end").select("path", "sha256", "bytes")


def attestation_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file of either side: equal, different, only_left (found), only_right (listed)."""
    return set_status(files, manifest, ["name"], ["sha256", "bytes"])


def number_rows(scan: DataFrame, archive: str = "archive_id") -> DataFrame:
    """Contiguous archive row numbers of a scan made by ``scan_with_position``.

    The scan is written first, with the block and order of every row, so that both passes
    over it see the same blocks however the files are split later: one counts the rows of
    each block, the other adds the block's offset. The offsets are written too, so Spark
    knows their size and sends them to every task when they are small.
    """
    scan = stage(scan, "positioned-scan")
    offsets = stage(block_offsets(scan, archive, "__block", "__order"), "block-offsets")
    return archive_row_numbers(scan, offsets, archive, "__block", "__order")


def scan_with_position(
    spark: SparkSession, path: str, columns: Sequence[str], archive_id: str, sep: str = ";"
) -> DataFrame:
    """Text scan that also carries the file block and the order inside it."""
    raw = (
        spark.read.schema(text_schema(columns))
        .option("header", True)
        .option("enforceSchema", False)
        .option("sep", sep)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return raw.select(
        F.lit(archive_id).alias("archive_id"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns],
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        ).alias("__block"),
        F.monotonically_increasing_id().alias("__order"),
    )


def child_sidecar(spark: SparkSession, path: str, archive_id: str) -> DataFrame:
    """Raw child-count columns of the 29-column profile with their archive row number."""
    scan = scan_with_position(spark, path, BIRTH_COLUMNS_29, archive_id).select(
        "archive_id", *CHILD_COLUMNS, "__block", "__order"
    )
    return number_rows(scan).select("archive_id", "archive_row_number", *CHILD_COLUMNS)


# --- sinks and inventory -------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition: str) -> None:
    writer = df.write
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def inventory_report(
    assets: DataFrame, acquired: DataFrame, available: DataFrame, unavailable: DataFrame
) -> DataFrame:
    """Source inventory rules over tables of keys (column ``key``)."""
    return report(
        check_unique(assets, ["key"], "asset_key_unique"),
        check_unique(acquired, ["key"], "acquired_unique"),
        check_unique(available, ["key"], "available_unique"),
        check_unique(unavailable, ["key"], "unavailable_unique"),
        check_absent(acquired.join(available, "key", "left_anti"), "acquired_is_available"),
        check_absent(unavailable.join(available, "key", "left_semi"), "unavailable_is_absent"),
        check_absent(available.join(assets, "key", "left_anti"), "available_is_declared"),
    )


def same_assets(found: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Asset rows held by one side only (empty when the sets are equal)."""
    return key_difference(
        found, reviewed, ["source_key", "sha256", "released_at", "release_missingness_reason"]
    )


def layout_digest(schema: T.StructType, ordinal: str) -> str:
    """SHA-256 of the names and types of all columns but the ordinal, in their order."""
    cells = [f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields if f.name != ordinal]
    return hashlib.sha256("\n".join(cells).encode()).hexdigest()


def digest_tree(df: DataFrame, ordinal: str, fan: int = 4096) -> DataFrame:
    """(level, block, sha256) rows of a tree of digests over the rows in the order of an ordinal.

    A row is the digest of its typed cells (``identity.row_digest``), so numbers count by their bits
    and null is not the text "null". Level 1 holds a digest per block of ``fan`` ordinals, every
    level above one per ``fan`` blocks, up to a single block 0; no group has more than ``fan``
    entries. The ordinal is a whole number from 0, each at most once (a second row with it changes
    its block); numbers may be missing. The largest ordinal tells the levels. An empty table has
    no rows.
    """
    last = df.agg(F.max(F.col(ordinal).cast("bigint"))).first()[0] or 0
    row = identity.row_digest([(f.name, f.dataType) for f in df.schema.fields if f.name != ordinal])
    place = F.col(ordinal).cast("bigint")
    checked = enforce_each(df, place >= 0, "an ordinal is missing or negative")
    level = checked.select(place.alias("i"), row.alias("d"))
    found, height, number = None, 1, 1
    while last // fan**height:
        height += 1
    for number in range(1, height + 1):
        entries = F.array_sort(F.collect_list(F.struct("i", "d")))
        # a missing entry and one at another place differ, so places are hashed too
        spelled = F.transform(entries, lambda r: F.concat((r["i"] % fan).cast("string"), F.lit(":"), r["d"]))
        grouped = level.groupBy(F.floor(F.col("i") / fan).alias("block")).agg(
            F.sha2(F.array_join(spelled, "\n"), 256).alias("sha256")
        )
        grouped = stage(grouped.select(F.lit(number).alias("level"), "block", "sha256"), "digest-tree")
        found = grouped if found is None else found.unionAll(grouped)
        level = grouped.select(F.col("block").alias("i"), F.col("sha256").alias("d"))
    return found


def table_checksum(df: DataFrame, ordinal: str, fan: int = 4096) -> DataFrame:
    """SHA-256 of a table: its layout and the top of its ``digest_tree``; no row for an empty table."""
    tree = digest_tree(df, ordinal, fan)
    top = tree.agg(F.max("level")).first()[0] or 1
    head = layout_digest(df.schema, ordinal)
    return tree.where(F.col("level") == top).select(
        F.sha2(F.concat_ws("\n", F.lit(head), "sha256"), 256).alias("sha256")
    )


def changed_blocks(left: DataFrame, right: DataFrame, fan: int = 4096) -> DataFrame:
    """(block, first, last) of the ordinals whose rows differ between two digest trees.

    Compared from the top: a block is looked at only where the block above it differs, so equal
    tables cost one comparison. The trees are of one ``fan``; a taller one has grown.
    """
    tops = [t.agg(F.max("level")).first()[0] or 0 for t in (left, right)]
    suspects = None
    for level in range(max(tops), 0, -1):
        sides = [t.where(F.col("level") == level).select("block", F.col("sha256")) for t in (left, right)]
        if suspects is not None:
            sides = [s.join(suspects, F.floor(s["block"] / fan) == suspects["above"], "left_semi") for s in sides]
        a, b = sides[0].withColumnRenamed("sha256", "a"), sides[1].withColumnRenamed("sha256", "b")
        apart = a.join(b, "block", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        suspects = stage(apart.select(F.col("block").alias("above")), "changed-blocks")
        # a lower tree has nothing to compare at the upper levels: all blocks below are suspects
        if level > min(tops):
            suspects = None
    if suspects is None:
        blocks = left.unionAll(right).where("level = 1").select("block").distinct()
    else:
        blocks = suspects.select(F.col("above").alias("block"))
    return blocks.select("block", (F.col("block") * fan).alias("first"), (F.col("block") * fan + fan - 1).alias("last"))


def content_digest(df: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """Order-free digest of a table of any size: row count and sum of row hashes (``xxhash64`` by default)."""
    digest = (F.xxhash64(*df.columns) if row_hash is None else row_hash).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).alias("digest"))
