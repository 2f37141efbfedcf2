"""Atomic appends to a table of releases.

An append writes its rows into a folder of its own and, last, one commit file that names the folder
and the releases in it. Readers take the commit files first and read the folders they name, so rows
of an append that was killed are never seen. Commit files are numbered; a number is taken by
renaming a finished file onto it, which fails if it exists, so of two writers one starts again from
the other's state. A shared file system must refuse a rename onto an existing file, as HDFS does.

Layout: ``log/<number>.json`` and ``data/commit=<token>/domain=.../release_id=.../``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYOUT = ("domain", "release_id")
_ENTRY = "number long, token string, rows long, releases array<string>"


@dataclass(frozen=True)
class Commit:
    number: int
    token: str
    rows: int
    releases: frozenset[str]


class Taken(RuntimeError):
    """Another writer has taken the commit number."""


def _hadoop(spark: SparkSession, path: str):
    """(path, its file system, its file context)"""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    at = system.makeQualified(at)
    return at, system, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """Commits of the table in order; none where nothing was committed."""
    at, system, _ = _hadoop(spark, f"{path}/log")
    if not system.exists(at):
        return []
    found = spark.read.schema(_ENTRY).json(f"{path}/log/*.json").collect()  # one row per append
    return sorted(
        (Commit(r["number"], r["token"], r["rows"], frozenset(r["releases"])) for r in found), key=lambda c: c.number
    )


def commit(spark: SparkSession, path: str, entry: Commit) -> None:
    """Make the folder of ``entry`` visible under its number, or raise ``Taken``."""
    text = json.dumps(
        {"number": entry.number, "token": entry.token, "rows": entry.rows, "releases": sorted(entry.releases)}
    )
    spare, system, context = _hadoop(spark, f"{path}/log/.{entry.token}-{entry.number}")
    out = system.create(spare, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    once = spark.sparkContext._gateway.new_array(options, 1)
    once[0] = options.NONE
    target = _hadoop(spark, f"{path}/log/{entry.number:012d}.json")[0]
    try:
        context.rename(spare, target, once)
    except Py4JJavaError as error:
        system.delete(spare, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise Taken(f"commit {entry.number} exists") from error
        raise


def folder(path: str, token: str) -> str:
    return f"{path}/data/commit={token}"


def read(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """Committed rows, of all commits or of those numbered up to ``upto``."""
    parts = [folder(path, c.token) for c in commits(spark, path) if upto is None or c.number <= upto]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*parts)
    return rows.select(*schema.fieldNames())


def _fresh(batch: DataFrame, path: str, known: list[Commit], releases: set[str], key: str) -> DataFrame:
    """Rows of the batch that no commit holds; commits of other releases are not read."""
    parts = [folder(path, c.token) for c in known if c.releases & releases]
    if not parts:
        return batch
    held = batch.sparkSession.read.schema(batch.schema).option("basePath", f"{path}/data").parquet(*parts)
    held = held.where(F.col("release_id").isin(sorted(releases))).select("release_id", key)
    return batch.join(held, ["release_id", key], "left_anti").select(*batch.columns)


def append(batch: DataFrame, path: str, key: str = "observation_id") -> Commit | None:
    """Add the rows of ``batch`` whose release does not hold their ``key`` yet; None if there are none.

    A repeated append adds nothing, and a release may come in several parts. A repeated row of the
    batch itself is written once.
    """
    spark = batch.sparkSession
    releases = {r[0] for r in batch.select("release_id").distinct().collect()}  # one row per release of the batch
    if None in releases:
        raise ValueError("a row has no release")
    known = commits(spark, path)
    while True:
        token = uuid.uuid4().hex
        _fresh(batch, path, known, releases, key).distinct().write.partitionBy(*LAYOUT).parquet(folder(path, token))
        written = spark.read.schema(batch.schema).option("basePath", f"{path}/data").parquet(folder(path, token))
        rows = {r["release_id"]: r["count"] for r in written.groupBy("release_id").count().collect()}
        if not rows:
            return None
        while True:
            entry = Commit(max((c.number for c in known), default=0) + 1, token, sum(rows.values()), frozenset(rows))
            try:
                commit(spark, path, entry)
                return entry
            except Taken:
                seen = {c.number for c in known}
                known = commits(spark, path)
                if any(c.releases & releases for c in known if c.number not in seen):
                    break  # the other writer may hold the same rows: start again from its state


def uncommitted(spark: SparkSession, path: str) -> list[str]:
    """Folders of appends that never committed; they may go once no writer is at work."""
    at, system, _ = _hadoop(spark, f"{path}/data")
    if not system.exists(at):
        return []
    held = {f"commit={c.token}" for c in commits(spark, path)}
    names = [status.getPath().getName() for status in system.listStatus(at)]
    return sorted(f"{path}/data/{n}" for n in names if n.startswith("commit=") and n not in held)
