"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_LOCAL_FALLBACK: dict[str, str] = {}


def session(app: str = "factspan", **conf: str) -> SparkSession:
    """Session with the settings the package relies on (UTC clock, AQE, skew splits)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the package relies on; explicit settings of the session win.

    The JVM never compiles a method beyond 8000 bytecodes. Wide rule sets and label parsers
    generate such methods when fused into one stage, so Spark is told to keep them apart.
    """
    if spark.conf.get(METHOD_LIMIT, None) in (None, "65535"):
        spark.conf.set(METHOD_LIMIT, "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local fallback exists only for ``local[...]`` masters (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="factspan-")
    return _LOCAL_FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back.

    Used where one expensive input feeds several jobs. The written table outlives
    executors, so a lost node never recomputes the upstream scan.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
