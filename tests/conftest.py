from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


# column expressions in test parameters need a running session when they are collected
SESSION = (
    SparkSession.builder.master("local[4]")
    .appName("factspan-tests")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "4g")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named text values."""

    def evaluate(expression, **values):
        names = list(values) or ["x"]
        row = tuple(values.values()) if values else ("",)
        schema = ", ".join(
            f"{n} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}"
            for n, v in zip(names, row, strict=True)
        )
        return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]

    return evaluate
