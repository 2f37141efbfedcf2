"""Residual metrics by any group key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspan.functions.numbers import finite
from factspan.operators.reconcile import null_safe_join
from factspan.operators.rules import Rule


def input_rules(observed: str = "observed", expected: str = "expected") -> list[Rule]:
    return [
        Rule("observed_nonnegative", finite(F.col(observed)) & (F.col(observed) >= 0)),
        Rule("expected_positive", finite(F.col(expected)) & (F.col(expected) > 0)),
    ]


def pearson(observed: Column, expected: Column) -> Column:
    return (observed - expected) / F.sqrt(expected)


def deviance_term(observed: Column, expected: Column) -> Column:
    log_part = F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)
    return log_part - (observed - expected)


def poisson_deviance(
    df: DataFrame, group: Sequence[str], observed: str = "observed", expected: str = "expected"
) -> DataFrame:
    y, mu = F.col(observed).cast("double"), F.col(expected).cast("double")
    return df.groupBy(*group).agg((F.sum(deviance_term(y, mu)) * 2).alias("deviance"))


def diagnostic_report(
    df: DataFrame,
    group: Sequence[str],
    observed: str = "observed",
    expected: str = "expected",
    parameters: int = 0,
) -> DataFrame:
    """Deviance, Pearson dispersion, mean absolute and root mean squared error per group."""
    y, mu = F.col(observed).cast("double"), F.col(expected).cast("double")
    residual, error = pearson(y, mu), y - mu
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(
        n.alias("n"),
        (F.sum(deviance_term(y, mu)) * 2).alias("deviance"),
        (F.sum(residual * residual) / F.greatest(n - parameters, F.lit(1))).alias("dispersion"),
        F.avg(F.abs(error)).alias("mean_absolute_error"),
        F.sqrt(F.avg(error * error)).alias("root_mean_squared_error"),
    )


def forecast_errors(df: DataFrame, group: Sequence[str], error: str = "error") -> DataFrame:
    return df.groupBy(*group).agg(
        F.avg(F.abs(F.col(error))).alias("mae"),
        F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"),
    )


def ljung_box(
    residuals: DataFrame, series: Sequence[str], ordinal: str, value: str, lags: int = 4
) -> DataFrame:
    """Portmanteau statistic of autocorrelation per series with its effective lag.

    Residuals of step t meet those of step t - k through a join on (series, step), so a
    series of any length is spread over the cluster. Ordinals must be contiguous.
    """
    residuals = residuals.select(
        *series, F.col(ordinal).cast("bigint").alias("__t"), F.col(value).alias("__r")
    )
    stats = residuals.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__r").alias("__mean")
    )
    half = F.greatest(F.floor(F.col("n") / 2) - 1, F.lit(1))
    stats = stats.withColumn(
        "lag_used", F.least(F.lit(max(lags, 1)).cast("bigint"), half).cast("int")
    )
    centred = null_safe_join(residuals, stats, list(series)).select(
        *series, "n", "lag_used", "__t", (F.col("__r") - F.col("__mean")).alias("__r")
    )
    # lag 0 carries the variance; a row of step t is sent to step t + k
    sent = centred.select(
        *series,
        "__r",
        "__t",
        F.explode(F.sequence(F.lit(0), F.col("lag_used"))).alias("__k"),
    ).select(*series, "__k", (F.col("__t") + F.col("__k")).alias("__t"), F.col("__r").alias("__s"))
    products = (
        null_safe_join(centred, sent, [*series, "__t"])
        .groupBy(*series, "n", "lag_used", "__k")
        .agg(F.sum(F.col("__r") * F.col("__s")).alias("__c"))
    )
    variance = F.max(F.when(F.col("__k") == 0, F.col("__c")))
    weighted = F.sum(
        F.when(F.col("__k") > 0, F.col("__c") * F.col("__c") / (F.col("n") - F.col("__k")))
    )
    n = F.col("n")
    return (
        products.groupBy(*series, "n", "lag_used")
        .agg(variance.alias("__v"), weighted.alias("__w"))
        .select(
            *series,
            "n",
            "lag_used",
            (n * (n + 2) * F.col("__w") / (F.col("__v") * F.col("__v"))).alias("statistic"),
        )
    )


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return total


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """p-value per series; runs on one row per series."""
    return pd.Series(
        [
            None if s is None or math.isnan(s) else chi_square_tail(s, int(k))
            for s, k in zip(statistic, df, strict=True)
        ],
        dtype="float64",
    )


def ljung_box_test(
    residuals: DataFrame, series: Sequence[str], ordinal: str, value: str, lags: int = 4
) -> DataFrame:
    tested = ljung_box(residuals, series, ordinal, value, lags)
    return tested.withColumn("p_value", chi_square_p("statistic", "lag_used"))


def bin_residuals(df: DataFrame, group: Sequence[str], fitted: str, total: str) -> DataFrame:
    """Largest absolute and relative difference between re-added bins and their totals."""
    gap = F.abs(F.col(fitted) - F.col(total))
    return df.groupBy(*group).agg(
        F.max(gap).alias("max_absolute"),
        F.max(gap / F.greatest(F.col(total), F.lit(1.0))).alias("max_relative"),
        F.sum(F.col(fitted) - F.col(total)).alias("total_residual"),
    )


def grid_difference(
    coarse: DataFrame, fine: DataFrame, on: Sequence[str], group: Sequence[str], value: str
) -> DataFrame:
    """Largest difference of two curves on their shared nodes, absolute and relative."""
    a = coarse.select(*on, F.col(value).alias("a"))
    b = fine.select(*on, F.col(value).alias("b"))
    gap, scale = F.max(F.abs(F.col("a") - F.col("b"))), F.greatest(F.max(F.abs("a")), F.max(F.abs("b")))
    return (
        a.join(b, list(on))
        .groupBy(*group)
        .agg(gap.alias("max_difference"), scale.alias("density_scale"))
        .withColumn(
            "relative_difference",
            F.when(F.col("density_scale") == 0, 0.0).otherwise(
                F.col("max_difference") / F.col("density_scale")
            ),
        )
    )
