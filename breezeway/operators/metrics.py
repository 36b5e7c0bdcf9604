"""Error metrics and best-model selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_metrics(df: DataFrame, actual: str = "y", predicted: str = "prediction",
                  by: list[str] | None = None, mape: bool = False) -> DataFrame:
    """MAE, RMSE, R2 (and MAPE in %) per group in one pass.

    Rows without a target or a prediction count nowhere. R2 of a constant target is 1 if
    every prediction is exact, else 0.
    """
    by = by or []
    e = F.col(actual).cast("double") - F.col(predicted)
    y = F.when(e.isNotNull(), F.col(actual).cast("double"))
    columns = [
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.min(y).alias("_lo"), F.max(y).alias("_hi"),
    ]
    if mape:
        share = F.avg(F.when(y != 0, F.abs(e / y))) * 100
        columns.append(F.coalesce(share, F.lit(0.0)).alias("mape"))
    r2 = (
        F.when(F.col("_lo") != F.col("_hi"), 1 - F.try_divide(F.col("_sse"), F.col("_sst")))
        .when(F.col("_sse") == 0, 1.0)
        .when(F.col("_sse").isNotNull(), 0.0)
    )
    out = df.groupBy(*by).agg(*columns).withColumn("r2", r2)
    return out.drop("_sse", "_sst", "_lo", "_hi")


def mean_r2(metrics: DataFrame, by: list[str] | None = None, bar: float = 0.65) -> DataFrame:
    out = metrics.groupBy(*(by or [])).agg(F.avg("r2").alias("mean_r2"))
    return out.withColumn("passed", F.col("mean_r2") > bar)


def _best(metrics: DataFrame, by: list[str], name: str, order: str, metric: str, worth: Column) -> DataFrame:
    """Name and metric of the row of the largest ``worth``; the earlier candidate wins a tie.

    A missing metric (NULL or NaN) loses to every other; with no other the metric is NULL.
    """
    known = F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))
    rank = F.struct(known.cast("int"), F.when(known, worth), -F.col(order))
    kept = F.max_by(F.struct(F.col(name), F.when(known, F.col(metric)).alias(metric)), rank)
    return metrics.groupBy(*by).agg(kept.alias("_best")).select(*by, f"_best.{name}", f"_best.{metric}")


def best_by_mae(metrics: DataFrame, by: list[str], name: str = "model", order: str = "rank") -> DataFrame:
    """Lowest MAE wins."""
    return _best(metrics, by, name, order, "mae", -F.col("mae"))


def best_by_r2(metrics: DataFrame, by: list[str], name: str = "model", order: str = "rank") -> DataFrame:
    """Highest R2 wins."""
    return _best(metrics, by, name, order, "r2", F.col("r2"))
