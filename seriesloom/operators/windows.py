"""Sliding windows over a long series, and forecast scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import time_split


def sliding(rows: DataFrame, key: list[str], order: str, value: str, lookback: int, horizon: int, stride: int = 1) -> DataFrame:
    """(key, start, n, series, future, split): windows that fit whole; the split is that of the first target.

    ``order`` counts 0, 1, 2 ... in each key.  Each row goes to the windows that hold it, so a window is a group of bounded size and no key's whole series is sorted in one task.
    """
    size = lookback + horizon
    sizes = rows.groupBy(*key).agg((F.max(order) + 1).alias("n"))
    low = F.greatest(F.lit(0), F.col(order) - (size - 1))
    first = F.ceil(low / stride) * stride
    starts = F.when(first <= F.col(order), F.sequence(first.cast("long"), F.col(order).cast("long"), F.lit(stride).cast("long")))
    spread = rows.select(*key, F.col(order).alias("o"), F.col(value).cast("double").alias("v"), F.explode(starts).alias("start"))
    got = spread.groupBy(*key, "start").agg(F.count(F.lit(1)).alias("c"), F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("w")).where(F.col("c") == size)
    joined = got.join(sizes, key) if key else got.join(F.broadcast(sizes))  # one row without a key
    return joined.select(*key, "start", "n", F.slice("w", 1, lookback).alias("series"), F.slice("w", lookback + 1, horizon).alias("future"), time_split(F.col("start") + lookback, F.col("n")).alias("split"))


def prefix_standardised(rows: DataFrame, key: list[str], order: str, value: str, share: float = 0.6) -> DataFrame:
    """``z``: standardised with the statistics of the first ``share`` of each key only, as float."""
    sizes = rows.groupBy(*key).agg((F.max(order) + 1).alias("__n"))
    w = rows.join(sizes, key) if key else rows.join(F.broadcast(sizes))
    train = F.when(F.col(order) < share * F.col("__n"), F.col(value))
    stats = w.groupBy(*key).agg(F.avg(train).alias("__m"), F.stddev_pop(train).alias("__d"))
    w = w.join(stats, key) if key else w.join(F.broadcast(stats))
    return w.withColumn("z", ((F.col(value) - F.col("__m")) / (F.col("__d") + 1e-8)).cast("float")).drop("__n", "__m", "__d")


def forecast_errors(truth: Column, guess: Column) -> tuple[Column, Column]:
    """Sums of squared and absolute errors of a pair of arrays."""
    gap = F.zip_with(truth, guess, lambda a, b: a - b)
    return F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d), F.aggregate(gap, F.lit(0.0), lambda s, d: s + F.abs(d))


def forecast_report(rows: DataFrame, by: list[str], truth: str, guess: str, naive: str) -> DataFrame:
    """mse, mae and skill over all elements; skill is 0 where the naive error is."""
    se, ae = forecast_errors(F.col(truth), F.col(guess))
    ne, _ = forecast_errors(F.col(truth), F.col(naive))
    n = F.sum(F.size(truth))
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), (F.sum(se) / n).alias("mse"), (F.sum(ae) / n).alias("mae"), (F.sum(ne) / n).alias("naive_mse"))
    return got.withColumn("skill", F.coalesce(1 - F.col("mse") / F.nullif("naive_mse", F.lit(0.0)), F.lit(0.0)))


def numbered(rows: DataFrame, key: list[str], order: list[str], out: str = "o") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
