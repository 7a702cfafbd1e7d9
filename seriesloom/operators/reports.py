"""Grouped reports: grouping sets, confusion scores, spreads, pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouping_report(rows: DataFrame, dims: list[str], measures: dict[str, Column], unknown: str = "unknown") -> DataFrame:
    """One row overall and per value of each dimension: (dimension, value, measures). Null and empty values count as ``unknown``.

    Each row is expanded once per grouping, in one pass.
    """
    clean = {d: F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit(unknown)) for d in dims}
    sets = F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in clean.items()))
    wide = rows.select("*", F.explode(sets).alias("__g"))
    return wide.groupBy(F.col("__g.dimension").alias("dimension"), F.col("__g.value").alias("value")).agg(*(c.alias(n) for n, c in measures.items()))


def confusion(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def f1_by_label(counts: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(label, support, f1) from confusion counts; labels are those in gold or predicted, 0 where undefined."""
    by = by or []
    each = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.col("n").alias("g"), F.lit(0).alias("p"), F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0).alias("h")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.col("n").alias("p"), F.lit(0).alias("h"))))
    sums = counts.select(*by, each.alias("x")).groupBy(*by, F.col("x.label").alias("label")).agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("picked"), F.sum("x.h").alias("hits"))
    f1 = F.coalesce(2 * F.col("hits") / F.nullif(F.col("support") + F.col("picked"), F.lit(0)), F.lit(0.0))
    return sums.select(*by, "label", "support", f1.alias("f1"))


def f1_scores(rows: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, F1 weighted by gold support and plain mean F1."""
    by = by or []
    counts = confusion(rows, gold, predicted, by)
    labels = f1_by_label(counts, gold, predicted, by)
    scores = labels.groupBy(*by).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("f1").alias("macro_f1"))
    hits = counts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return hits.join(scores, by) if by else hits.join(F.broadcast(scores))  # a row each


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa; 1 where chance agreement is certain."""
    counts = confusion(rows, a, b)
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = counts.groupBy(F.col(a).alias("label")).agg(F.sum("n").alias("x"))
    right = counts.groupBy(F.col(b).alias("label")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "label").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    pe = F.coalesce("xy", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    po = F.col("same") / F.col("n")
    return total.join(F.broadcast(chance)).select("n", po.alias("agreement"), F.coalesce((po - pe) / F.nullif(1 - pe, F.lit(0.0)), F.lit(1.0)).alias("kappa"))


def group_spread(rows: DataFrame, group: str, value: str, tiny: float = 1e-9) -> DataFrame:
    """Groups of two and more: their number, how many do not vary, mean and spread of means, and the alert at over half."""
    each = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("sd")).where("n > 1")
    flat = F.count_if(F.col("sd") < tiny)
    return each.agg(F.count(F.lit(1)).alias("groups"), flat.alias("flat_groups"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("spread_of_means"), F.avg("sd").alias("mean_sd"), (flat > 0.5 * F.count(F.lit(1))).alias("alert"))


def rank_percentile(values: Column, p: float) -> Column:
    """The value at place int(p * n) of the sorted ones: a quantile without interpolation."""
    return F.element_at(F.array_sort(values), (F.least(F.size(values) - 1, F.floor(F.size(values) * p)) + 1).cast("int"))


def ranked_quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by place, exact and without gathering a group: values are counted, then summed up in order."""
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    place = {k: F.least(F.col("n") - 1, F.floor(F.col("n") * p)) for k, p in shares.items()}
    return run.groupBy(*by).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > at, F.col(value))).alias(k) for k, at in place.items()))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def reward(mean: Column, k: int, mode: str = "raw", scale: float = 2.0) -> Column:
    """raw: mean x scale; chance: share above chance; centered: around chance."""
    if mode == "raw":
        return mean * scale
    if mode == "chance":
        return F.greatest(F.lit(0.0), (mean - 1 / k) / (1 - 1 / k)) * scale
    if mode == "centered":
        return (mean - 1 / k) * scale
    raise ValueError(mode)


def recovery(low: Column, mid: Column, high: Column) -> Column:
    """(mid - low) / (high - low); null without a positive spread."""
    return F.when(high - low > 0, (mid - low) / (high - low))


def cell_state(done: Column, wanted: int) -> Column:
    return F.when(done == wanted, "done").when(done > 0, "partial").otherwise("missing")


def long_to_wide(rows: DataFrame, by: list[str], key: str, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).pivot(key, keys).agg(F.first(value))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
