"""Tests and intervals on small summaries: expressions, with Arrow functions for the special functions that Spark lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


def two_sided(z: Column) -> Column:
    """Normal p value of a z score."""
    return erfc(F.abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p value of Student's t."""
    return pd.Series([None if pd.isna(x) or pd.isna(n) or n < 1 else incomplete_beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype="float64")


def paired_test(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n, mean difference, its 95 % interval, z and t p values per group. A spread of zero gives p 1 for no difference and 0 for one."""
    d = F.col(a) - F.col(b)
    got = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("delta"), F.stddev_samp(d).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    z = F.col("delta") / F.nullif(se, F.lit(0.0))
    flat = F.when(F.col("delta") == 0, 1.0).otherwise(0.0)
    return got.select(
        *by,
        "n",
        "delta",
        (F.col("delta") - 1.96 * se).alias("low"),
        (F.col("delta") + 1.96 * se).alias("high"),
        F.coalesce(two_sided(z), flat).alias("p_z"),
        F.coalesce(t_two_sided(z, (F.col("n") - 1).cast("double")), flat).alias("p_t"),
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """p value with continuity correction; ties are left out before."""
    n = wins + losses
    z = (F.abs(wins - losses) - 1) / F.sqrt(F.nullif(n, F.lit(0)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), two_sided(F.greatest(z, F.lit(0.0)))))


def mcnemar(only_a: Column, only_b: Column, corrected: bool = False) -> Column:
    n = only_a + only_b
    gap = F.abs(only_a - only_b) - (1 if corrected else 0)
    return F.when(n == 0, 1.0).otherwise(two_sided(F.greatest(gap, F.lit(0)) / F.sqrt(F.nullif(n, F.lit(0)))))


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    p = (x1 + x2) / (n1 + n2)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return F.coalesce(two_sided((x1 / n1 - x2 / n2) / F.nullif(se, F.lit(0.0))), F.lit(1.0))


def holm(rows: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """Step-down adjusted ``p_holm`` inside each family; families are small sets of tests."""
    w = Window.partitionBy(*family)
    place = F.row_number().over(w.orderBy(p, *order))
    scaled = rows.withColumn("__m", F.count(F.lit(1)).over(w)).withColumn("__i", place).withColumn("__q", (F.col("__m") - F.col("__i") + 1) * F.col(p))
    run = F.max("__q").over(w.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("p_holm", F.least(F.lit(1.0), run)).drop("__m", "__i", "__q")


def stars(p: Column, tests: int = 16) -> Column:
    """Bonferroni marks at 0.05, 0.005 and 0.0005 over the number of tests."""
    return F.when(p < 0.0005 / tests, "***").when(p < 0.005 / tests, "**").when(p < 0.05 / tests, "*").otherwise("")


def chance_corrected(accuracy: Column, k: Column) -> Column:
    return (accuracy - 1 / k) / (1 - 1 / k)


def average_ranks(rows: DataFrame, by: list[str], c: str, out: str) -> DataFrame:
    """(by, c, out): the average rank of each value in its group, nulls last.

    Values are counted first; the counts are summed up along slices of a range partition, so no group is in one task.
    """
    from ..sources.readers import stored

    counts = rows.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))
    order = [*(F.asc(k) for k in by), F.asc_nulls_last(c)]
    counts = stored(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()), "ranks")
    counts = counts.withColumn("__slice", F.shiftright("__i", 33))
    slices = counts.groupBy(*by, "__slice").agg(F.sum("__n").alias("__own"))
    earlier = F.sum("__own").over(Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*(F.col(k).alias(f"__{k}") for k in by), F.col("__slice").alias("__s"), F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    same = F.col("__slice") == F.col("__s")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__slice").orderBy("__i"))
    found = counts.withColumn("__upto", upto).join(slices, same)
    return found.select(*by, c, (F.col("__earlier") + F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(out))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, tie: str | None = None) -> DataFrame:
    """Rank correlation per group: ordinal ranks broken by ``tie``, or average ranks without it. Null under three rows."""
    if tie:
        for c in (x, y):
            rows = rows.withColumn(f"__r_{c}", F.row_number().over(Window.partitionBy(*by).orderBy(c, tie)).cast("double"))
        rho = F.try_divide(F.covar_pop(f"__r_{x}", f"__r_{y}"), F.stddev_pop(f"__r_{x}") * F.stddev_pop(f"__r_{y}"))
        got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))
        return got.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
    # equal pairs of values are one row with their number; all ranks of a group average (n + 1) / 2
    pairs = rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__w"))
    for c, out in ((x, "__rx"), (y, "__ry")):
        ranks = average_ranks(rows, by, c, out)
        ranks = ranks.select(*(F.col(k).alias(f"__{out}_{k}") for k in [*by, c]), out)
        same = F.lit(True)
        for k in [*by, c]:
            same = same & F.col(k).eqNullSafe(F.col(f"__{out}_{k}"))
        pairs = pairs.join(ranks, same).select(*(k for k in pairs.columns), out)
    middle = pairs.groupBy(*by).agg(F.sum("__w").alias("n"))
    middle = middle.select(*(F.col(k).alias(f"__{k}") for k in by), "n")
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    u, v = F.col("__rx") - (F.col("n") + 1) / 2.0, F.col("__ry") - (F.col("n") + 1) / 2.0
    w = F.col("__w")
    rho = F.try_divide(F.sum(w * u * v), F.sqrt(F.sum(w * u * u)) * F.sqrt(F.sum(w * v * v)))
    got = pairs.join(F.broadcast(middle), same).groupBy(*by).agg(F.first("n").alias("n"), rho.alias("rho"))  # a row for each group
    return got.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile interval of a group's mean from ``draws`` resamples.

    Poisson resampling: a row counts k times, k being Poisson with mean 1.  Equal values of a group are counted
    first and drawn together, as a sum of such counts is Poisson too.  Draws depend on group, value and seed alone,
    so neither the layout nor a repeated task changes the interval.
    """

    def resample(batches):
        import numpy as np

        for frame in batches:
            sums: dict[tuple, np.ndarray] = {}
            for key, v, c, names in zip(frame["__key"].tolist(), frame[value].tolist(), frame["__c"].tolist(), frame[by].itertuples(index=False, name=None), strict=True):
                k = np.random.default_rng((key % 2**63, seed)).poisson(c, draws)
                got = sums.setdefault(names, np.zeros((2, draws)))
                got[0] += k * v
                got[1] += k
            out = [pd.DataFrame({**dict(zip(by, names)), "draw": np.arange(draws), "s": s, "n": n}) for names, (s, n) in sums.items()]
            yield pd.concat(out) if out else pd.DataFrame(columns=[*by, "draw", "s", "n"])

    counted = rows.groupBy(*by, F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("__c")).where(F.col(value).isNotNull())
    keyed = counted.withColumn("__key", F.xxhash64(*by, value))
    kind = ", ".join(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in by)
    drawn = keyed.mapInPandas(resample, f"{kind}{', ' * bool(by)}draw int, s double, n double")
    means = drawn.groupBy(*by, "draw").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def bootstrap_delta(a: DataFrame, b: DataFrame, key: list[str], by: list[str], value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of the mean difference of paired rows; a row without a partner fails the query."""
    other = b.select(*key, *by, F.col(value).alias("__other"), F.lit(True).alias("__b"))
    both = a.select(*key, *by, F.col(value).alias("__own"), F.lit(True).alias("__a")).join(other, [*key, *by], "full")
    fails = F.raise_error(F.lit("paired rows differ in their keys")).cast("double")
    both = both.withColumn("delta", F.when(F.col("__a") & F.col("__b"), F.col("__own") - F.col("__other")).otherwise(fails))
    return bootstrap_mean(both.select(*by, "delta"), by, "delta", draws, seed)
