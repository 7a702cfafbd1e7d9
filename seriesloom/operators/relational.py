"""Ingest folds, guards, key checks, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_by_id(rows: DataFrame, id_col: str, first: str, listed: str, order: str) -> DataFrame:
    """First value of one column and the trimmed, non-blank values of another in order."""
    text = F.trim(listed)
    keep = F.when(F.length(text) > 0, F.struct(F.col(order).alias("o"), text.alias("t")))
    return rows.groupBy(id_col).agg(F.min_by(first, order).alias(first), F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["t"]).alias(listed))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def one_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key; the query fails where a key has two."""
    got = rows.groupBy(key).agg(F.min_by(value, order).alias(value), F.count_distinct(value).alias("__n"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("more than one value for "), F.col(key).cast("string")))).otherwise(F.col(value))
    return got.select(key, checked.cast(rows.schema[value].dataType).alias(value))


def partners_or_fail(items: DataFrame, partners: DataFrame, key: str, tolerance: float = 0.02) -> DataFrame:
    """Items with a partner; the query fails if a larger share than ``tolerance`` lacks one."""
    joined = items.join(partners, key, "left")
    marker = next(c for c in partners.columns if c != key)
    share = joined.agg(F.avg(F.col(marker).isNull().cast("double")).alias("__share"))
    checked = joined.join(F.broadcast(share))  # one row
    fine = F.coalesce(F.col("__share"), F.lit(0.0)) <= tolerance
    guard = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.format_string("%.4f of the items lack a partner", "__share")).cast("boolean"))
    return checked.where(guard & F.col(marker).isNotNull()).drop("__share")


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of keys on both sides, missing on the right and extra there."""
    a = left.select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1))
    b = right.select(F.col(key).alias("k")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "k", "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


def in_every(rows: DataFrame, key: str, arm: str) -> DataFrame:
    """Keys that every arm has."""
    arms = rows.agg(F.count_distinct(arm).alias("__arms"))
    return rows.groupBy(key).agg(F.count_distinct(arm).alias("__n")).join(F.broadcast(arms)).where("__n = __arms").select(key)


def majority(rows: DataFrame, config: list[str], order: str) -> DataFrame:
    """Each row with ``deviates``: whether its configuration differs from the most common one (the first seen on ties)."""
    counted = rows.groupBy(*config).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counted.orderBy(F.desc("n"), "first").limit(1).select(*(F.col(c).alias(f"__{c}") for c in config))
    same = F.lit(True)
    for c in config:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(best)).withColumn("deviates", ~same).drop(*(f"__{c}" for c in config))


def first_per(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the md5 of seed and key: the same ones in any order of the input."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("__h", mark).orderBy("__h", key).limit(n).drop("__h")


def hash_split(rows: DataFrame, key: str, validation: int, seed: int = 0) -> DataFrame:
    """``split``: val for the first rows by md5 of seed and key, train for the others.

    The boundary is found as a row limit, so no window runs over all rows.
    """
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    marked = rows.withColumn("__h", mark)
    edge = marked.select("__h", F.col(key).alias("__k")).orderBy("__h", "__k").limit(validation).agg(F.max(F.struct("__h", "__k")).alias("__edge"))
    inside = F.struct("__h", F.col(key).alias("__k")) <= F.col("__edge")
    return marked.join(F.broadcast(edge)).withColumn("split", F.when(inside, "val").otherwise("train")).drop("__h", "__edge")


def time_split(place: Column, n: Column) -> Column:
    """60 / 20 / 20 by place."""
    return F.when(place < 0.6 * n, "train").when(place < 0.8 * n, "val").otherwise("test")


def strided_shard(order: Column, shards: int) -> Column:
    return F.pmod(order, F.lit(shards))


def contiguous_part(order: Column, n: Column, parts: int) -> Column:
    return F.floor(order / F.ceil(n / parts))
