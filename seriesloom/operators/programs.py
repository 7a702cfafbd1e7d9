"""Parts of whole reports over graded runs: alignment votes, sign tests between arms, seed tables, rankings, worked examples.

A run is a row per graded question; a report's tables are small, so what is
joined with itself here are means by unit, never questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as T


def aligned(configs: DataFrame, tag: str, settings: list[str]) -> DataFrame:
    """``configs`` (a row per tag) with ``votes``, how many tags have the same settings, and ``deviant``: not those of most tags; of equal votes the first tag's."""
    same = Window.partitionBy(*settings)
    voted = configs.withColumn("votes", F.count(F.lit(1)).over(same)).withColumn("__first", F.min(tag).over(same))
    main = voted.agg(F.max_by(F.struct(*settings), F.struct("votes", _descending(F.col("__first")))).alias("__main"))
    return voted.join(F.broadcast(main)).withColumn("deviant", F.struct(*settings) != F.col("__main")).drop("__first", "__main")  # one row


def _descending(text: Column) -> Column:
    """A key that sorts the other way round: each character's code from the end of the range."""
    return F.transform(F.split(text, ""), lambda c: -F.ascii(c))


def sign_tests(means: DataFrame, tag: str, unit: list[str], by: list[str], value: str) -> DataFrame:
    """(by, one, other, n, wins, losses, p) of every two tags over the units that both have."""
    left = means.select(*by, *unit, F.col(tag).alias("one"), F.col(value).alias("x"))
    right = means.select(*by, *unit, F.col(tag).alias("other"), F.col(value).alias("y"))
    pairs = left.join(right, [*by, *unit]).where("one < other")
    counted = pairs.groupBy(*by, "one", "other").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"))
    return counted.withColumn("p", T.sign_test(F.col("wins"), F.col("losses")))


def against(means: DataFrame, tag: str, ours: str, unit: list[str], by: list[str], value: str) -> DataFrame:
    """(by, rival, n, ours, theirs, delta, p_z, p_t) of one tag against each other one, paired by unit."""
    own = means.where(F.col(tag) == ours).select(*by, *unit, F.col(value).alias("own"))
    rest = means.where(F.col(tag) != ours).select(*by, *unit, F.col(tag).alias("rival"), F.col(value).alias("their"))
    pairs = own.join(rest, [*by, *unit])
    both = pairs.groupBy(*by, "rival").agg(F.avg("own").alias("ours"), F.avg("their").alias("theirs"))
    return T.paired_test(pairs, [*by, "rival"], "own", "their").join(both, [*by, "rival"])


def seed_cells(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation and coefficient of variation of each cell over its seeds."""
    got = runs.groupBy(*by).agg(F.count(value).alias("seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.withColumn("cv", F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)))


def verdict(delta: Column, p: Column, ours: Column, rival: Column, alpha: float = 0.05, lower_wins: bool = True) -> Column:
    """Who is better, or a tie where that is not significant."""
    better = delta < 0 if lower_wins else delta > 0
    return F.when(p.isNull() | (p >= alpha), "tie").when(better, ours).otherwise(rival)


def ranking(cells: DataFrame, by: list[str], tag: str, value: str, descending: bool = False) -> DataFrame:
    """(by, ranking): the tags of each group from best to worst, with commas; lower is better unless ``descending``."""
    sign = -1 if descending else 1
    return cells.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col(value) * sign).alias("v"), F.col(tag).alias("t")))), lambda x: x["t"]), ",").alias("ranking"))


def missing_cells(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present.select(*keys).distinct(), keys, "left_anti")


def worked_examples(rows: DataFrame, by: list[str], preferred: str, order: str, n: int) -> DataFrame:
    """The first n of each group among its preferred rows, or among all where none is preferred."""
    some = rows.groupBy(*by).agg(F.max(F.col(preferred).cast("int")).alias("__some"))
    pool = rows.join(some, by).where((F.col("__some") == 0) | F.col(preferred))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return pool.withColumn("place", place).where(F.col("place") <= n).drop("__some")
