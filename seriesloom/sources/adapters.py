"""Benchmark adapters: each gives the same item columns, whatever its source looks like.

Items: id, series (array of arrays), question, gold, scoring, options (array<struct<letter,text>>), task, domain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ITEM = ["id", "series", "question", "gold", "scoring", "options", "task", "domain"]


def letters(options: Column) -> Column:
    return F.transform(options, lambda o, i: F.struct(F.char(65 + i).alias("letter"), o.alias("text")))


def no_options() -> Column:
    return F.array().cast("array<struct<letter:string,text:string>>")


def as_items(rows: DataFrame, **columns: Column) -> DataFrame:
    """The item columns; those not given are null."""
    null = F.lit(None).cast("string")
    return rows.select(*(columns.get(c, no_options() if c == "options" else null).alias(c) for c in ITEM))


def annotated(items: DataFrame, series: DataFrame) -> DataFrame:
    """Recognition and choice items joined to their series by uid; unknown uids are left out."""
    joined = items.join(series, "uid")
    ask = F.when(F.col("task") == "recognition", F.concat(F.lit("Does this describe the series? "), F.col("description"))).otherwise(F.lit("Which description fits the series?"))
    return as_items(joined, id=F.col("item"), series=F.array("series"), question=ask, gold=F.col("gold"), scoring=F.when(F.col("task") == "recognition", "tf_exact").otherwise("letter_exact"), options=letters(F.col("options")), task=F.col("task"), domain=F.col("dataset"))


def lettered_choice(rows: DataFrame) -> DataFrame:
    """(id, question, choices, answer, ts, ts1, ts2): the gold letter is the place of the answer's text; one series or two."""
    place = F.array_position("choices", F.col("answer"))
    series = F.when(F.col("ts").isNotNull(), F.array("ts")).otherwise(F.array("ts1", "ts2"))
    return as_items(rows, id=F.col("id"), series=series, question=F.col("question"), gold=F.when(place > 0, F.char(64 + place)), scoring=F.lit("letter_exact"), options=letters(F.col("choices")), task=F.lit("choice"))


def typed_questions(rows: DataFrame, scorers: dict[str, str]) -> DataFrame:
    """(id, question, answer, question_type, series json): the type names the scorer; unknown types are left out."""
    table = F.create_map(*(F.lit(x) for pair in scorers.items() for x in pair))
    kind = F.try_element_at(table, F.col("question_type"))
    return as_items(rows.where(kind.isNotNull()), id=F.col("id"), series=F.array(F.from_json("series", "array<double>")), question=F.col("question"), gold=F.col("answer"), scoring=kind, options=X.options(F.col("question")), task=F.col("question_type"))


def tagged_text(rows: DataFrame) -> DataFrame:
    """(id, text) with ``<QUE> ... <ANS> ...``: true/false or choice by what the answer looks like."""
    question, answer = F.trim(F.regexp_extract("text", r"(?s)<QUE>(.*?)<ANS>", 1)), F.trim(F.regexp_extract("text", r"(?s)<ANS>(.*)$", 1))
    kind = F.when(X.truth_value(answer).isNotNull(), "tf_exact").when(X.first_letter(answer).isNotNull(), "letter_exact")
    gold = F.when(kind == "tf_exact", X.truth_value(answer)).otherwise(X.first_letter(answer))
    series = F.array(F.from_json(F.regexp_extract(question, r"(\[[-\d., eE]+\])", 1), "array<double>"))
    return as_items(rows.where(kind.isNotNull()), id=F.col("id"), series=series, question=question, gold=gold, scoring=kind, options=X.options(question), task=kind)


def abilities(rows: DataFrame, scorers: dict[str, str]) -> DataFrame:
    """(id, question, series, ability array, answer array): an item for each ability that has a scorer."""
    each = rows.select("id", "question", "series", F.posexplode(F.arrays_zip("ability", "answer")).alias("n", "x"))
    table = F.create_map(*(F.lit(x) for pair in scorers.items() for x in pair))
    kind = F.try_element_at(table, F.col("x.ability"))
    return as_items(each.where(kind.isNotNull()), id=F.concat_ws("-", F.col("id").cast("string"), F.col("n").cast("string")), series=F.col("series"), question=F.col("question"), gold=F.col("x.answer"), scoring=kind, task=F.col("x.ability"))


def by_path_suffix(messages: DataFrame, fragments: DataFrame) -> DataFrame:
    """Question lists joined to fragments on the last two parts of the image path."""
    key = lambda c: F.substring_index(c, "/", -2)
    joined = messages.withColumn("k", key("image")).join(fragments.select(key("image_path").alias("k"), "series"), "k")
    each = joined.select("k", "series", F.posexplode("qa").alias("n", "q"))
    return as_items(each, id=F.concat_ws("#", "k", F.col("n").cast("string")), series=F.array("series"), question=F.col("q.question"), gold=F.col("q.answer"), scoring=F.lit("letter_exact"), options=X.options(F.col("q.question")))


def two_pools(diagnostic: DataFrame, matching: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, prompt, gold) with the series written in the prompt, then (id, series, question, gold) of true or false; one limit over both, by pool and id."""
    series = F.array(F.from_json(F.regexp_extract("prompt", r"(\[[-\d., eE+]+\])", 1), "array<double>"))
    first = as_items(diagnostic, id=F.col("id"), series=series, question=F.col("prompt"), gold=F.col("gold"), scoring=F.lit("letter_exact"), options=X.options(F.col("prompt")), task=F.lit("diagnostic"))
    second = as_items(matching, id=F.col("id"), series=F.array("series"), question=F.col("question"), gold=F.col("gold"), scoring=F.lit("tf_exact"), task=F.lit("matching"))
    both = first.withColumn("__pool", F.lit(0)).unionByName(second.withColumn("__pool", F.lit(1)))
    return (both if limit is None else both.orderBy("__pool", "id").limit(limit)).drop("__pool")


def channel_questions(qa: DataFrame, channels: DataFrame) -> DataFrame:
    """(id, file, channel, question, gold) joined to (file, channel, values)."""
    return as_items(qa.join(channels, ["file", "channel"]), id=F.col("id"), series=F.array("values"), question=F.col("question"), gold=F.col("gold"), scoring=F.lit("letter_exact"), options=X.options(F.col("question")), task=F.lit("skill"))


def all_items(parts: dict[str, DataFrame]) -> DataFrame:
    """Items of several benchmarks in one table with the ``benchmark`` they are of; ids as text."""
    named = [df.withColumn("id", F.col("id").cast("string")).select(F.lit(name).alias("benchmark"), *ITEM) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def skip_counts(parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(benchmark, asked, items, skipped) from each benchmark's rows and its items, counted in one pass over both."""
    sides = [df.select(F.lit(name).alias("benchmark"), F.lit(k).alias("k")) for name, pair in parts.items() for k, df in enumerate(pair)]
    counted = reduce(lambda a, b: a.unionByName(b), sides).groupBy("benchmark").agg(F.count_if(F.col("k") == 0).alias("asked"), F.count_if(F.col("k") == 1).alias("items"))
    return counted.withColumn("skipped", F.col("asked") - F.col("items"))


ADAPTERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (annotated, lettered_choice, typed_questions, tagged_text, abilities, by_path_suffix, two_pools, channel_questions)}
