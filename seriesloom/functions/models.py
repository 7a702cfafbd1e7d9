"""Where models plug in: caption, answer, judge and entailment functions, with stand-ins that need no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import sequence as S


def from_replies(prompts: DataFrame, replies: DataFrame, key: str = "key") -> DataFrame:
    """Prompts with ``reply`` from a table: how a run is repeated without its model."""
    return prompts.join(replies.select(key, "reply"), key, "left")


def mapped(rows: DataFrame, column: str, call: Callable[[list[str]], list[str]], out: str = "reply", batch: int = 64) -> DataFrame:
    """``call`` on batches of texts, as many replies as texts or the task fails (and is tried again by Spark)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got: list[str] = []
            texts = frame[column].tolist()
            for i in range(0, len(texts), batch):
                part = call(texts[i : i + batch])
                if len(part) != len(texts[i : i + batch]):
                    raise ValueError("a reply for each text is needed")
                got += part
            yield frame.assign(**{out: got})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(work, f"{fields}, `{out}` string")


def retrying(one: Callable[[str], str], several: Callable[[list[str]], list[str]] | None = None, attempts: int = 4, most_failed: float = 0.1, wait: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """A batch function from one on single texts: a failed text is tried again after 1, 2, 4 ... seconds.

    Where more than ``most_failed`` of a batch still fail, ``several`` takes the whole batch, if there is one; else the failure is raised.
    """

    def call(texts: list[str]) -> list[str]:
        got: dict[int, str] = {}
        error: Exception | None = None
        for attempt in range(attempts):
            for i in [i for i in range(len(texts)) if i not in got]:
                try:
                    got[i] = one(texts[i])
                except Exception as e:  # whatever a model's client raises
                    error = e
            if len(got) == len(texts):
                return [got[i] for i in range(len(texts))]
            if attempt + 1 < attempts:
                wait(2.0**attempt)
        if several is not None and len(texts) - len(got) > most_failed * len(texts):
            return several(texts)
        raise RuntimeError(f"{len(texts) - len(got)} of {len(texts)} calls failed") from error

    return call


@F.pandas_udf(StringType())
def _printed(x: pd.Series, decimals: pd.Series) -> pd.Series:
    return pd.Series([f"{v:.{d}f}" for v, d in zip(x, decimals)])


def printed(x: Column, decimals: int) -> Column:
    """A number as C prints it: the double itself is rounded, where Java's formats round its shortest decimal form."""
    return F.when(x.isNotNull(), _printed(x, F.lit(decimals)))


def mock_caption(s: Column) -> Column:
    """A sentence from a series' statistics."""
    return F.format_string("The series has %d points with a mean of %s, goes from %s to %s and its trend is %s.", F.size(s), printed(S.mean(s), 2), printed(F.array_min(s), 2), printed(F.array_max(s), 2), S.trend_word(s))


def overlap_entailment(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' words that the premise has: a stand-in for an entailment model."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^0-9A-Za-z_\x{80}-\x{10FFFF}]+"), lambda x: x != ""))
    own = words(hypothesis)
    return F.size(F.array_intersect(own, words(premise))) / F.nullif(F.size(own), F.lit(0))


def hashed_bag(text: Column, size: int = 64) -> Column:
    """Token counts folded into ``size`` places by md5."""
    from .text import md5_bucket, tokens

    places = F.transform(tokens(F.lower(text)), lambda t: md5_bucket(t, size))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


def controlled_caption(control: Column, caption: Column, mismatched: Column) -> Column:
    return F.when(control == "empty", "").when(control == "mismatch", mismatched).otherwise(caption)
