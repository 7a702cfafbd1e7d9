"""Rewards over request micro-batches, and state that grows over requests.

A request row: request, id, caption, options. Scoring goes through a table of
replies or an injected Arrow function, so that a model can stand behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import candidates as C
from ..operators import reports as P


def fresh_distractors(requests: DataFrame, pool: str, n: int) -> DataFrame:
    """``distractors``: n of each id's pool by a hash of request and id, the same for all rows of that id in a request."""
    keyed = F.transform(pool, lambda c, i: F.struct(C.keyed_order(F.col("request"), F.col("id"), i).alias("h"), c.alias("c")))
    return requests.withColumn("distractors", F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["c"]))


def gold_places(requests: DataFrame, k: int, wanted: int) -> DataFrame:
    """``places``: ``wanted`` of the k gold places, chosen by a hash of request and id."""
    all_places = F.array(*(F.struct(C.keyed_order(F.col("request"), F.col("id"), F.lit(f"place{i}")).alias("h"), F.lit(i).alias("p")) for i in range(k)))
    return requests.withColumn("places", F.array_sort(F.transform(F.slice(F.array_sort(all_places), 1, wanted), lambda x: x["p"])))


def rewards(requests: DataFrame, answer: Callable[[Column, Column], Column], k: int, mode: str = "raw", scale: float = 2.0) -> DataFrame:
    """(request, id, accuracy, reward): every caption is asked at each of its places, ``answer(prompt, key)`` gives the reply."""
    asked = requests.select("request", "id", "caption", "true", "distractors", F.explode("places").alias("place"))
    options = F.concat(F.slice("distractors", F.lit(1), F.col("place")), F.array("true"), F.slice("distractors", F.col("place") + 1, F.lit(k)))
    key = F.concat_ws(":", F.col("request").cast("string"), F.col("id").cast("string"), F.col("place").cast("string"))
    scored = asked.withColumn("letter", X.answer_letter(answer(X.prompt(F.col("caption"), options), key), f"A-{chr(64 + k)}"))
    hit = X.score_exact(F.char(65 + F.col("place")), F.col("letter"))
    return scored.groupBy("request", "id").agg(F.avg(hit).alias("accuracy")).withColumn("reward", P.reward(F.col("accuracy"), k, mode, scale))


def answerability(rows: DataFrame, asked: int | None = None, scale: float = 2.0) -> DataFrame:
    """(request, reward): the share of right replies to a request's questions, all or ``asked`` of them drawn by key; null where a reply is missing.

    ``rows``: request, question, reply, gold.
    """
    if asked is not None:
        w = Window.partitionBy("request").orderBy(C.keyed_order(F.col("request"), F.col("question")), "question")
        rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= asked)
    mean = F.avg((F.col("reply") == F.col("gold")).cast("double"))
    return rows.groupBy("request").agg(F.when(F.count("reply") == F.count(F.lit(1)), mean * scale).alias("reward"))


def resumed(rows: DataFrame, progress: DataFrame, part: str, order: str) -> DataFrame:
    """Rows of each part from the offset on that ``progress`` (part, done) names; parts without one start at 0."""
    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    left = rows.withColumn("__place", place).join(progress.select(part, F.col("done").alias("__done")), part, "left")
    return left.where(F.col("__place") >= F.coalesce("__done", F.lit(0))).drop("__place", "__done")


def judge_rewards(replies: DataFrame, scale: float = 2.0) -> DataFrame:
    """(request, id, reward) from a judge's words; an unreadable grade is the lowest."""
    return replies.select("request", "id", X.judge_grade(F.col("reply"), scale).alias("reward"))


def running_totals(replies: DataFrame) -> DataFrame:
    """Calls, parsed replies and picks so far, by letter: a stream's aggregate in update or complete mode."""
    letter = F.coalesce(X.answer_letter(F.col("reply")), F.lit("unparsed"))
    return replies.groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def group_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends one record of group statistics per micro-batch; the checkpoint makes it resume where it stopped."""

    def append(batch: DataFrame, number: int) -> None:
        stats = P.group_spread(batch, "id", "reward").withColumn("batch", F.lit(number))
        stats.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Events per window and type; those later than the watermark are left out by the stream."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))


def chunked(requests: DataFrame, order: str, workers: int) -> DataFrame:
    """``worker``: equal neighbouring chunks of each request's rows, for side-by-side calls."""
    w = Window.partitionBy("request")
    n = F.count(F.lit(1)).over(w)
    return requests.withColumn("worker", F.floor((F.row_number().over(w.orderBy(order)) - 1) / F.ceil(n / workers)))
