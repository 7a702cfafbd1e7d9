"""State that lives across requests: totals kept by a stateful stream, with a log of each micro-batch.

A reader's totals are kept under several keys, by a hash of the request, so a
reader with a third of all replies is no single task; whoever reads the log adds
them up.  State and offsets are in the checkpoint: a stream that stops or fails,
in the middle of a batch too, goes on where the last whole batch ended, and a
batch that is done again overwrites its own part of the log.

Replies without a reader count under the empty string, null replies as calls that
could not be parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X

SHARDS = 8
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOTALS = "reader string, shard int, calls long, parsed long, tagged long, rewarded double, picks map<string,long>"


class Totals(StatefulProcessor):
    """Calls, parsed and tagged replies, sum of rewards, and how often each letter was picked."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "calls long, parsed long, tagged long, rewarded double")
        self.picks = handle.getMapState("picks", "letter string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, parsed, tagged, rewarded = self.counts.get() if self.counts.exists() else (0, 0, 0, 0.0)
        picked: dict[str, int] = {}
        for frame in rows:
            calls += len(frame)
            parsed += int(frame["letter"].notna().sum())
            tagged += int(frame["tagged"].sum())
            rewarded += float(frame["reward"].sum())
            for letter, n in frame["letter"].value_counts().items():
                picked[letter] = picked.get(letter, 0) + int(n)
        self.counts.update((calls, parsed, tagged, rewarded))
        for letter, n in picked.items():
            before = self.picks.getValue((letter,))[0] if self.picks.containsKey((letter,)) else 0
            self.picks.updateValue((letter,), (before + n,))
        all_picks = {k[0]: v[0] for k, v in self.picks.iterator()}
        yield pd.DataFrame([(key[0], key[1], calls, parsed, tagged, rewarded, all_picks)], columns=["reader", "shard", "calls", "parsed", "tagged", "rewarded", "picks"])

    def close(self) -> None:
        pass


def scored(replies: DataFrame, letters: str = "A-D", shards: int = SHARDS) -> DataFrame:
    """(reader, shard, letter, tagged, reward) of replies (request, reader, reply, gold): the letter, whether it stood in a tag, and 1 where it is the gold one."""
    letter = X.answer_letter(F.col("reply"), letters)
    tagged = F.coalesce(F.regexp_like("reply", F.lit(rf"(?is)<answer>\s*[{letters}]\s*</answer>")), F.lit(False))
    shard = F.pmod(F.xxhash64("request"), F.lit(shards)).cast("int")
    return replies.select(F.coalesce("reader", F.lit("")).alias("reader"), shard.alias("shard"), letter.alias("letter"), tagged.alias("tagged"), X.score_exact(F.col("gold"), letter).alias("reward"))


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with the store that keyed state needs; the caller's settings stay."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return session


def keep_totals(spark: SparkSession, source: str, schema: str, log: str, checkpoint: str, files_a_batch: int = 2, fail_at: int | None = None) -> None:
    """Takes all files of replies that are in ``source`` and not yet done, batch by batch, and writes each batch's totals to ``log``.

    ``fail_at``: a batch that fails after its totals were written, for tests.
    """
    session = stateful_session(spark)
    stream = session.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    totals = scored(stream).groupBy("reader", "shard").transformWithStateInPandas(Totals(), TOTALS, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        if number == fail_at:
            raise RuntimeError(f"stopped at batch {number}")

    run = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def totals_so_far(spark: SparkSession, log: str) -> DataFrame:
    """(reader, calls, parsed, tagged, rewarded, letter, picks): the last record of each key, added up; a row for each letter picked, and one without letter where none was."""
    rows = spark.read.schema(f"{TOTALS}, batch int").parquet(log)
    last = rows.groupBy("reader", "shard").agg(F.max_by(F.struct("calls", "parsed", "tagged", "rewarded", "picks"), "batch").alias("t")).select("reader", "t.*")
    sums = last.groupBy("reader").agg(*(F.sum(c).alias(c) for c in ("calls", "parsed", "tagged", "rewarded")))
    picks = last.select("reader", F.explode("picks").alias("letter", "n")).groupBy("reader", "letter").agg(F.sum("n").alias("picks"))
    return sums.join(picks, "reader", "left")
