"""Streams that stop and go on, channel files, bounded shuffles, published versions and growing fetches."""

import collections
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.sources import adapters as A
from seriesloom.sources import channels as H
from seriesloom.sources import published as V
from seriesloom.sources import readers as D
from seriesloom.streaming import shuffle as B
from seriesloom.streaming import state as W

REPLIES = "request long, reader string, reply string, gold string"


def made_replies(first, n):
    words = ["<answer>A</answer>", "B", "no idea", None, "it is C", "<ANSWER> d </ANSWER>"]
    return [(i, [None, "x", "y"][i % 3], words[i % 6], "ABCD"[i % 4]) for i in range(first, first + n)]


def plain_totals(rows):
    letter = {"<answer>A</answer>": "A", "B": "B", "it is C": "C", "<ANSWER> d </ANSWER>": "D"}
    out = {}
    for reader in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == reader]
        got = [letter.get(r[2]) for r in own]
        picks = collections.Counter(x for x in got if x)
        sums = (len(own), sum(x is not None for x in got), sum("nswer" in (r[2] or "").lower() for r in own), float(sum(x == r[3] for x, r in zip(got, own))))
        for x, n in (picks or {None: None}).items():
            out[reader or "", x] = (*sums, n)
    return out


@pytest.mark.parametrize("fail_at", [0, 1])
def test_totals_after_a_failure_in_a_batch(spark, tmp_path, fail_at):
    """A batch that fails after its state was changed is done again, once; files that come later join in."""
    source, log, checkpoint = (f"file://{tmp_path}/{n}" for n in ("replies", "log", "state"))
    rows = made_replies(0, 90)
    spark.createDataFrame(rows, REPLIES).repartition(5).write.parquet(source)
    with pytest.raises(Exception, match="stopped at batch"):
        W.keep_totals(spark, source, REPLIES, log, checkpoint, fail_at=fail_at)
    W.keep_totals(spark, source, REPLIES, log, checkpoint)
    read = lambda: {(r["reader"], r["letter"]): (r["calls"], r["parsed"], r["tagged"], r["rewarded"], r["picks"]) for r in W.totals_so_far(spark, log).collect()}
    assert read() == plain_totals(rows)
    more = made_replies(90, 31)
    spark.createDataFrame(more, REPLIES).repartition(2).write.mode("append").parquet(source)
    W.keep_totals(spark, source, REPLIES, log, checkpoint)
    assert read() == plain_totals(rows + more)
    W.keep_totals(spark, source, REPLIES, log, checkpoint)  # nothing new
    assert read() == plain_totals(rows + more)


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_only_asked_channels_are_read():
    data = H.encoded([[float(i)] * 1000 for i in range(50)])
    stream = Counted(data)
    got = dict(H.read_channels(stream, {3, 49, 77, -1}))
    assert sorted(got) == [3, 49] and all((v == k).all() and len(v) == 1000 for k, v in got.items())
    assert stream.taken < 2 * 8000 + 1000 < len(data)
    assert len(dict(H.read_channels(io.BytesIO(data), None))) == 50
    with pytest.raises(ValueError, match="cut short"):
        dict(H.read_channels(io.BytesIO(data[:-8]), {49}))
    with pytest.raises(ValueError, match="not a channel file"):
        dict(H.read_channels(io.BytesIO(b"x" * 100), None))


def test_channel_files(spark, tmp_path):
    path = f"file://{tmp_path}/channels"
    rows = [(f, [[f + c / 10.0, None] if c else [] for c in range(f)]) for f in range(6)] + [(99, [None, [1.0]])]
    H.write_channels(spark.createDataFrame(rows, "file long, channels array<array<double>>").repartition(3), path)
    got = H.channel_table(spark, path)
    assert got.rdd.getNumPartitions() == 7  # a partition per file
    want = {(f, c): [v for v in (values or [])] for f, cs in rows for c, values in enumerate(cs)}
    read = {(r["file"], r["channel"]): [None if np.isnan(x) else x for x in r["values"]] for r in got.collect()}
    assert read == want
    some = H.channel_table(spark, path, channels=[1], files=[2, 99, 1234])
    assert some.rdd.getNumPartitions() == 2 and {(r["file"], r["channel"]) for r in some.collect()} == {(2, 1), (99, 1)}
    H.write_channels(spark.createDataFrame([(2, [[5.0]])], "file long, channels array<array<double>>"), path)  # replaces the file
    assert [r["values"] for r in H.channel_table(spark, path, files=[2]).collect()] == [[5.0]]
    assert not [p for p in (tmp_path / "channels").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    with pytest.raises(Exception, match="boom"):
        boom = spark.range(4).select(F.col("id").alias("file"), F.when(F.col("id") < 3, F.array(F.array(F.lit(1.0)))).otherwise(F.raise_error(F.lit("boom")).cast("array<array<double>>")).alias("channels"))
        H.write_channels(boom.coalesce(1), f"file://{tmp_path}/none")
    assert H.channel_table(spark, f"file://{tmp_path}/none").count() == 0


def rows_through(n, size, seed, cut):
    table = pa.table({"i": list(range(n))})
    return [x for b in B.shuffled_batches(iter(table.to_batches(max_chunksize=cut)), size, np.random.default_rng(seed)) for x in b.column(0).to_pylist()]


def test_buffer_shuffle():
    """All rows leave once; none leaves before the buffer is full; the same seed gives the same order whatever the batches."""
    a = rows_through(1000, 50, 3, 100)
    assert sorted(a) == list(range(1000)) and a != sorted(a)
    assert all(x < at + 50 for at, x in enumerate(a))  # at most 50 rows are held
    assert a == rows_through(1000, 50, 3, 7) == rows_through(1000, 50, 3, 1000) and a != rows_through(1000, 50, 4, 100)
    assert rows_through(1000, 1, 3, 100) == list(range(1000)) and sorted(rows_through(5, 50, 1, 2)) == list(range(5)) and rows_through(0, 5, 1, 2) == []


def test_buffer_shuffle_holds_no_more_than_its_buffer():
    """Batches keep flowing: after each batch at most ``size`` rows are left inside."""
    fed = given = 0

    def feed():
        nonlocal fed
        for i in range(40):
            fed += 25
            yield pa.record_batch({"i": list(range(25 * i, 25 * i + 25))})

    for out in B.shuffled_batches(feed(), 60, np.random.default_rng(1)):
        given += out.num_rows
        assert fed - given <= 60 or fed == 1000
    assert given == 1000


def test_buffer_shuffle_of_a_table(spark):
    rows = spark.range(0, 500, 1, 3).withColumn("x", F.col("id") * 2)
    a, b = (B.buffer_shuffled(rows, 20, seed=5).collect() for _ in range(2))
    assert a == b and sorted(r["id"] for r in a) == list(range(500)) and all(r["x"] == 2 * r["id"] for r in a)


def test_publish(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    frame = lambda n: spark.range(n).toDF("id")
    with pytest.raises(ValueError, match="no version"):
        V.published(spark, root)
    assert V.publish(frame(3), root, {"k": 1}) == 1

    def stop():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        V.publish(frame(9), root, {"k": 1}, before_swap=stop)
    assert V.published(spark, root).count() == 3  # the older version, whole
    with pytest.raises(ValueError, match="other settings"):
        V.publish(frame(9), root, {"k": 2})
    reader = V.published(spark, root)
    assert V.publish(frame(5), root, {"k": 1}) == 2
    assert reader.count() == 3  # who reads already keeps what he has
    assert V.published(spark, root).count() == 5 and V.published(spark, root, 1).count() == 3 and V.published(spark, root, 2).count() == 5
    with pytest.raises(ValueError, match="no version"):
        V.published(spark, root, 7)


def test_first_ids_reads_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    spark.range(3200).selectExpr("id div 4 as id", "'wide' as wide").repartitionByRange(16, "id").write.parquet(path)
    rows, files = D.first_ids(spark, path, "id", 60, drop=["wide"])
    assert files <= 4 and rows.columns == ["id"] and sorted(r["id"] for r in rows.collect()) == sorted(list(range(60)) * 4)
    rows, files = D.first_ids(spark, path, "id", 10_000)
    assert files == 16 and rows.count() == 3200


def test_items_of_benchmarks(spark):
    asked = spark.createDataFrame([(1, "q", ["a", "b"], "b", [1.0], None, None), (2, "q", ["a", "b"], "c", None, [1.0], [2.0])], "id long, question string, choices array<string>, answer string, ts array<double>, ts1 array<double>, ts2 array<double>")
    one = A.lettered_choice(asked)
    got = A.all_items({"a": one, "b": one.where("gold is not null")})
    assert sorted((r["benchmark"], r["id"], r["gold"]) for r in got.collect()) == [("a", "1", "B"), ("a", "2", None), ("b", "1", "B")]
    counts = A.skip_counts({"a": (asked, one.where("gold is not null")), "b": (asked, one.limit(0))}).collect()
    assert sorted(map(tuple, counts)) == [("a", 2, 1, 1), ("b", 2, 0, 2)]
