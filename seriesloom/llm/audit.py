"""How filters interact: what every order of five filters removes at each step, by part of the corpus.

Each document has a mask of the filters it fails.  A table of 32 masks by 120
orders holds the step at which an order removes a mask; tasks index it by mask,
count removals of each part, order and step by label with ``np.bincount``, and
the tasks' arrays are summed.  All measures are sums over documents, shapley
included, so nothing is joined afterwards.

Null texts are empty, null parts the empty string; a document without doc_id
never fails E and makes no other fail it.  A doc_id with several rows of labels
has a label if one of them says so; null labels say nothing.  Repeated rows
count each; rows of one doc_id do not fail E because of each other.  An empty
table gives no rows.  Columns with other names are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
UPPER, MARKS, CONTINUATION = bytes(range(0x41, 0x5B)), b"#$%&*|", bytes(range(0x80, 0xC0))
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts whose arrays a task holds before it hands them on.
PARTS_HELD = 256


def text_mask(text: bytes) -> int:
    """Bits of A to D: too few words, too few distinct ones, too many capitals, a mark."""
    words = text.split()  # bytes split at ASCII white space
    n = len(words)
    capitals, points = len(text) - len(text.translate(None, UPPER)), len(text.translate(None, CONTINUATION))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | marked << 3


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, whose filter is the first that the mask fails; 5 where it fails none."""
    fails = np.arange(32)[:, None] >> np.arange(5) & 1
    order = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    in_order = np.concatenate([fails[:, order], np.ones((32, len(ORDERS), 1), int)], 2)
    return in_order.argmax(2)


def measures_of(counts: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    """``MEASURES`` at each order and step, flat, of documents counted by [mask, good, toxic]."""
    n_orders = len(ORDERS)
    at = np.arange(n_orders) * 6 + table  # [mask, order]

    def removals(by_mask: np.ndarray) -> np.ndarray:
        weights = np.broadcast_to(by_mask[:, None], at.shape)
        return np.bincount(at.ravel(), weights.ravel(), 6 * n_orders).reshape(n_orders, 6)[:, :5].astype(np.int64)

    by_mask = counts.sum((1, 2))
    removed = removals(by_mask)
    letter = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    fails = np.array([by_mask[np.arange(32) >> f & 1 == 1].sum() for f in range(5)])
    only = by_mask[1 << np.arange(5)]
    shapley = np.bincount(letter.ravel(), removed.ravel(), 5).astype(np.int64)
    kept = by_mask.sum() - removed.cumsum(1)
    out = (kept, removed, fails[letter] - removed, only[letter], removals(counts[:, 1].sum(1)), removals(counts[:, :, 1].sum(1)), shapley[letter])
    return [x.ravel().astype(np.int64) for x in out]


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents counted by text, so that a text's copies meet as counts, never as rows."""

    def masks(batches):
        for batch in batches:
            texts = as_bytes(batch.column(2))
            out = [pa.array([text_mask(t) for t in texts], pa.int32()), pa.array([sha256(t).digest() for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *out], names=["doc_id", "part", "mask", "digest"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = wanted.mapInArrow(masks, "doc_id long, part string, mask int, digest binary").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.where("doc_id IS NOT NULL").join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    copies = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    # a text has a row for each part and label here, however many copies it has
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    copies = copies.withColumn("spared", F.when(first, F.col("n_least")).otherwise(0))
    sides = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("spared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("spared")).alias("n"))))
    copies = copies.select("part", "good", "toxic", sides.alias("side")).select("part", "side.mask", "good", "toxic", "side.n").where("n > 0")
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return copies.unionByName(nameless)


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, ``MEASURES``): a row for each part, order and step, zeros included."""
    table = first_failures()

    def audit(batches):
        held: dict[str, np.ndarray] = {}

        def hand_on():
            for name, counts in held.items():
                places = pa.array(np.arange(5 * len(ORDERS)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), places, *(pa.array(m, pa.int64()) for m in measures_of(counts, table))], names=["part", "place", *MEASURES])
            held.clear()

        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            mask, good, toxic, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            own = codes.indices.to_numpy(zero_copy_only=False)
            names = codes.dictionary.to_pylist()
            counted = np.bincount(((own.astype(np.int64) * 32 + mask) * 2 + good) * 2 + toxic, n, len(names) * 128).astype(np.int64).reshape(-1, 32, 2, 2)
            for name, counts in zip(names, counted, strict=True):
                held[name] = held.get(name, 0) + counts
            if len(held) > PARTS_HELD:
                yield from hand_on()
        yield from hand_on()

    partial = failure_counts(docs, labels, part).select("part", "mask", "good", "toxic", "n").mapInArrow(audit, "part string, place int, " + ", ".join(f"{m} long" for m in MEASURES))
    summed = partial.groupBy("part", "place").agg(*(F.sum(m).alias(m) for m in MEASURES))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), (F.floor(F.col("place") / 5) + 1).cast("int"))
    return summed.select("part", order.alias("filter_order"), (F.col("place") % 5 + 1).alias("step"), *MEASURES)
