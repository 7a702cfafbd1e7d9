"""Repeated lines across documents: all but the smallest document that holds a line lose it.

Two Bloom filters, one of line hashes seen once and one of those seen again, are
filled in every task over whole texts and merged piece by piece; the second one
goes to all tasks.  Only lines that it suspects are shuffled, as the SHA-256 of
their key: those that two documents hold are confirmed, and the smallest
document is chosen.  A filter has no false negatives, so nothing is missed;
false positives cost shuffled rows, never results.  Filters have 16 bits for each
line, up to ``max_bits``: beyond that more lines are suspected and shuffled,
and the result stays the same.

A text is split at ``\\n``; null and empty texts are one empty line.  A line's
key is the line without ASCII white space at both ends, A-Z lower-cased; keys
under ``min_chars`` code points never count.  Equal lines inside one document do
not make a repeat; where a repeat is found the other documents lose all its
lines.  Rows of one doc_id are one document; rows without doc_id are one too,
which comes after all others.  Repeated rows stay, each with the same cuts.
Columns other than doc_id and text are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, join_counted, materialise

MIN_CHARS = 10
MIN_BITS, MAX_BITS, BITS_PER_LINE = 1 << 16, 1 << 28, 16
#: Bytes of a filter that are merged as one row.
PIECE = 1 << 13
WHITE = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
#: The document of rows without doc_id.
LAST_DOC = (1 << 63) - 1


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """Each line's key, or None where it is too short to count."""
    keys = [line.strip(WHITE).lower() for line in text.split(b"\n")]
    return [k if len(k) >= 4 * min_chars or len(k) >= min_chars and len(k.translate(None, CONTINUATION)) >= min_chars else None for k in keys]


class Filter:
    """A Bloom filter of packed bits with two places for each 64-bit hash."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(bits // 8, np.uint8)

    def _places(self, hashes: np.ndarray):
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for byte, bit in self._places(hashes):
            out &= self.data[byte] & bit != 0
        return out

    def add(self, hashes: np.ndarray) -> None:
        for byte, bit in self._places(hashes):
            np.bitwise_or.at(self.data, byte, bit)


def _hashes(keys) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def filter_bits(lines: int, max_bits: int = MAX_BITS) -> int:
    """A power of two with 16 bits for each line, within its limits."""
    return max(MIN_BITS, min(max_bits, 1 << (BITS_PER_LINE * max(lines, 1) - 1).bit_length()))


def seen_again(texts: DataFrame, bits: int, min_chars: int) -> bytes:
    """The filter of line hashes that at least two rows hold: ``bits`` / 8 bytes, whatever the input."""

    def fill(batches):
        once, twice = Filter(bits), Filter(bits)
        for batch in batches:
            got = _hashes(k for t in as_bytes(batch.column(0)) for k in set(keys_of(t, min_chars)) if k is not None)
            own, n = np.unique(got, return_counts=True)
            twice.add(own[(n > 1) | once.has(own)])
            once.add(own)
        pieces = [(i, once.data[a : a + PIECE], twice.data[a : a + PIECE]) for i, a in enumerate(range(0, bits // 8, PIECE))]
        kept = [(i, zlib.compress(a.tobytes(), 1), zlib.compress(b.tobytes(), 1)) for i, a, b in pieces if a.any()]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["piece", "once", "twice"])

    def merge(batches):
        state: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                once, twice = state.get(piece, (0, 0))
                state[piece] = [once | a, twice | b | (once & a)]
        kept = [(i, zlib.compress(twice.tobytes(), 1)) for i, (_, twice) in state.items() if twice.any()]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int32()), pa.array([x[1] for x in kept], pa.binary())], names=["piece", "twice"])

    filled = texts.select("text").mapInArrow(fill, "piece int, once binary, twice binary")
    merged = filled.repartition(max(1, min(bits // 8 // PIECE, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "piece")
    out = np.zeros(bits // 8, np.uint8)
    for piece, twice in merged.mapInArrow(merge, "piece int, twice binary").collect():  # max_bits / 8 bytes at most
        got = np.frombuffer(zlib.decompress(twice), np.uint8)
        out[piece * PIECE : piece * PIECE + len(got)] = got
    return out.tobytes()


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each document without the lines that a smaller one holds."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    lines = texts.agg(F.sum(breaks)).first()[0] or 0
    bits = filter_bits(lines, max_bits)
    shared = spark.sparkContext.broadcast(seen_again(texts, bits, min_chars))  # max_bits / 8 bytes at most

    def suspect(batches):
        twice = Filter(bits, shared.value)
        for batch in batches:
            found = []
            for text in as_bytes(batch.column(2)):
                keys = list({k for k in keys_of(text, min_chars) if k is not None})
                again = twice.has(_hashes(keys)) if keys else []
                found.append([sha256(k).digest() for k, hit in zip(keys, again, strict=True) if hit])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.binary()))], names=["row", "doc_id", "text", "found"])

    # row numbers are written with the rows, so they hold for all later reads
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    seen = materialise(rows.mapInArrow(suspect, "row long, doc_id long, text string, found array<binary>"), "lines-seen")
    shared.unpersist()
    suspects = seen.select("row", F.coalesce("doc_id", F.lit(LAST_DOC)).alias("doc"), F.explode("found").alias("key"))
    holders = suspects.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    holders = materialise(holders, "line-holders")
    repeats = join_counted(suspects, holders, "key", "n").where("first < last AND doc > first")
    drops = materialise(repeats.groupBy("row").agg(F.collect_list("key").alias("drop")), "line-drops")  # a row's own lines
    discard(holders)

    def cut(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = text.split(b"\n")
                if drop:
                    gone = set(drop)
                    left = [line for line, k in zip(own, keys_of(text, min_chars), strict=True) if k is None or sha256(k).digest() not in gone]
                else:
                    left = own
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    # texts move only where a line is suspected
    clean = seen.where(F.size("found") == 0).select("doc_id", breaks.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "text")
    marked = seen.where(F.size("found") > 0).join(drops, "row", "left").select("doc_id", "text", "drop")
    marked = marked.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept binary")
    return clean.unionByName(marked.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text")))
