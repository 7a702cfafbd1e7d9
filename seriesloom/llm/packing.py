"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document (its ids, then an end id) longer than a sequence is cut into
sequence-long pieces; only its last piece may be shorter.  Pieces are dealt
round-robin into shards of a bounded number of pieces and each shard is packed
by itself: a piece goes where the sum of squared counts of open bins per
residual gap becomes smallest, ties to the tighter gap.  Pieces come in classes
of falling length and in hashed order within a class; of a few class widths the
one that needs the fewest sequences is kept.

Null and empty texts hold only the end id.  Repeated rows are packed once each.
A null doc_id stays null.  An empty table gives no rows.  Input columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialise
from .tokens import CACHE_ENTRIES, default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Numbers of classes of falling length that are tried.
CLASSES = (4, 16, 256)


def cut_pieces(docs: DataFrame, tokenizer: str, sequence_length: int, end_id: int, cache: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece of at most ``sequence_length`` ids."""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches):
        enc, step = encoder(tokenizer, cache), 4 * sequence_length
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = enc.encode(text) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    out.append((doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the order given."""
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = 1 << 60
    for i, s in enumerate(lengths.tolist()):
        # the change of the sum for gaps s .. size-1, halved but for its constant
        have = count[s:size]
        change = np.where(have > 0, count[: size - s] - have, never) * 2 + 2
        best = fresh = 2 * int(count[size - s]) + 1 if s < size else 0
        gap = size
        if s < size:
            if have[0]:
                change[0] = 1 - 2 * have[0]
            k = int(change.argmin())
            if change[k] <= fresh:
                gap, best = s + k, int(change[k])
        if gap == size:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        left = gap - s
        bins[i], offsets[i] = b, size - gap
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, sequence_length: int, shard_pieces: int = 65_536) -> DataFrame:
    """Adds sequence_id and offset.  ``pieces`` is read twice, so it should be a stored table."""
    n = pieces.count()
    shards = max(1, math.ceil(n / shard_pieces))

    def pack(frames):
        got = [f for f in frames if len(f)]
        if not got:
            return
        df = pd.concat(got, ignore_index=True)
        length = df["length"].to_numpy()
        mix = pd.util.hash_pandas_object(df[["start", "length", "ids_crc32"]].astype("int64"), index=False).to_numpy()
        tried = []
        for classes in CLASSES:
            order = np.lexsort((mix, -(length * classes // (sequence_length + 1))))
            bins, offsets = sum_of_squares(length[order], sequence_length)
            tried.append((int(bins.max()), len(tried), order, bins, offsets))
        _, _, order, bins, offsets = min(tried, key=lambda t: t[:2])
        df = df.iloc[order].copy()
        df["sequence_id"] = (np.int64(TaskContext.get().partitionId()) << 32) + bins
        df["offset"] = offsets
        yield df

    return pieces.repartition(shards).mapInPandas(pack, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence_length: int = 2048, end_id: int = 0, shard_pieces: int = 65_536, cache: int = CACHE_ENTRIES) -> DataFrame:
    """Cut and pack: one row per piece with its sequence and its place there."""
    pieces = materialise(cut_pieces(docs, tokenizer or default_tokenizer(), sequence_length, end_id, cache), "pieces")
    return pack_pieces(pieces, sequence_length, shard_pieces)
