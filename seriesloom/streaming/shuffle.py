"""A shuffle that keeps streaming: each partition passes its rows through a buffer of bounded size.

A row leaves when a later one takes its random slot, and the rest leaves in random
order at the end.  The order depends on the seed, the partition's number and its
rows' order alone, not on the size of Arrow batches.  Works on a stream as on a
table; no row changes its partition and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


def shuffled_batches(batches: Iterator[pa.RecordBatch], size: int, rng: np.random.Generator) -> Iterator[pa.RecordBatch]:
    """``batches`` with their rows in the order in which they leave a buffer of ``size`` rows."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        first = 0 if held is None else held.num_rows
        slots, out = list(range(first)), []
        for i in range(first, table.num_rows):
            if len(slots) < size:
                slots.append(i)
            else:
                slot = int(rng.integers(size))
                out.append(slots[slot])
                slots[slot] = i
        held = table.take(pa.array(slots, pa.int64())).combine_chunks()
        if out:
            yield from table.take(pa.array(out, pa.int64())).combine_chunks().to_batches()
    if held is not None and held.num_rows:
        yield from held.take(pa.array(rng.permutation(held.num_rows))).combine_chunks().to_batches()


def buffer_shuffled(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``rows`` shuffled through buffers of ``size`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shuffled_batches(batches, size, np.random.default_rng([seed, TaskContext.get().partitionId()]))

    return rows.mapInArrow(work, rows.schema)
