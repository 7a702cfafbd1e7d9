"""Exact top-k search by inner product over an impact-ordered index, score at a time.

A vector's components become integers floor(1024 * x).  The index holds shards
of at most ``SHARD`` vectors and ``CELLS`` components.  In a shard each dimension
has posting segments: the vectors whose component has the same quantised impact,
highest first.  For a query, segments of all dimensions are processed by
descending quantised contribution (query component times the segment's largest
component in its favour).  A vector's bound is what it has gathered so far,
segments' upper bounds all, and the best that each dimension's segments still to
come could add.  After each of ``STEPS`` parts of the segments the bounds are
held against the k-th best exact score known (from the best bounds of the first
shard, then from shard to shard).  Processing stops when few vectors' bounds reach
it, or all segments that could add are done; all vectors that may be members are
rescored exactly.  Results are exact.

Queries go out in blocks of at most ``QUERY_BLOCK`` vectors, a pass over the
stored index for each block, so what is broadcast is bounded.

Vectors that are null or hold null or non-finite components take no part; rows
with a null id neither.  Shorter vectors count as ending in zeros; vectors of very
different lengths get shards of their own.  Ties go to the smaller id; repeated
rows are ranked one by one.  A query without candidates has no rows.  Components
of 2**52 or more, and scores that do not fit 64-bit integers, are an error.  Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARD = 8192
CELLS = 1 << 22
QUERY_BLOCK = 16_384
#: Quantised impact levels in a dimension.
LEVELS = 16
#: Parts of the segments after which bounds are looked at.
STEPS = 8
#: Processing stops when at most one vector in so many may still be a member: rescoring those is the cheaper way.
RESCORE = 8
INDEX = "ids binary, n int, dims int, values binary, postings binary, bounds binary"


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): integer components."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    too_large = F.exists(v, lambda x: F.abs(x.cast("double")) >= float(1 << 42))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    ints = F.when(too_large, F.raise_error(F.lit("a vector's component is too large for exact integer scores"))).otherwise(ints)
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))


def _dense(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    dims = int(sizes.max()) if len(sizes) else 0
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """A row per shard: ids, values (rows by dimensions), postings (a permutation per dimension, highest value first) and the segments' bounds."""

    def shards(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close():
            dims = max(v.shape[1] for _, v in held)
            ids = np.concatenate([i for i, _ in held])
            values = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for _, v in held])
            held.clear()
            n = len(ids)
            order = np.argsort(-values, axis=0, kind="stable").T
            low, high = values.min(axis=0, initial=0), values.max(axis=0, initial=0)
            width = np.maximum(1, -(-(high - low + 1) // LEVELS))
            level = np.take_along_axis((values - low) // width, order.T, axis=0).T  # falling in each dimension
            bounds = np.stack([np.searchsorted(-row, np.arange(-LEVELS, 0) + 1, side="right") for row in level]) if dims else np.zeros((0, LEVELS), np.int64)
            row = [ids.astype("<i8").tobytes(), n, dims, values.astype("<i4" if np.abs(values).max(initial=0) < 1 << 31 else "<i8").tobytes(), order.astype("<i4").tobytes(), bounds.astype("<i4").tobytes()]
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["ids", "n", "dims", "values", "postings", "bounds"])

        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            if len(sizes) and len(sizes) * int(sizes.max()) > CELLS:
                batch = batch.take(pa.array(np.argsort(sizes, kind="stable")))  # alike lengths together
                sizes = np.sort(sizes)
            a = 0
            while a < len(sizes):
                b = min(len(sizes), a + shard)
                while b > a + 1 and (b - a) * int(sizes[a:b].max()) > CELLS:
                    b = a + (b - a) // 2
                part = batch.slice(a, b - a)
                rows, dims = sum(len(i) for i, _ in held), max((v.shape[1] for _, v in held), default=0)
                if held and (rows + b - a > shard or (rows + b - a) * max(dims, int(sizes[a:b].max())) > CELLS):
                    yield close()
                held.append((part.column(0).to_numpy(zero_copy_only=False), _dense(part.column(1))))
                a = b
        if held:
            yield close()

    return vectors.mapInArrow(shards, INDEX)


class Shard:
    def __init__(self, ids: bytes, n: int, dims: int, values: bytes, postings: bytes, bounds: bytes):
        self.n, self.dims = n, dims
        self.ids = np.frombuffer(ids, "<i8")
        kind = "<i4" if len(values) == 4 * n * dims else "<i8"
        self.values = np.frombuffer(values, kind).reshape(n, dims).astype(np.int64)
        self.floats, self.largest = self.values.astype(np.float64), np.abs(self.values).max(initial=0)
        self.postings = np.frombuffer(postings, "<i4").reshape(dims, n).astype(np.int64)
        ends = np.frombuffer(bounds, "<i4").reshape(dims, LEVELS).astype(np.int64)
        starts = np.concatenate([np.zeros((dims, 1), np.int64), ends[:, :-1]], axis=1)
        full = ends > starts
        self.dim, _ = np.nonzero(full)
        self.a, self.b = starts[full], ends[full]
        self.top = self.values[self.postings[self.dim, self.a], self.dim]
        self.bottom = self.values[self.postings[self.dim, self.b - 1], self.dim]

    def exact(self, rows: np.ndarray | slice, q: np.ndarray) -> np.ndarray:
        """Scores of some rows: by floating point where every sum fits it, else by integers."""
        most = int(self.largest) * sum(map(abs, q.tolist()))
        if most < 1 << 53:
            return (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        if most < 1 << 63:
            return self.values[rows] @ q
        scores = self.values[rows].astype(object) @ q.astype(object)
        if len(scores) and max(map(abs, scores)) >= 1 << 63:
            raise OverflowError("a score does not fit a 64-bit integer")
        return scores.astype(np.int64)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Exact scores and ids of all vectors whose bound reaches ``floor``, or the k-th best score found where that is higher or none is given; and how many postings were read."""
        q = np.zeros(self.dims, np.int64)
        q[: min(len(query), self.dims)] = query[: self.dims]
        rows, read = np.arange(self.n), 0
        if int(self.largest) * sum(map(abs, q.tolist())) < 1 << 62:  # else bounds could overflow
            w = q[self.dim]
            gain = np.where(w >= 0, w * self.top, w * self.bottom)
            order = np.argsort(-gain, kind="stable")
            order = order[: int(np.searchsorted(-gain[order], 0))]  # later segments can only lower
            gain, dims = gain[order], self.dim[order]
            a, b, steps, dim = self.a[order].tolist(), self.b[order].tolist(), gain.tolist(), dims.tolist()
            gathered, cuts = np.zeros(self.n, np.int64), [len(order) * i // STEPS for i in range(STEPS + 1)]
            for begin, end in zip(cuts, cuts[1:]):
                for i in range(begin, end):
                    gathered[self.postings[dim[i], a[i] : b[i]]] += steps[i]
                    read += b[i] - a[i]
                # a dimension's next segment bounds what it can still add
                best = np.zeros(self.dims, np.int64)
                np.maximum.at(best, dims[end:], gain[end:])
                to_come = int(best.sum())
                if floor is None and end > begin:
                    top = rows if self.n <= 4 * k else np.argpartition(-gathered, 4 * k)[: 4 * k]
                    got = np.sort(self.exact(top, q)[self.ids[top] != own])[::-1]
                    floor = int(got[k - 1]) if len(got) >= k else None
                if floor is not None:
                    rows = np.flatnonzero(gathered >= floor - to_come)
                    if len(rows) <= self.n // RESCORE:
                        break
        rows = rows[self.ids[rows] != own]
        scores = self.exact(rows, q)
        if floor is not None:
            scores, rows = scores[scores >= floor], rows[scores >= floor]
        return scores, self.ids[rows], read


def _search_block(index: DataFrame, block: list, k: int) -> DataFrame:
    """Each task's k best for each query of a block: it carries the k-th best score from shard to shard."""
    names = np.array([r["id"] for r in block], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((names, [np.array(r["v"], np.int64) for r in block]))

    def search(batches):
        names, vectors = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                shard = Shard(*row)
                for i, q in enumerate(vectors):
                    scores, ids = best[i]
                    new, own, _ = shard.search(q, int(names[i]), k, int(scores[k - 1]) if len(scores) == k else None)
                    scores, ids = np.concatenate([scores, new]), np.concatenate([ids, own])
                    keep = np.lexsort((ids, -scores))[:k]
                    best[i] = scores[keep], ids[keep]
        sizes = [len(s) for s, _ in best]
        arrays = [np.repeat(np.arange(len(names)), sizes), np.repeat(names, sizes), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["row", "query_id", "vec_id", "score"])

    return index.mapInArrow(search, "row long, query_id long, vec_id long, score long")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` and ``vectors`` (id: long, v: array<long>); rows with a query's own id are no candidates of it."""
    full = max(1, math.ceil(vectors.count() / shard))
    index = materialise(build_index(vectors.coalesce(full), shard), "impacts")
    queries = materialise(queries.select("id", "v"), "queries")
    blocks = max(1, math.ceil(queries.count() / query_block))
    found = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # of about query_block rows
        if block:
            part = _search_block(index, block, k).withColumn("block", F.lit(i))
            part = part if blocks == 1 else materialise(part, "best")
            found = part if found is None else found.union(part)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("block", "row", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
