"""Exact k nearest (or farthest) neighbours over pivots, without comparing all pairs.

Items are put along a space-filling curve inside their bucket and cut into blocks
of neighbours on it; a block has a pivot (its mean) and a radius.  Blocks under a
common pivot form the next level, and so on, until a bucket has few nodes.  Each
item gets a bound first: the distance of its k-th nearest in its own block (or of
its k-th farthest among a few extreme items); a node's bound is its items' worst.
Then pairs of nodes go down level by level, and by the triangle inequality a pair
stays only if the distance of its pivots less both radii (plus both, for the
farthest) can still beat the bound of the items on the left.  The nodes of the
pairs that are left meet in a task: blocks by the same bounds, items of those by
a product of matrices, and what may be within the bounds by its exact distance.

So no bucket is compared with itself: a table of one bucket is many blocks, and a
key of the join is a node.  How much the bounds save depends on the data: few
dimensions or clustered vectors save most; in many dimensions all may stay.

Equal vectors are compared once: a vector stands for its ``k`` + 1 smallest ids,
and each of its items takes them back afterwards, so groups of copies of any size
cost what one item costs.  Ties go to the smaller id, after rounding.  Items whose
vector is null or holds nulls or NaN take no part.  ``k`` may be a column of the
items, e.g. to leave out some partners afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources.readers import discarded, stored

BLOCK, FAN = 64, 16
#: Pairs of nodes from which on the nodes above them meet; tasks at most.
MANY, TASKS = 20_000, 1_000
#: Bits of a place on the curve, all dimensions together; quantiles that coordinates are ranked by.
CURVE_BITS, QUANTILES = 60, 64


def curve(vector: Column, edges: list[list[float]]) -> Column:
    """Place of a vector on a Hilbert curve through the ranks of its coordinates, by the quantiles ``edges`` of each dimension."""
    dims = len(edges)
    bits = max(1, CURVE_BITS // dims)
    steps = np.linspace(0, 1, max(map(len, edges)))

    @F.pandas_udf("long")
    def code(vectors: pd.Series) -> pd.Series:
        rows = np.array(vectors.tolist(), float).reshape(len(vectors), -1)[:, :dims]
        x = [np.minimum(np.interp(rows[:, i], e, steps) * (1 << bits), (1 << bits) - 1).astype(np.int64) for i, e in enumerate(edges)]
        for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo the turns of each cell, from the largest down
            for i in range(dims):
                turned = x[i] & q != 0
                swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
                x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
                x[i] = x[i] ^ swap if i else x[0]
        for i in range(1, dims):
            x[i] = x[i] ^ x[i - 1]
        flip = np.zeros(len(rows), np.int64)
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            flip ^= np.where(x[-1] & q != 0, q - 1, 0)
        out = np.zeros(len(rows), np.int64)
        for b in range(bits - 1, -1, -1):
            for v in x:
                out = out << 1 | ((v ^ flip) >> b & 1)
        return pd.Series(out)

    return code(vector)


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0, in their group and its count ``size``: a range partition by group and order, counts of its slices, and no window over a group."""
    moved = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("number", F.monotonically_increasing_id())
    moved = stored(moved.withColumns({"slice": F.shiftright("number", 33), "number": F.col("number").bitwiseAND((1 << 33) - 1)}), "placed")
    counts = moved.groupBy(*keys, "slice").agg(F.count("*").alias("own"), F.min("number").alias("least"))
    group = Window.partitionBy(*keys)  # a row for each slice that the group lies in
    earlier = F.coalesce(F.sum("own").over(group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "slice", (earlier - F.col("least")).alias("shift"), F.sum("own").over(group).alias("size"))
    return moved.join(counts, [*keys, "slice"]).withColumn("place", F.col("number") + F.col("shift")).drop("number", "slice", "shift")


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero by the shortest decimal form, as Spark rounds."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    step = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(step, ROUND_HALF_UP))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a to all of b, summed dimension by dimension."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i : i + 1] - b[:, i]
        total += d * d
    return np.sqrt(total)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """An array<array<double>> column as matrices."""
    flat = column.flatten()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
    dims = len(values) // max(len(flat), 1)
    return [values[a * dims : b * dims].reshape(b - a, dims) for a, b in zip(ends, ends[1:])]


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def meetings(left: pa.Table, right: pa.Table, slack: float, farthest: bool) -> Iterator[tuple]:
    """For each block of the left node that blocks of the right one may serve: its points, vectors, k and bounds, which of its vectors each of the others' may serve, and those others' points, vectors and copies."""
    left, right = left.combine_chunks(), right.combine_chunks()
    one = lambda side, name: side.column(name).combine_chunks()
    bps, bvs, bcs = _lists(one(right, "points")), _vectors(one(right, "vs")), _lists(one(right, "copies"))
    pivots, radii = np.array(_lists(one(right, "pivot"))), one(right, "radius").to_numpy()
    for points, vs, ks, bounds in zip(_lists(one(left, "points")), _vectors(one(left, "vs")), _lists(one(left, "ks")), _lists(one(left, "bounds"))):
        d = distances(vs, pivots)
        serves = (-(d + radii) if farthest else d - radii) <= bounds[:, None] + slack
        near = np.flatnonzero(serves.any(0))
        if len(near):
            sizes = [len(bps[j]) for j in near]
            yield points, vs, ks, bounds, np.repeat(serves[:, near], sizes, 1), np.concatenate([bps[j] for j in near]), np.concatenate([bvs[j] for j in near]), np.concatenate([bcs[j] for j in near])


def hopeful(vs: np.ndarray, bv: np.ndarray, bounds: np.ndarray, slack: float, farthest: bool) -> np.ndarray:
    """Pairs of vectors that may be within the bounds, by one product of matrices whose error is let in."""
    sign = 1 if farthest else -1
    limit = np.maximum(sign * -bounds - slack * sign, 0) ** 2
    own, other = (vs * vs).sum(1), (bv * bv).sum(1)
    more = 1 + sign * 1e-12
    # the square of the distance less the limit, as one product
    a = np.column_stack([-2 * vs, np.ones(len(vs)), own * more - limit])
    b = np.column_stack([bv, other * more, np.ones(len(bv))])
    left = a @ b.T
    return left >= 0 if farthest else left <= 0


class Neighbours:
    """The levels of nodes over ``items`` and the pairs of blocks that the bounds leave."""

    def __init__(self, items: DataFrame, k: int | str, bucket: list[str], vector: str = "z", id_col: str = "id", digits: int = 6, farthest: bool = False, block: int = BLOCK, fan: int = FAN):
        self.digits, self.farthest, self.fan, self.written = digits, farthest, fan, []
        self.want = F.lit(k) if isinstance(k, int) else F.col(k)
        self.keys = [f"b{i}" for i in range(len(bucket))] or ["b0"]
        named = [F.col(c).alias(n) for c, n in zip(bucket, self.keys)] or [F.lit(0).alias("b0")]
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
        rows = items.where(F.col(vector).isNotNull() & finite).select(*named, F.col(id_col).alias("id"), F.col(vector).alias("v"), self.want.cast("int").alias("k"))
        rows = self._keep(rows, "items")
        # groups of equal vectors: the smallest ids of each, and how many of them any of its items may want
        own = Window.partitionBy(*self.keys, "v").orderBy("id")
        most = rows.agg(F.max("k")).first()[0] or 0
        first = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most + 1)
        self.items = rows
        points = first.groupBy(*self.keys, "v").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("ids"))
        wanted = rows.groupBy(*self.keys, "v").agg(F.max("k").alias("k"))
        points = self._keep(points.join(wanted.hint("merge"), [*self.keys, "v"]), "points")
        dims = points.agg(F.max(F.size("v"))).first()[0] or 1
        self.points, self.dims = points, dims
        shares = F.array(*(F.lit(i / QUANTILES) for i in range(QUANTILES + 1)))
        edges = [e or [0.0, 1.0] for e in points.agg(*(F.percentile_approx(F.col("v")[i], shares) for i in range(dims))).first()]
        places = placed(points.withColumn("at", curve(F.col("v"), edges)), self.keys, ["at", "point"])
        number = F.least(F.expr(f"place div {block}"), F.greatest(F.expr(f"size div {block}"), F.lit(1)) - 1)
        members = F.array_sort(F.collect_list(F.struct("place", "point", "v", "ids", "k")))
        blocks = places.groupBy(*self.keys, number.alias("node")).agg(members.alias("m"))
        blocks = blocks.select(*self.keys, "node", *(F.col(f"m.{c}").alias(name) for c, name in (("point", "points"), ("v", "vs"), ("k", "ks"))), F.transform("m", lambda x: F.size(x["ids"])).alias("copies"))
        self.blocks = self._keep(self._bounded(blocks, self._extremes(dims, most) if farthest else None), "blocks")
        self.levels = [self.blocks.select(*self.keys, "node", "pivot", "radius", "bound")]
        while self._widest() > fan:
            self.levels.append(self._keep(self._above(self.levels[-1]), "nodes"))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(stored(df, name))
        return self.written[-1]

    def _widest(self) -> int:
        """Nodes of the bucket that has most, at the highest level so far."""
        return self.levels[-1].groupBy(*self.keys).count().agg(F.max("count")).first()[0] or 0

    def _extremes(self, dims: int, most: int):
        """Items at the ends of each dimension, some for each bucket: what any item's farthest are at least as far as."""
        ends = []
        for i in range(dims):
            for order in (F.asc, F.desc):
                w = Window.partitionBy(*self.keys).orderBy(order(F.col("v")[i]), "point")
                ends.append(self.points.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most + 1).select(*self.keys, "point", "v", F.size("ids").alias("copies")))
        out = ends[0]
        for e in ends[1:]:
            out = out.union(e)
        return out.dropDuplicates([*self.keys, "point"]).groupBy(*self.keys).agg(F.collect_list("point").alias("xp"), F.collect_list("v").alias("xv"), F.collect_list("copies").alias("xc"))

    def _bounded(self, blocks: DataFrame, extremes: DataFrame | None) -> DataFrame:
        """Blocks with pivot, radius, each point's bound and the worst of them."""
        farthest = self.farthest
        if extremes is not None:
            blocks = blocks.join(extremes, self.keys)

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda name: batch.column(batch.schema.get_field_index(name))
                pivots, radii, bounds, worst = [], [], [], []
                own = zip(_lists(get("points")), _vectors(get("vs")), _lists(get("ks")), _lists(get("copies")))
                others = zip(_lists(get("xp")), _vectors(get("xv")), _lists(get("xc"))) if farthest else None
                for points, vs, ks, copies in own:
                    xp, xv, xc = next(others) if farthest else (points, vs, copies)
                    pivot = vs.mean(0)
                    d = distances(vs, xv)
                    d = -d if farthest else d
                    n = np.broadcast_to(xc, d.shape) - (points[:, None] == xp)  # an item is not its own neighbour, its copies are
                    order = np.argsort(d, 1, kind="stable")
                    reached = np.cumsum(np.take_along_axis(n, order, 1), 1) >= ks[:, None]
                    at = np.where(reached.any(1), reached.argmax(1), -1)
                    kth = np.where(at >= 0, np.take_along_axis(np.take_along_axis(d, order, 1), np.maximum(at, 0)[:, None], 1)[:, 0], np.inf)
                    pivots.append(pivot.tolist())
                    radii.append(float(distances(vs, pivot[None]).max()))
                    bounds.append(kth.tolist())
                    worst.append(float(kth.max()))
                kept = [c for c in batch.schema.names if c not in ("xp", "xv", "xc")]
                more = [pa.array(pivots, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(bounds, pa.list_(pa.float64())), pa.array(worst, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(get(c) for c in kept), *more], names=[*kept, "pivot", "radius", "bounds", "bound"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name not in ("xp", "xv", "xc"))
        return blocks.mapInArrow(bound, f"{fields}, pivot array<double>, radius double, bounds array<double>, bound double")

    def _above(self, nodes: DataFrame) -> DataFrame:
        """Nodes of the next level: the mean of their children's pivots, a radius that holds them, their worst bound."""
        up = nodes.groupBy(*self.keys, F.expr(f"node div {self.fan}").alias("node")).agg(F.collect_list(F.struct("pivot", "radius")).alias("own"), F.max("bound").alias("bound"))
        pivot = F.array(*(S.total(F.transform(F.col("own.pivot"), self._item(i))) / F.size("own") for i in range(self.dims)))
        up = up.withColumn("pivot", pivot)
        radius = F.array_max(F.transform("own", lambda x: self._distance(x["pivot"], F.col("pivot")) + x["radius"]))
        return up.select(*self.keys, "node", "pivot", radius.alias("radius"), "bound")

    @staticmethod
    def _item(i: int):
        return lambda x: x[i]

    @staticmethod
    def _distance(a: Column, b: Column) -> Column:
        return F.sqrt(S.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))

    def _near(self) -> Column:
        """Whether node b can hold a neighbour of an item of node a that beats a's bound; rounding is let in."""
        d, room = self._distance(F.col("a.pivot"), F.col("b.pivot")), F.col("a.radius") + F.col("b.radius")
        slack = F.lit(2 * 10.0**-self.digits)
        return F.col("a.bound") + slack >= (-(d + room) if self.farthest else d - room)

    def node_pairs(self) -> tuple[int, DataFrame]:
        """A level and (keys, a, b): its nodes whose blocks must meet.

        Pairs go down as far as the nodes above the blocks, and stop a level earlier where those pairs would be many: larger nodes
        meet fewer others, so their items are moved less often.
        """
        side = lambda nodes, name: nodes.select(*self.keys, F.struct("node", "pivot", "radius", "bound").alias(name))
        top = self.levels[-1]  # a few nodes of each bucket
        pairs = side(top, "a").join(side(top, "b"), self.keys).where(self._near()).select(*self.keys, F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        level = len(self.levels) - 1
        pairs = self._keep(pairs, "pairs")
        while level > 1:
            nodes, parent = self.levels[level - 1], F.expr(f"node div {self.fan}")
            below = lambda name: nodes.select(*self.keys, parent.alias(f"{name}p"), F.struct("node", "pivot", "radius", "bound").alias(name))  # noqa: B023, E731
            down = pairs.select(*self.keys, F.col("a").alias("ap"), F.col("b").alias("bp")).join(below("a"), [*self.keys, "ap"]).join(below("b"), [*self.keys, "bp"])
            down = self._keep(down.where(self._near()).select(*self.keys, F.col("a.node").alias("a"), F.col("b.node").alias("b")), "pairs")
            if level == 2 and down.count() > MANY:
                break
            pairs, level = down, level - 1
        return level, pairs

    def compared(self) -> int:
        """Pairs of different vectors whose distance is worked out, a vector with itself included."""
        slack, farthest = 2 * 10.0**-self.digits, self.farthest

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.table({"n": pa.array([sum(int(serves.sum()) for _, _, _, _, serves, _, _, _ in meetings(left, right, slack, farthest)) if left.num_rows and right.num_rows else 0], pa.int64())})

        return self._met(count, "n long").agg(F.sum("n")).first()[0] or 0

    def _met(self, meet, schema: str) -> DataFrame:
        """``meet(left, right)`` on the blocks of each pair of nodes: as many tasks as the pairs need, whatever their bytes."""
        level, pairs = self.node_pairs()
        tasks = min(pairs.count() // 4 + 1, TASKS)
        node = F.expr(f"node div {self.fan**level}")
        left = self.blocks.select(*self.keys, node.alias("a"), "points", "vs", "ks", "bounds").join(pairs, [*self.keys, "a"])
        right = self.blocks.select(*self.keys, node.alias("b"), "points", "vs", "copies", "pivot", "radius").join(pairs, [*self.keys, "b"])
        right = right.select(*(F.col(c).alias(c) for c in right.columns))
        both = [*self.keys, "a", "b"]
        return left.repartition(tasks, *both).groupBy(*both).cogroup(right.repartition(tasks, *both).groupBy(*both)).applyInArrow(meet, schema)

    def result(self) -> DataFrame:
        """(id, cand_id, rank, dist), the rank up to each item's k."""
        farthest, digits, slack = self.farthest, self.digits, 2 * 10.0**-self.digits

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            rows: list[list[np.ndarray]] = [[], [], []]
            for points, vs, ks, bounds, serves, bp, bv, bc in meetings(left, right, slack, farthest) if left.num_rows and right.num_rows else ():
                i, j = np.nonzero(serves & hopeful(vs, bv, bounds, slack, farthest))
                total = np.zeros(len(i))
                for c in range(vs.shape[1]):
                    step = vs[i, c] - bv[j, c]
                    total += step * step
                d = np.sqrt(total)
                shown = rounded(d, digits)
                order = np.lexsort((bp[j], -shown if farthest else shown, i))
                i, j, d, shown = i[order], j[order], d[order], shown[order]
                starts = np.searchsorted(i, np.arange(len(vs) + 1))
                for p in range(len(vs)):
                    own = slice(starts[p], starts[p + 1])
                    bs = bp[j[own]]
                    if len(bs):
                        has = np.cumsum(bc[j[own]] - (bs == points[p]))
                        stop = int(np.searchsorted(has, ks[p])) + 1
                        # points that tie with the last one may hold smaller ids than it
                        near = shown[own]
                        last = near[min(stop, len(bs)) - 1]
                        keep = max(stop, int(((near >= last) if farthest else (near <= last)).sum()))
                        rows[0].append(np.full(len(bs[:keep]), points[p]))
                        rows[1].append(bs[:keep])
                        rows[2].append(d[own][:keep])
            kinds = left.schema.field("points").type.value_type
            full = [np.concatenate(r) if r else [] for r in rows]
            return pa.table({"point": pa.array(full[0], kinds), "other": pa.array(full[1], kinds), "d": pa.array(full[2], pa.float64())})

        point_type = self.points.schema["point"].dataType.simpleString()
        found = self._met(meet, f"point {point_type}, other {point_type}, d double")
        # points are the smallest ids of their vectors, so ids in other vectors are greater: all that a vector may give is in its list
        direction = F.desc("dist") if farthest else F.asc("dist")
        # all of these grow with the items, however small their files are, so none is broadcast
        names = self.points.select(F.col("point").alias("other"), "ids").hint("merge")
        near = found.select("point", "other", F.round("d", digits).alias("dist"))
        w = Window.partitionBy("point").orderBy(direction, "cand_id")
        most = self.points.select("point", "k").hint("merge")
        ids = near.join(names, "other").select("point", "dist", F.explode("ids").alias("cand_id"))
        ids = ids.withColumn("nth", F.row_number().over(w)).join(most, "point").where(F.col("nth") <= F.col("k") + 1).drop("k", "nth")
        own = self.items.join(self.points.select(*self.keys, "v", "point").hint("merge"), [*self.keys, "v"]).select("id", "point", "k")
        pairs = own.join(ids.hint("merge"), "point").where("id <> cand_id")
        rank = F.row_number().over(Window.partitionBy("id").orderBy(direction, "cand_id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= F.col("k")).select("id", "cand_id", "rank", "dist")


def k_nearest(items: DataFrame, k: int | str, bucket: list[str], vector: str = "z", id_col: str = "id", digits: int = 6, farthest: bool = False) -> DataFrame:
    """(id, cand_id, rank, dist), written; what it was made of is deleted."""
    found = Neighbours(items, k, bucket, vector, id_col, digits, farthest)
    out = stored(found.result(), "neighbours")
    for table in found.written:
        discarded(table)
    return out


def most_similar_others(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6, block: int = 4096) -> DataFrame:
    """(id, cand_id, rank, sim): for each of ``queries`` its k ``rows`` (both id, label, e) of another label with the highest inner product.

    Blocks of both sides meet, cut by hash and of no label alone; each keeps the first k of a query.  All pairs are looked at,
    in bounded memory; none is shuffled.  Rows without a label or a vector take no part.
    """
    kind = rows.schema["id"].dataType.simpleString()
    rows, queries = (df.where("label is not null and e is not null") for df in (rows, queries))
    sides = [(df, max(1, df.count() // block)) for df in (queries, rows)]
    (q, many_q), (c, many_c) = sides
    cut = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = q.select(cut(many_q).alias("a"), spread(many_c).alias("b"), *(F.col(n).alias(n) for n in ("id", "label", "e")))
    right = c.select(spread(many_q).alias("a"), cut(many_c).alias("b"), *(F.col(n).alias(n) for n in ("id", "label", "e")))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
        out: list[list] = [[], [], []]
        if len(ids) and len(others):
            own, theirs = (np.array(_lists(t.column("e").combine_chunks())) for t in (left, right))
            labels, their_labels = left.column("label").to_numpy(), right.column("label").to_numpy()
            for at in range(0, len(ids), 256):  # a few queries at once
                mine = own[at : at + 256]
                near = np.where(labels[at : at + 256, None] != their_labels, mine @ theirs.T, -np.inf)
                kth = np.partition(near, max(near.shape[1] - k, 0), 1)[:, max(near.shape[1] - k, 0)]
                i, j = np.nonzero((near >= kth[:, None] - 2 * 10.0**-digits) & (near > -np.inf))
                total = np.zeros(len(i))
                for d in range(mine.shape[1]):
                    total += mine[i, d] * theirs[j, d]
                shown = rounded(total, digits)
                order = np.lexsort((others[j], -shown, i))
                i, j, shown = i[order], j[order], shown[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out[0].append(ids[at + i[first]])
                out[1].append(others[j[first]])
                out[2].append(shown[first])
        a, b, sim = (np.concatenate(o) if o else [] for o in out)
        return pa.table({"id": pa.array(a, left.schema.field("id").type), "cand_id": pa.array(b, right.schema.field("id").type), "sim": pa.array(sim, pa.float64())})

    tasks = min(many_q * many_c, TASKS)
    found = left.repartition(tasks, "a", "b").groupBy("a", "b").cogroup(right.repartition(tasks, "a", "b").groupBy("a", "b")).applyInArrow(meet, f"id {kind}, cand_id {kind}, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "cand_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "cand_id", "rank", "sim")
