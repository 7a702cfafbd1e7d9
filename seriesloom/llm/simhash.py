"""SimHash near-duplicates: exact Hamming comparison of fingerprints in tiles.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of
``words`` words with repeats; a bit is 1 if set in over half of the shingles'
hashes.  With one lane these are XXH64 values, with two the halves of 128-bit
XXH3 ones.  Fingerprints within ``radius`` bits, over all lanes, are linked.

Equal fingerprints are merged first.  Two fingerprints within the radius are
within ``radius // lanes`` in one lane, and there agree on at least ``blocks -
radius // lanes`` of ``blocks`` bit blocks; so a tile holds the fingerprints that
agree on one such choice of blocks: every pair within the radius meets in a tile
and no tile pair beyond that is formed.  In a tile, fingerprints are ordered by
population count and compared block against block by exclusive-or and bit counts;
block pairs whose population counts differ by more than the radius are skipped.  A
tile gives a spanning star per group, never all its pairs, and a task joins the
groups of its tiles before it emits a star of each, to its smallest node.  Tiles above ``TILE``
fingerprints are split into parts that meet pairwise in tasks of their own.

``keep_one`` takes five words, and two lanes within 22 of 128 bits: measured on
sampled neighbours, that links 0.93 of the pairs whose sets of shingles are
similar by 0.8 or more, half of those from 0.7 to 0.8 and a sixth from 0.6 to 0.7.

Null and empty texts have fingerprint zero and are linked like any other.  Rows
with a null doc_id take part; a component's id is its smallest non-null doc_id.
Repeated rows each get a result row.  Very long texts are hashed block by block.
Extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``.  An
empty table gives an empty one.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, discard, free_name, join_counted, materialise, word_blocks
from .graph import connected_components

SEED = 42
#: Fingerprints compared in one task's tile; larger tiles are split.
TILE = 16_384
#: Mean size of a tile that decides the number of blocks, by lanes.
MEAN_TILE = {1: 64, 2: 512}
#: Linked nodes that a task joins before it hands their links on.
HELD_NODES = 200_000
#: Bits of 128 within which ``keep_one`` links.
WIDE_RADIUS = 22


def _hash(lanes: int):
    from xxhash import xxh3_128_digest, xxh64_digest

    return (lambda x: xxh64_digest(x, SEED)) if lanes == 1 else (lambda x: xxh3_128_digest(x, SEED))


def fingerprints_of(text: bytes, words: int = 4, lanes: int = 1) -> list[int]:
    """A signed 64-bit value for each lane."""
    digest, width = _hash(lanes), 8 * lanes
    count, n, carried = np.zeros(8 * width, np.int64), 0, []

    def add(parts: list[bytes], least: int) -> None:
        nonlocal n
        joined = memoryview(b" ".join(parts))
        ends = [e + i for i, e in enumerate(accumulate(map(len, parts)))]
        starts = [0, *(e + 1 for e in ends[:-1])]
        raw = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts, ends[least - 1 :])]), np.uint8).reshape(-1, width)
        n += len(raw)
        for i in range(0, len(raw), 65_535):
            count[:] += np.unpackbits(raw[i : i + 65_535], axis=1).sum(axis=0, dtype=np.uint32)

    for block in word_blocks(text):
        parts = carried + block.lower().split()
        if len(parts) >= words:
            add(parts, words)
        carried = parts[-(words - 1) :] if words > 1 else []
    if not n and carried:
        add(carried, len(carried))
    return np.frombuffer(np.packbits(count * 2 > n).tobytes(), ">i8").tolist()


def fingerprint(text: bytes, words: int = 4) -> int:
    return fingerprints_of(text, words)[0]


def lane_names(lanes: int) -> list[str]:
    return ["fp", "fp2"][:lanes]


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, fp[, fp2])."""

    def prints(batches):
        for batch in batches:
            fps = np.array([fingerprints_of(t, words, lanes) for t in as_bytes(batch.column(1))], np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(lanes))], names=["doc_id", *lane_names(lanes)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long" + "".join(f", {n} long" for n in lane_names(lanes)))


def block_masks(n: int, radius: int, mean_tile: int = MEAN_TILE[1]) -> list[int]:
    """Bit masks of which any two values within the radius agree on one: as few as keep tiles small."""
    for blocks in range(radius + 1, 2 * radius + 1):
        agree = blocks - radius
        if n / 2 ** (64 * agree // blocks) <= mean_tile:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tile_links(values: np.ndarray, radius: int, side: int = 1024) -> np.ndarray:
    """(member, root) rows, by their place in ``values`` (a row per fingerprint, a column per lane), for those linked inside a tile."""
    u = np.ascontiguousarray(values.T).view(np.uint64)
    bits = np.bitwise_count(u).astype(np.int64).sum(axis=0)
    order = np.argsort(bits, kind="stable")
    u, bits = u[:, order], bits[order]
    n = len(order)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(pairs) -> None:
        for x, y in pairs:
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)

    def settle() -> np.ndarray:
        nonlocal root
        while not np.array_equal(up := root[root], root):
            root = up
        return root

    for a in range(0, n, side):
        top = bits[min(a + side, n) - 1] + radius
        for b in range(a, n, side):
            if bits[b] > top:
                break
            far = np.bitwise_count(u[0, a : a + side, None] ^ u[0, None, b : b + side])
            for lane in u[1:]:
                far += np.bitwise_count(lane[a : a + side, None] ^ lane[None, b : b + side])
            near = far <= radius
            if a == b:
                near = np.triu(near, 1)
            cols = np.flatnonzero(near.any(axis=0))
            if not len(cols):
                continue
            # first one link for each column, then only links between groups that are still apart
            unite(zip((near[:, cols].argmax(axis=0) + a).tolist(), (cols + b).tolist(), strict=True))
            group = settle()
            i, j = np.nonzero(near & (group[a : a + side, None] != group[None, b : b + side]))
            apart = np.unique(np.stack([group[i + a], group[j + b]], axis=1), axis=0)
            unite(apart.tolist())
    at = settle()
    linked = np.flatnonzero(at != np.arange(n))
    return np.stack([order[linked], order[at[linked]]], axis=1)


def links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges of nodes whose components are those of the graph of all fingerprint pairs within the radius.

    ``prints``: node, fp[, fp2], a row per distinct fingerprint, stored.
    """
    names = [c for c in lane_names(2) if c in prints.columns]
    lanes = len(names)
    masks = block_masks(prints.count(), radius // lanes, MEAN_TILE[lanes])
    # a tile is named by a hash of mask and agreeing bits; tiles that share a name are compared together
    tiles = [F.xxhash64(F.lit(i * lanes + k), F.col(name).bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks) for k, name in enumerate(names)]
    keyed = prints.select("node", *names, F.explode(F.array(*tiles)).alias("key"))
    # tiles too large for a task meet part against part
    big = keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("parts"))
    big = materialise(big, "tiles")
    split = keyed.join(big, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select("node", *names, F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"))
    spread = keyed.select("node", *names, "key") if big.isEmpty() else keyed.join(big, "key", "left_anti").select("node", *names, "key").union(split)

    def compare(batches):
        held: list[np.ndarray] = []
        last = None
        above: dict[int, int] = {}  # of the nodes linked in this task: a smaller one of the same group, or the node itself

        def smallest(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        def flush():
            if held:
                group = np.concatenate(held)
                if len(group) > 1:
                    for x, y in group[:, 0][tile_links(group[:, 1:], radius)].tolist():
                        x, y = smallest(above.setdefault(x, x)), smallest(above.setdefault(y, y))
                        above[max(x, y)] = min(x, y)
                held.clear()

        def edges():
            found = [(i, root) for i in above if (root := smallest(i)) != i]
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(1 + lanes)], axis=1)
            keys = batch.column(1 + lanes).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != last:
                    flush()
                    last = keys[a]
                held.append(rows[a:b])
            if len(above) > HELD_NODES:
                yield edges()
        flush()
        yield edges()

    dealt = spread.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _components(own: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """(fp[, fp2], first, root) of each distinct fingerprint, stored; ``first``: its smallest doc_id. ``own``: doc_id and fingerprints, stored."""
    names = lane_names(lanes)
    distinct = own.groupBy(*names).agg(F.min("doc_id").alias("first"))
    distinct = materialise(distinct.withColumn("node", F.col("fp") if lanes == 1 else F.monotonically_increasing_id()), "distinct")
    roots = connected_components(links(distinct.select("node", *names), radius)).withColumnRenamed("node", "__node")
    placed = distinct.join(roots, F.col("node") == F.col("__node"), "left").select(*names, "first", F.coalesce("root", "node").alias("root"))
    return materialise(placed, "placed")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per document."""
    own = materialise(fingerprints(docs, words), "prints")
    placed = _components(own, radius)
    # a component or a fingerprint may hold a third of all rows: both are joined by their counts
    ids = materialise(placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "components")
    of_print = join_counted(placed.select("root", "fp"), ids, "root", "n").select("fp", "component_id")
    by_print = materialise(of_print.join(own.groupBy("fp").agg(F.count("*").alias("n")), "fp"), "by_print")
    discard(ids)
    discard(placed)
    own = join_counted(own, by_print, "fp", "n")
    return own.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = WIDE_RADIUS, lanes: int = 2) -> DataFrame:
    """One row of each component: one of its smallest doc_id, or any one of a component whose rows all lack a doc_id.

    A doc_id may repeat: which of its rows is meant is then told by the fingerprint.
    """
    names = lane_names(lanes)
    own = materialise(fingerprints(docs, words, lanes), "prints")
    first = _components(own, radius, lanes).groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", *names)).alias("m")).select("m.*")
    keep, other, *lanes_of = (free_name(docs.columns, f"one_{n}") for n in ("id", "other", *names))
    first = materialise(first.select(F.col("first").alias(keep), *(F.col(n).alias(x) for n, x in zip(names, lanes_of, strict=True))), "first")
    unclear = materialise(own.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(other)), "unclear")
    clear = first.join(unclear, F.col(keep) == F.col(other), "left_anti").where(F.col(keep).isNotNull())
    kept = docs.join(clear, F.col("doc_id") == F.col(keep), "left_semi")
    if unclear.isEmpty():
        return kept
    rows = docs.join(unclear.where(F.col(other).isNotNull()), F.col("doc_id") == F.col(other), "left_semi").union(docs.where("doc_id is null"))
    mine = [free_name(docs.columns, f"own_{n}") for n in names]

    def prints(batches, at=docs.columns.index("text")):
        for batch in batches:
            fps = np.array([fingerprints_of(t, words, lanes) for t in as_bytes(batch.column(at))], np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(lanes))], names=[*batch.schema.names, *mine])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in mine)])
    rows = rows.mapInArrow(prints, schema)
    same = F.col("doc_id").eqNullSafe(F.col(keep))
    for m, x in zip(mine, lanes_of, strict=True):
        same &= F.col(m) == F.col(x)
    rows = rows.join(first, same, "left_semi").dropDuplicates(["doc_id", *mine])
    return kept.unionByName(rows.select(*docs.columns))
