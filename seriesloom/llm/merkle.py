"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, and a proof for each leaf.

H is the lowercase hex SHA-256 of its inputs, concatenated, digests as hex text.
Leaves of a tree ascend by doc_id; every ``arity`` consecutive nodes become their
H, the last run with what is left, even one, until a single node remains.

Trees are built in tiers of ``tier`` levels: nodes that share an ancestor ``tier``
levels up are one small group, and its levels become rows of the node table.
Proofs are looked up by coordinates: each node explodes the (level, place) of
the siblings it needs from its own place and the count of its tree, joins the
node table, and orders what it gets.  That is done within a tier, so a node is
asked for by ``arity**tier`` others at most, and the nodes under the roots by
no more; a tier's paths then extend those of the tier above.

Null doc_ids come first; rows of equal doc_id follow the order of their leaves.
Null fields have the mark ``-``.  A null group comes before all others and is
apart from the empty string.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, TIER = 2, 6


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def placed(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with their place in their tree and its count ``n``; and the written table behind it.

    Rows are range-partitioned by tree and order, so a large tree lies over many
    partitions; each partition's rows of a tree are counted, and the counts of
    the partitions before give the places.
    """
    number = F.monotonically_increasing_id()
    sorted_rows = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("number", number)
    rows = materialise(sorted_rows.withColumns({"slice": F.shiftright("number", 33), "number": F.col("number").bitwiseAND((1 << 33) - 1)}), "merkle-rows")
    counts = rows.groupBy("tree", "slice").agg(F.count("*").alias("own"), F.min("number").alias("least"))
    tree = Window.partitionBy("tree")  # a row for each slice of the tree
    before = F.coalesce(F.sum("own").over(tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "slice", (before - F.col("least")).alias("shift"), F.sum("own").over(tree).alias("n"))
    out = rows.join(counts, ["tree", "slice"]).withColumn("place", F.col("number") + F.col("shift"))
    return out.drop("slice", "number", "shift"), rows


def levels_of(n: Column, arity: int) -> Column:
    """Levels above a level of ``n`` nodes."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= arity
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda x: x < n))


def power(arity: int, level: Column) -> Column:
    return F.pow(F.lit(arity), level).cast("long")


def whole(x: Column, size: Column) -> Column:
    """``x`` divided by ``size``, rounded down, in integers."""
    return F.call_function("div", x, size)


def up(n: Column, size: Column) -> Column:
    """``n`` divided by ``size``, rounded up."""
    return whole(n + size - 1, size)


def tier_nodes(items: DataFrame, arity: int, tier: int) -> DataFrame:
    """(tree, level, place, n, node): levels 0 to ``tier`` over ``items`` (tree, place, n, node); fewer where the tree ends. ``n`` is the count of the items' level."""
    width = arity**tier
    block = whole(F.col("place"), F.lit(width))
    groups = items.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "node"))).alias("own"))
    ups = F.slice(F.sequence(F.lit(1), F.lit(tier)), F.lit(1), F.least(F.lit(tier), levels_of(F.col("n"), arity)))

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * arity + 1, arity), "").cast("binary"), 256))

    start = F.array(F.transform("own", lambda x: x["node"]))
    levels = F.aggregate(ups, start, lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))
    by_level = groups.select("tree", "block", "n", F.posexplode(levels).alias("level", "nodes"))
    by_level = by_level.select("tree", "block", "n", "level", F.posexplode("nodes").alias("i", "node"))
    return by_level.select("tree", "level", (F.col("block") * whole(F.lit(width), power(arity, F.col("level"))) + F.col("i")).alias("place"), "n", "node")


def sibling_paths(items: DataFrame, nodes: DataFrame, arity: int, tier: int) -> DataFrame:
    """(tree, place, path): for each level of the tier what stands left and right of the item's ancestor in its run, by coordinates looked up in ``nodes``."""
    steps = F.least(F.lit(tier), levels_of(F.col("n"), arity))
    asked = items.select("tree", "place", "n", F.explode(F.slice(F.sequence(F.lit(0), F.lit(tier - 1)), F.lit(1), steps)).alias("level"))
    size = power(arity, F.col("level"))
    asked = asked.select("tree", "place", "level", whole(F.col("place"), size).alias("own"), up(F.col("n"), size).alias("wide"))
    run = F.col("own") - F.pmod(F.col("own"), F.lit(arity))
    asked = asked.select("tree", "place", "level", "own", "wide", F.explode(F.sequence(run, F.least(run + arity - 1, F.col("wide") - 1))).alias("sibling")).where("sibling <> own")
    found = asked.join(nodes.select("tree", "level", F.col("place").alias("sibling"), "node"), ["tree", "level", "sibling"])
    got = found.groupBy("tree", "place").agg(F.sort_array(F.collect_list(F.struct("level", "sibling", "own", "node"))).alias("got"))

    def side(level: Column, left: bool) -> Column:
        mine = F.filter("got", lambda x: (x["level"] == level) & ((x["sibling"] < x["own"]) if left else (x["sibling"] > x["own"])))
        return F.coalesce(F.array_join(F.transform(mine, lambda x: x["node"]), ""), F.lit(""))

    kept = items.select("tree", "place", "n").join(got, ["tree", "place"], "left")
    path = F.transform(F.slice(F.sequence(F.lit(0), F.lit(tier - 1)), F.lit(1), steps), lambda i: F.struct(side(i, True).alias("left"), side(i, False).alias("right")))
    return kept.select("tree", "place", path.alias("path"))


class Tree:
    """Trees over ``items`` (tree, place, n, node), tier by tier."""

    def __init__(self, items: DataFrame, arity: int = ARITY, tier: int = TIER):
        self.arity, self.tier, self.written = arity, tier, []
        most = items.agg(F.max("n")).first()[0] or 1
        self.items, self.nodes = [items.select("tree", "place", "n", "node")], []
        while most > 1:
            nodes = materialise(tier_nodes(self.items[-1], arity, tier), "merkle-nodes")
            self.written.append(nodes)
            self.nodes.append(nodes)
            top = F.col("level") == F.least(F.lit(tier), levels_of(F.col("n"), arity))
            self.items.append(nodes.where(top).select("tree", "place", up(F.col("n"), F.lit(arity**tier)).alias("n"), "node"))
            most = -(-most // arity**tier)

    def tops(self) -> DataFrame:
        """(tree, node): a row for each tree."""
        return self.items[-1].select("tree", "node")

    def paths(self, tops: DataFrame) -> DataFrame:
        """(tree, place, path, what else ``tops`` has): each leaf's path, continued by its tree's in ``tops`` (tree, path, ...)."""
        above = tops.withColumn("place", F.lit(0).cast("long"))
        extra = [c for c in tops.columns if c not in ("tree", "path")]
        for items, nodes in zip(reversed(self.items[:-1]), reversed(self.nodes), strict=True):
            own = sibling_paths(items, nodes, self.arity, self.tier).withColumn("block", whole(F.col("place"), F.lit(self.arity**self.tier)))
            higher = above.withColumnsRenamed({"place": "block", "path": "rest"})
            above = own.join(higher, ["tree", "block"]).select("tree", "place", F.concat("path", "rest").alias("path"), *extra)
        return above


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, altered: dict[str, Column] | None = None, arity: int = ARITY, tier: int = TIER) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, path, folded_root, verified) of each row of ``docs``.

    The manifest is that of the rows as they are.  Where ``tampered`` holds, the root is folded from the leaf that
    the row has with the ``altered`` fields, as one who checks a changed row against the manifest would.
    """
    values = {c: F.col(c) for c in FIELDS}
    changed = leaf_hash([{**values, **(altered or {})}[c] for c in FIELDS])
    other = F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")
    # null before the empty string, else in the order of bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = materialise(docs.select("doc_id", tree.alias("tree"), leaf_hash(list(values.values())).alias("node"), other.alias("changed")), "merkle-leaves")
    rows, rows_written = placed(leaves, ["doc_id", "node"])
    rows = materialise(rows, "merkle-places")
    trees = Tree(rows, arity, tier)
    subroots, subroots_written = placed(trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    subroots = materialise(subroots, "merkle-subroots")
    crown = Tree(subroots, arity, tier)
    ends = crown.tops().select("tree", F.expr("CAST(array() AS array<struct<left: string, right: string>>)").alias("path"), F.col("node").alias("root"))
    of_trees = subroots.join(crown.paths(ends), ["tree", "place"]).select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    full = rows.join(trees.paths(of_trees), ["tree", "place"])
    folded = fold(F.coalesce("changed", "node"), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    out = full.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), "path", folded.alias("folded_root"))
    out = materialise(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-manifest")
    for table in (leaves, rows_written, rows, subroots_written, subroots, *trees.written, *crown.written):
        discard(table)
    return out
