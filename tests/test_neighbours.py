"""Neighbours over pivots, donors and random others against plain searches."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import candidates as C
from seriesloom.operators.neighbours import Neighbours, k_nearest
from seriesloom.plans import more_queries as Q
from seriesloom.sources.readers import stored

SF = "/root/testdata/sf0.001"


def plain(rows, k, farthest=False, digits=6):
    """(id, cand_id, rank, dist) over (id, bucket, vector) by comparing all."""
    out = []
    for i, b, v in rows:
        if v is None or any(x is None or x != x for x in v):
            continue
        near = [(round(sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5, digits), j) for j, c, w in rows if c == b and j != i and w is not None and not any(x is None or x != x for x in w)]
        near.sort(key=lambda p: (-p[0] if farthest else p[0], p[1]))
        out += [(i, j, r, d) for r, (d, j) in enumerate(near[: k if isinstance(k, int) else k[i]], 1)]
    return sorted(out)


def made(n, dims, seed, grid=None):
    rnd = random.Random(seed)
    value = lambda: float(rnd.randrange(grid)) if grid else rnd.gauss(0, 1)
    return [(i * 3 + 1, rnd.choice("aab"), [value() for _ in range(dims)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, z array<double>").repartition(5)


@pytest.mark.parametrize("farthest", [False, True])
@pytest.mark.parametrize("dims,grid", [(1, None), (2, None), (4, None), (3, 4)])  # a grid: many equal vectors and ties
def test_equals_plain_search(spark, dims, grid, farthest):
    rows = made(500, dims, dims, grid)
    found = Neighbours(table(spark, rows), 3, ["g"], farthest=farthest, block=8, fan=4)
    assert len(found.levels) > 1
    assert sorted(map(tuple, found.result().collect())) == plain(rows, 3, farthest)


def test_odd_rows(spark):
    """Nulls and NaN take no part; one bucket of copies of one vector, one of a single item, one smaller than k."""
    rows = [(i, "copies", [1.0, 2.0]) for i in range(300)] + [(1000, "one", [0.0, 0.0]), (1001, "two", [0.0, 1.0]), (1002, "two", [0.0, 3.0])]
    rows += [(2000, "two", None), (2001, "two", [float("nan"), 0.0]), (2002, "two", [None, 0.0])]
    got = k_nearest(table(spark, rows), 3, ["g"])
    assert sorted(map(tuple, got.collect())) == plain(rows, 3)
    assert k_nearest(table(spark, rows).limit(0), 3, ["g"]).count() == 0


def test_own_k(spark):
    rows = made(200, 2, 9)
    df = table(spark, rows).withColumn("k", (F.col("id") % 5).cast("int"))
    assert sorted(map(tuple, k_nearest(df, "k", ["g"]).collect())) == plain(rows, {i: i % 5 for i, *_ in rows})


def test_few_pairs_are_compared(spark):
    """In two dimensions the bounds leave a small share of all pairs, and twice the items are not four times the pairs."""
    counts = []
    for n in (4000, 8000):
        items = table(spark, [(i, "all", v) for i, _, v in made(n, 2, 5)])
        counts.append(Neighbours(items, 3, []).compared())
    assert counts[0] < 0.2 * 4000**2 and counts[1] < 2.2 * counts[0]


def test_join_keys_are_nodes(spark):
    """No join over items has a bucket alone as its key."""
    found = Neighbours(table(spark, made(2000, 2, 3)), 3, [], block=16, fan=4)
    plan = found.result()._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("(b0#" not in line or " AND " in line for line in joins)


def test_no_items_are_broadcast(spark):
    """What grows with the items is joined by a shuffle, however small the files."""
    plan = Neighbours(table(spark, made(200, 2, 3)), 3, ["g"]).result()._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Join " in line and any(f"{c}#" in line for c in ("other", "point", "v"))]
    assert len(keyed) >= 4 and all("SortMergeJoin" in line for line in keyed), plan


def test_donors(spark):
    """The next member around the group that is no candidate either way."""
    rnd = random.Random(4)
    members = [(i, i % 3) for i in range(60)] + [(100, 7)]
    bad = {(i, rnd.choice([j for j, g in members if g == i % 3 and j != i])) for i in range(60) for _ in range(3)}
    got = C.donors(spark.createDataFrame(members, "id long, g int"), spark.createDataFrame(sorted(bad), "id long, cand_id long"), ["g"]).collect()
    assert len(got) == 60  # a lone member has no other
    for r in got:
        ring = [j for j, g in members if g == r["id"] % 3]
        at = ring.index(r["id"])
        ahead = ring[at + 1 :] + ring[:at]
        free = [j for j in ahead if (r["id"], j) not in bad and (j, r["id"]) not in bad]
        assert (r["donor"], r["clash"]) == ((free[0], False) if free else (ahead[0], True))


def test_random_others(spark):
    for n in (2, 3, 50):
        ids = [7 * i for i in range(n)]
        got = C.random_others(spark.createDataFrame([(i,) for i in ids], "id long"), 3, "s").collect()
        assert len(got) == n * min(3, n - 1)
        assert all(r["cand_id"] in ids and r["cand_id"] != r["id"] for r in got)
        assert len({(r["id"], r["cand_id"]) for r in got}) == len(got)


def made_series(n, seed, values=6):
    """(id, n, s): series of two lengths with copies, a null and runs in common."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice((5, 9))
        s = list(rnd.choice(out)[2]) if out and rnd.random() < 0.3 else [float(rnd.randrange(values)) for _ in range(size)]
        if i % 17 == 3:
            s[2] = None
        out.append((7 * i % (n + 1), len(s), s))
    return out


def longest_run(s, t):
    best = 0
    for i in range(len(s)):
        for j in range(len(t)):
            k = 0
            while i + k < len(s) and j + k < len(t) and s[i + k] is not None and s[i + k] == t[j + k]:
                k += 1
            best = max(best, k)
    return best


def series_table(spark, rows):
    return spark.createDataFrame(rows, "id long, n int, s array<double>").repartition(3)


def test_overlap_joins_no_single_values(spark):
    """Partners to leave out share a sequence of just the length that counts; a single value that all have in common is none."""
    rows = made_series(60, 3)
    for share in (0.1, 0.4, 0.7):
        want = {(i, j) for i, n, s in rows for j, m, t in rows if i != j and n == m and longest_run(s, t) >= share * n}
        assert {tuple(r) for r in C.overlapping(series_table(spark, rows), ["n"], share).collect()} == want
    apart = [(i, 4, [float(i), 500.0, i + 0.5, 500.0]) for i in range(40)]  # all share a value, none two in a row
    assert C.overlapping(series_table(spark, apart), ["n"], 0.5).count() == 0


def test_no_overlap_is_broadcast(spark):
    """Sequences, banned pairs and series are more than the packed files that they are read from, so a small file is no reason to gather them in the driver."""
    rows = [(i, n, s) for i, n, s in made_series(60, 8) if None not in s]
    series = stored(series_table(spark, rows).withColumn("z", F.slice("s", 1, 1)), "series")  # a few kB
    plans = {"gram": C.overlapping(series, ["n"], 0.3), "s": C.series_classes(series, ["n"], ["z"], 3)[1]}
    banned = series.select("id", (F.col("id") + 1).alias("cand_id"))
    plans["cand_id"] = C.nearest_allowed(series, banned, 3, ["n"])
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        keyed = [line for line in plan.splitlines() if "Join " in line and f"{name}#" in line]
        assert keyed and all("SortMergeJoin" in line for line in keyed), (name, plan)


def test_nearest_without_overlap(spark):
    rows = [(i, n, s) for i, n, s in made_series(60, 8) if None not in s]
    z = {i: [sum(s) / n] for i, n, s in rows}
    items = series_table(spark, rows).withColumn("z", F.array(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")))
    want = []
    for i, n, s in rows:
        near = sorted((round(abs(z[i][0] - z[j][0]), 6), j) for j, m, t in rows if j != i and m == n and longest_run(s, t) < 0.3 * n)
        want += [(i, j, r, d) for r, (d, j) in enumerate(near[:3], 1)]
    assert sorted(map(tuple, C.nearest_without_overlap(items, 3, ["n"], 0.3).collect())) == sorted(want)


def test_shared_runs_between_blocks(spark):
    """Blocks of a few series meet as well as one large block; copies, nulls and runs of all lengths. No join on values is left."""
    rows = made_series(50, 5, values=4)
    want = sorted((i, j, longest_run(s, t)) for i, n, s in rows for j, m, t in rows if i < j and n == m and longest_run(s, t))
    for block in (7, 1024):
        found = C.shared_runs(series_table(spark, rows), ["n"], block=block)
        assert sorted(map(tuple, found.collect())) == want
        assert "Join Inner, ((x#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_pairs_of_nodes(spark):
    """Nodes meet in as many tasks as their pairs need: merged by bytes, all of these would be one task."""
    found = Neighbours(table(spark, made(500, 2, 11)), 3, ["g"], block=8, fan=4)
    pairs = found.node_pairs()[1].count()
    met = found._met(lambda left, right: left.select(["a"]).slice(0, 0), "a long")
    assert pairs > 40 and met.rdd.getNumPartitions() == pairs // 4 + 1


def test_shared_runs_in_shards(spark):
    """Shards of a bucket meet in tasks of their own however few their bytes are, a series goes to each once, and copies and pieces of the result lose no pair."""
    rows = made_series(50, 7, values=4)
    want = sorted((i, j, longest_run(s, t)) for i, n, s in rows for j, m, t in rows if i < j and n == m and longest_run(s, t))
    sizes = Counter(n for _, n, _ in rows)
    found = C.shared_runs(series_table(spark, rows), ["n"], block=3, shard=20)
    assert found.rdd.getNumPartitions() == sum(k * (k + 1) // 2 for k in (-(-n // 20) for n in sizes.values()))
    assert sorted(map(tuple, found.collect())) == want


def test_longest_runs_by_product_and_by_pairs(monkeypatch):
    """Values of many pairs and of few, some columns at a time, with gaps for nulls."""
    rng = random.Random(3)
    for values, columns in ((3, 2), (40, 7), (400, 4096)):
        monkeypatch.setattr(C, "COLUMNS", columns)
        sides = [[[rng.choice([None, *range(values)]) for _ in range(12)] for _ in range(n)] for n in (40, 30)]
        points = [np.array([(i, k, x) for i, s in enumerate(side) for k, x in enumerate(s) if x is not None]).T for side in sides]
        got = C._longest_runs(*map(tuple, points), (40, 30))
        assert got.tolist() == [[longest_run(s, t) for t in sides[1]] for s in sides[0]]


def test_distractor_settings_read_events_once(spark, monkeypatch):
    """All three settings start from one stored table of series, not from the events."""
    read = []
    for owner, name in ((Q, "k_nearest"), (C, "random_others")):
        plain_one = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda items, *more, f=plain_one: (read.append(items.inputFiles()), f(items, *more))[1])
    Q.distractor_settings(spark, SF)
    assert len(read) == 3 and read[0] and read[0] == read[1] == read[2]
    assert not any("events" in f for f in read[0])


def test_most_shared(spark):
    rows = [(i, n, s) for i, n, s in made_series(50, 6, values=9)]
    classes, members = C.series_classes(series_table(spark, rows), ["n"], [], 3)
    shared = lambda s, t: sum(x is not None and x in s for x in t)
    group = {}
    for i, n, s in sorted(rows):
        group.setdefault(tuple(s), i)
    want_over = {(group[tuple(s)], group[tuple(t)]) for _, n, s in rows for _, m, t in rows if n == m and s != t and shared(s, t) > 0.5 * n}
    want = []
    for i, n, s in rows:
        most = sorted(((-shared(s, t), -j) for j, m, t in rows if n == m and s != t and 0 < shared(s, t) <= 0.5 * n))
        want += [(i, -j, r) for r, (_, j) in enumerate(most[:3], 1)]
    for block in (7, 1024):
        over, near = C.most_shared(classes, members, ["n"], 3, 0.5, block=block)
        assert {tuple(r) for r in over.collect()} == want_over
        assert sorted(map(tuple, near.collect())) == sorted(want)


@pytest.mark.parametrize("farthest", [False, True])
def test_larger_nodes_meet(spark, monkeypatch, farthest):
    """Where pairs of nodes would be many, the nodes above them meet; tasks follow the pairs."""
    from seriesloom.operators import neighbours

    monkeypatch.setattr(neighbours, "MANY", 0)
    rows = made(500, 3, 7)
    found = Neighbours(table(spark, rows), 3, ["g"], farthest=farthest, block=8, fan=2)
    assert len(found.levels) > 3 and found.node_pairs()[0] == 2
    assert sorted(map(tuple, found.result().collect())) == plain(rows, 3, farthest)


def test_most_similar_others(spark):
    """Small blocks and one large one find the same; ties go to the smaller id; a row without a label takes no part."""
    from seriesloom.operators.neighbours import most_similar_others

    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 0, 1, None]), [float(rnd.randrange(-3, 4)) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, label int, e array<double>").repartition(3)
    want = []
    for i, own, q in rows:
        if i % 5 == 0 and own is not None:
            near = sorted((-sum(x * y for x, y in zip(q, e)), j) for j, label, e in rows if label is not None and label != own)
            want += [(i, j, r, -d) for r, (d, j) in enumerate(near[:3], 1)]
    for block in (10, 4096):
        assert sorted(map(tuple, most_similar_others(df, df.where("id % 5 = 0"), 3, block=block).collect())) == sorted(want)
