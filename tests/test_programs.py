"""Parts of reports on hand cases: votes, tests, verdicts, rankings, examples; and the SQL tails against closed values."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import programs as G
from seriesloom.plans.base import sql_normal_p, sql_t_p


def test_aligned(spark):
    rows = [("m1", 4, 10), ("m2", 4, 10), ("m3", 4, 9), ("m0", 4, 9), ("m9", 2, 10)]
    got = {r["tag"]: (r["votes"], r["deviant"]) for r in G.aligned(spark.createDataFrame(rows, "tag string, k int, n int"), "tag", ["k", "n"]).collect()}
    assert got == {"m1": (2, True), "m2": (2, True), "m3": (2, False), "m0": (2, False), "m9": (1, True)}  # equal votes: the settings of the first tag
    assert G.aligned(spark.createDataFrame([("a", None, 1)], "tag string, k int, n int"), "tag", ["k", "n"]).count() == 1


def test_sign_tests_and_against(spark):
    rows = [("a", u, x) for u, x in enumerate([1.0, 1.0, 1.0, 0.0, 0.5])] + [("b", u, x) for u, x in enumerate([0.0, 0.0, 0.0, 1.0])] + [("c", 7, 1.0)]
    means = spark.createDataFrame(rows, "tag string, unit long, x double")
    t = {(r["one"], r["other"]): r for r in G.sign_tests(means, "tag", ["unit"], [], "x").collect()}
    assert set(t) == {("a", "b")} and (t["a", "b"]["n"], t["a", "b"]["wins"], t["a", "b"]["losses"]) == (4, 3, 1)
    assert t["a", "b"]["p"] == pytest.approx(math.erfc(0.5 / math.sqrt(2)))
    r = G.against(means, "tag", "a", ["unit"], [], "x").collect()
    assert [(x["rival"], x["n"], x["ours"], x["theirs"], x["delta"]) for x in r] == [("b", 4, 0.75, 0.25, 0.5)]


def test_verdict(spark):
    rows = [(-1.0, 0.01), (1.0, 0.01), (-1.0, 0.2), (0.0, None)]
    df = spark.createDataFrame(rows, "d double, p double")
    both = df.select(G.verdict(F.col("d"), F.col("p"), F.lit("us"), F.lit("them")).alias("low"), G.verdict(F.col("d"), F.col("p"), F.lit("us"), F.lit("them"), lower_wins=False).alias("high")).collect()
    assert [tuple(r) for r in both] == [("us", "them"), ("them", "us"), ("tie", "tie"), ("tie", "tie")]


def test_ranking_cells_and_examples(spark):
    cells = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.1), (2, "a", 3.0)], "d int, arm string, v double")
    assert sorted(map(tuple, G.ranking(cells, ["d"], "arm", "v").collect())) == [(1, "c,a,b"), (2, "a")]
    assert sorted(map(tuple, G.ranking(cells, ["d"], "arm", "v", descending=True).collect())) == [(1, "a,b,c"), (2, "a")]
    seeds = G.seed_cells(spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "d int, v double"), ["d"], "v")
    assert {r["d"]: (r["seeds"], r["mean"], r["sd"]) for r in seeds.collect()} == {1: (2, 3.0, pytest.approx(math.sqrt(2))), 2: (1, 5.0, None)}
    rows = spark.createDataFrame([("x", i, i == 4) for i in range(6)] + [("y", i, False) for i in range(3)], "t string, item int, split boolean")
    assert sorted((r["t"], r["item"], r["place"]) for r in G.worked_examples(rows, ["t"], "split", "item", 2).collect()) == [("x", 4, 1), ("y", 0, 1), ("y", 1, 2)]
    left = G.missing_cells(cells.select("d", "arm"), cells.where("v > 0.2").select("d", "arm"), ["d", "arm"])
    assert [tuple(r) for r in left.collect()] == [(1, "c")]


def test_tails_in_sql():
    for z in (0.0, 0.3, 1.0, 1.96, 3.3, 5.5, 9.0):
        assert duckdb.sql(f"SELECT {sql_normal_p(str(z))}").fetchall()[0][0] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)
    for t, df, p in ((12.706205, 1, 0.05), (4.302653, 2, 0.05), (2.776445, 4, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (1.959964, 1_000_001, 0.05), (3.36493, 5, 0.02)):
        assert duckdb.sql(f"SELECT {sql_t_p(str(t), f'CAST({df} AS BIGINT)')}").fetchall()[0][0] == pytest.approx(p, abs=1e-6)
