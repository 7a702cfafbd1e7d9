"""Expressions, statistics, readers and streams on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import models as M
from seriesloom.functions import sequence as S
from seriesloom.functions import stats as T
from seriesloom.functions import text as X
from seriesloom.operators import candidates as C
from seriesloom.operators import relational as L
from seriesloom.operators import reports as P
from seriesloom.operators import verify as V
from seriesloom.sources import adapters as A
from seriesloom.sources import readers as D
from seriesloom.streaming import rewards as W


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_sequence_edges(spark):
    empty = F.array().cast("array<double>")
    assert value(spark, S.mean(empty)) is None and value(spark, S.pop_std(empty)) is None
    assert value(spark, S.is_finite(arr(1, math.nan))) is False
    assert value(spark, S.slope(arr(1, 3, 5))) == pytest.approx(2)
    assert value(spark, S.lag1_autocorrelation(arr(2, 2, 2))) is None
    assert value(spark, S.block_means(arr(1, 2, 3, 4, 5))) == [1.5, 3.0, 4.0, 5.0]
    assert value(spark, S.flat_run(arr(0, 0, 5, 5, 5, 9))).asDict() == {"start": 2, "length": 3}
    assert value(spark, S.season(arr(*[0, 1, 2, 1] * 6))) == 4
    assert value(spark, S.seasonal_naive(arr(1, 2, 3), 5, F.lit(2))) == [2.0, 3.0, 2.0, 3.0, 2.0]
    assert value(spark, S.fraction_index(arr(*range(6)), F.lit(0.5))) == 2  # 2.5 goes to the even place
    assert value(spark, S.quantised(arr(0, 5, 10), 10)) == pytest.approx([0.05, 0.45, 0.95])
    assert value(spark, S.decimals_for(arr(0, 0))) == 2 and value(spark, S.decimals_for(arr(150))) == 1
    assert value(spark, S.serialised(arr(1, math.nan))) == "###1.0### ###Nan###"
    assert value(spark, S.fixed(arr(1, 2.5), 1)) == "[1.0, 2.5]"
    assert value(spark, S.shape(arr(*range(20)))) == "rising" and value(spark, S.shape(arr(3, 3, 3))) == "flat"
    assert value(spark, S.value_at(arr(1, 2), F.lit(9))) == 2.0


@pytest.mark.parametrize(
    ("reply", "letter"),
    [("<answer>C</answer> not A", "C"), ("b", None), ("(D).", "D"), ("I think it is B", "B"), ("A guess: C", "A"), ("none", None), ("", None), (None, None)],
)
def test_answer_letter(spark, reply, letter):
    assert value(spark, X.answer_letter(F.lit(reply).cast("string"))) == letter


@pytest.mark.parametrize(
    ("kind", "gold", "said", "score"),
    [
        ("numeric_tolerance", "10", "about 9", 0.9),
        ("numeric_tolerance", "0", "0.1", 0.0),
        ("numeric_tolerance", "0", "0", 1.0),
        ("regex_numeric_extract_tolerance", "from 3 to 20", "maybe 20.5", 1.0),
        ("regex_numeric_extract_tolerance", "20", "no number", 0.0),
        ("ordering_exact", "B,A", "B then A then B and C", 1.0),
        ("tf_exact", "True", "it is false", 0.0),
        ("letter_flexible", " Up ", "going UP", 1.0),
    ],
)
def test_scorers(spark, kind, gold, said, score):
    assert value(spark, X.score(F.lit(kind), F.lit(gold), F.lit(said))) == pytest.approx(score)


def test_unknown_scorer_fails(spark):
    with pytest.raises(Exception, match="no scorer for"):
        value(spark, X.score(F.lit("llm_judge"), F.lit("a"), F.lit("b")))


def test_chunks(spark):
    text = "One 1 2 3. Two 4 5 6. Three 7. No numbers here! 8 9 10 11 12 13 14."
    got = value(spark, X.chunks(F.lit(text)))
    assert "".join(got) == text and got[0] == "One 1 2 3. " and got[1].startswith("Two 4 5 6. Three 7. No")


def test_text_helpers(spark):
    assert value(spark, X.inner_json(F.lit('```json\n{"a": {"b": 1}}\n``` bye'))) == '{"a": {"b": 1}}'
    assert value(spark, X.masked_number_words(F.lit("two of 3 and -4.5"))) == "[NUM] of [NUM] and [NUM]"
    assert value(spark, X.slug(F.lit(" A b/C! "))) == "a-b-c"
    assert value(spark, X.sentence_share(F.lit("Axis is time. It rises."), "(?i)axis")) == pytest.approx(13 / 23)
    assert value(spark, X.judge_grade(F.lit("nothing"))) == 0.0 and value(spark, X.judge_grade(F.lit("99"))) == 2.0
    assert value(spark, X.repeated_gram(F.lit("a b " * 6), 2)) == 6


def test_t_distribution():
    assert T.incomplete_beta(2.5, 0.5, 5 / (5 + 2.015048**2)) == pytest.approx(0.1, abs=1e-5)
    assert T.incomplete_beta(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)


def test_guards(spark):
    items = spark.createDataFrame([(i, i) for i in range(10)], "id int, k int")
    some = spark.createDataFrame([(i, "x") for i in range(9)], "k int, cap string")
    with pytest.raises(Exception, match="lack a partner"):
        L.partners_or_fail(items, some, "k", 0.02).collect()
    assert L.partners_or_fail(items, some, "k", 0.2).count() == 9
    two = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "k int, v string, o int")
    with pytest.raises(Exception, match="more than one value"):
        L.one_value(two, "k", "v", "o").collect()


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "g string, v double, p string")
    assert P.group_spread(rows, "g", "v").first()["groups"] == 0
    assert P.kappa(rows, "g", "p").collect()[0]["n"] is None
    assert P.f1_scores(rows, "g", "p", ["g"]).count() == 0
    assert P.grouping_report(rows, ["g"], {"n": F.count(F.lit(1))}).count() == 0


def test_rotations_and_donors(spark):
    items = spark.createDataFrame([(1, ["x", "y", "z"])], "id int, d array<string>").withColumn("gold", F.lit("G"))
    got = {r["place"]: r["options"] for r in C.rotations(items, "gold", "d", 4).collect()}
    assert got == {0: ["G", "x", "y", "z"], 1: ["x", "G", "y", "z"], 2: ["x", "y", "G", "z"], 3: ["x", "y", "z", "G"]}
    members = spark.createDataFrame([(i, 0) for i in range(3)], "id int, g int")
    cand = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "id int, cand_id int")
    got = {r["id"]: (r["donor"], r["clash"]) for r in C.donors(members, cand, ["g"]).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (0, True)}


def test_distinct_series(spark):
    rows = spark.createDataFrame([(2, [1.0, 2.0]), (1, [1.0, 2.0000000001]), (3, [5.0])], "id int, s array<double>")
    assert sorted(r["id"] for r in C.distinct_series(rows).collect()) == [1, 3]


def test_sole_match(spark):
    shapes = F.array(*(F.struct(F.lit(a).alias("letter"), F.lit(b).alias("shape")) for a, b in (("A", "peak"), ("B", "flat"), ("C", "peak"))))
    assert value(spark, V.sole_match(shapes, F.lit("flat"))) == "B" and value(spark, V.sole_match(shapes, F.lit("peak"))) is None


def test_readers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    for kind in ("jsonl", "csv", "parquet"):
        path = str(tmp_path / f"x.{kind}")
        D.write_local(rows, path, kind)
        assert sorted(r["id"] for r in D.read_local(spark, path, "id long, t string").collect()) == [1, 2]
    with pytest.raises(ValueError, match="no reader"):
        D.read_local(spark, "x.xlsx", "id long")
    assert value(spark, D.literal_array(F.lit("[1, nan, 2.5]"), strict=False))[2] == 2.5
    with pytest.raises(Exception, match="empty series"):
        value(spark, D.literal_array(F.lit(" ")))
    assert D.synthetic_fragments(spark.range(8)).where(S.is_finite(F.col("series"))).count() == 8


def test_manifest(spark):
    import json

    payload = json.dumps({"id": 7, "true": [1.0, 2.0], "distractors": [[3.0], [4.0]], "decimals": 1})
    message = json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "answer", "content": repr([(payload, "")])}])
    got = D.manifest_payloads(spark.createDataFrame([(message,)], "message string")).first()
    assert (got["id"], got["true"], got["distractors"], got["decimals"]) == (7, [1.0, 2.0], [[3.0], [4.0]], 1)


def test_adapters(spark):
    items = spark.createDataFrame([("q1", "u", "recognition", "rises", ["a", "b"], "True", "d")], "item string, uid string, task string, description string, options array<string>, gold string, dataset string")
    series = spark.createDataFrame([("u", [1.0, 2.0])], "uid string, series array<double>")
    got = A.annotated(items, series).first()
    assert got["scoring"] == "tf_exact" and [o["letter"] for o in got["options"]] == ["A", "B"] and got["series"] == [[1.0, 2.0]]
    rows = spark.createDataFrame([(1, "q", [[1.0]], ["trend", "odd"], ["up", "x"])], "id int, question string, series array<array<double>>, ability array<string>, answer array<string>")
    got = A.abilities(rows, {"trend": "letter_flexible"}).collect()
    assert [(r["id"], r["scoring"], r["gold"]) for r in got] == [("1-0", "letter_flexible", "up")]


def test_models(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, prompt string")
    got = M.mapped(rows, "prompt", lambda ts: [t.upper() for t in ts])
    assert sorted(r["reply"] for r in got.collect()) == ["X", "Y"]
    with pytest.raises(Exception, match="a reply for each text"):
        M.mapped(rows, "prompt", lambda ts: []).collect()
    assert sum(value(spark, M.hashed_bag(F.lit("a b a")))) == 3


def test_streams(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 1.0), (2, 1.0)], "id int, reward double").write.parquet(source)
    stream = spark.readStream.schema("id int, reward double").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        W.group_log(stream, log, str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(log).collect()
    assert len(rows) == 1 and (rows[0]["groups"], rows[0]["flat_groups"]) == (2, 1)
    spark.createDataFrame([("A",), ("<answer>B</answer>",), ("?",), ("A",)], "reply string").write.parquet(str(tmp_path / "r"))
    q = W.running_totals(spark.readStream.schema("reply string").parquet(str(tmp_path / "r"))).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["letter"]: r["n"] for r in spark.table("totals").collect()} == {"A": 2, "B": 1, "unparsed": 1}


def test_masking(spark):
    from seriesloom.operators import masking as K

    assert K.apply_mask("from 3 to -4 and 9", [{"num": 3, "flag": 1}, {"num": 4, "flag": 0}]) == ("from <val> to -4 and 9", 1)
    got = value(spark, K.mask_flags(F.lit("3 1\nnoise\n20\n1 to 2 0\r\n* 18-21: 0 *")))
    assert [(x["num"], x["flag"]) for x in got] == [(3.0, 1), (1.0, 0), (2.0, 0), (18.0, 0), (21.0, 0)]
    assert value(spark, K.compact_number(F.lit(2.50))) == "2.5"
    assert value(spark, K.time_anchors(F.lit("2. at time 5 then 40%"))) == [5.0]


def test_retrying():
    from seriesloom.functions import models as M

    waits, tried = [], {}

    def one(t):
        tried[t] = tried.get(t, 0) + 1
        if tried[t] < len(t):
            raise TimeoutError
        return t.upper()

    call = M.retrying(one, wait=waits.append)
    assert call(["a", "bb", "cccc"]) == ["A", "BB", "CCCC"] and waits == [1.0, 2.0, 4.0]
    assert M.retrying(one, lambda ts: ["?"] * len(ts), attempts=2, wait=waits.append)(["x", "yyyyy"]) == ["?", "?"]
    with pytest.raises(RuntimeError, match="1 of 2 calls failed"):
        M.retrying(one, attempts=1, wait=waits.append)(["x", "zzzzz"])


def test_sources_refuse(spark, tmp_path):
    from seriesloom.sources import readers as D

    part = spark.range(2)
    with pytest.raises(ValueError, match="unclear"):
        D.licensed_union({"a": part, "b": part}, {"b"})
    part.write.option("header", True).csv(f"{tmp_path}/x.csv")
    with pytest.raises(ValueError, match="no column OT"):
        D.forecast_series(spark, f"{tmp_path}/x.csv")


def test_bootstrap(spark):
    """The same interval whatever the layout; near the plain resampling one; pairs that differ are refused."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 400)
    rows = spark.createDataFrame([("g", int(i), float(v)) for i, v in enumerate(x)], "arm string, k int, v double")
    got = [T.bootstrap_mean(rows.repartition(n), ["arm"], "v").first() for n in (1, 7)]
    assert got[0] == got[1]
    plain = x[rng.integers(0, 400, (2000, 400))].mean(axis=1)
    assert [got[0]["low"], got[0]["high"]] == pytest.approx(np.percentile(plain, [2.5, 97.5]), abs=0.03)
    other = rows.withColumn("v", F.col("v") - 1)
    assert T.bootstrap_delta(rows, other, ["k"], ["arm"], "v").first()["low"] == 1.0
    with pytest.raises(Exception, match="differ in their keys"):
        T.bootstrap_delta(rows, other.where("k > 0"), ["k"], ["arm"], "v").collect()


def test_charts(spark):
    import zlib

    import numpy as np

    from seriesloom.operators import masking as K

    data = K.png([0.0, 1.0])
    body = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    pixels = np.frombuffer(body, np.uint8).reshape(300, 601)[:, 1:]
    low, high = np.flatnonzero(pixels[:, 0] == 0).min(), np.flatnonzero(pixels[:, -1] == 0).max()
    assert low > high and (pixels == 0).any(axis=0).all()
    for bad in ([], [math.nan]):
        with pytest.raises(ValueError, match="finite"):
            K.png(bad)
    items = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0])], "key int, s array<double>")
    assert K.rendered(items, "key", "s").where("image is not null").count() == 3


def test_sentence_share_bounds(spark):
    """A letter beyond ASCII bounds a word, as in RE2; an underscore or a digit does not."""
    assert value(spark, X.sentence_share(F.lit("voil\u00e0la x. La. sola_ la1."), r"(?i)\b(la)\b")) == pytest.approx(14 / 25)


def test_mock_caption_halves(spark):
    """2.675 is a double below the half, 0.125 the half itself: both go down, as in C."""
    rows = spark.createDataFrame([(1, [2.675, 2.675]), (2, [0.125, 0.375]), (3, [math.nan])], "id int, s array<double>")
    got = [r["c"] for r in rows.orderBy("id").select(M.mock_caption(F.col("s")).alias("c")).collect()]
    assert "mean of 2.67, goes from 2.67 to 2.67" in got[0]
    assert "mean of 0.25, goes from 0.12 to 0.38" in got[1]
    assert "mean of nan" in got[2]


def test_average_ranks_in_slices(spark):
    """Average ranks over several slices of a group, ties and nulls (last) included, with no window over a group's rows."""
    rows = [("a" if i % 3 else "b", float(i * 7 % 23) if i % 10 else None, float(i * 5 % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)

    def rank(values, v):
        key = lambda x: (x is None, x or 0.0)
        return sum(key(x) < key(v) for x in values) + (sum(x == v for x in values) + 1) / 2

    got = T.average_ranks(df, ["g"], "x", "rank").collect()
    own = {g: [x for h, x, _ in rows if h == g] for g in "ab"}
    assert {(r["g"], r["x"]): r["rank"] for r in got} == {(g, x): rank(own[g], x) for g in "ab" for x in set(own[g])}
    for r in T.spearman(df, ["g"], "x", "y").collect():
        xs, ys = own[r["g"]], [y for h, _, y in rows if h == r["g"]]
        u, v = [rank(xs, x) - (len(xs) + 1) / 2 for x in xs], [rank(ys, y) - (len(ys) + 1) / 2 for y in ys]
        rho = sum(a * b for a, b in zip(u, v)) / math.sqrt(sum(a * a for a in u) * sum(b * b for b in v))
        assert r["n"] == len(xs) and r["rho"] == pytest.approx(rho)
    plan = T.spearman(df, ["g"], "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan
