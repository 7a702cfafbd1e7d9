"""Whole reports, a query for each of their tables. Runs are made of ``lineitem``: arms, controls, readers, data sets, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats as T
from ..functions import text as X
from ..operators import programs as G
from .base import Registry, sql_normal_p, sql_t_p, table
from .report_queries import FACTS, facts

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


def scores(spark, sf):
    """(tag, arm, control, dataset, uid, item, line, gold, pick, metric, x): a row per question and metric."""
    metrics = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).alias("x")) for n, c in (("recognition", "a"), ("choice", "b")))))
    f = facts(spark, sf).select("*", F.concat_ws("-", "arm", "control").alias("tag"), (F.col("uid") % 5).alias("dataset"), metrics.alias("m"))
    return f.select("tag", "arm", "control", "dataset", "uid", "item", "line", "gold", "pick", "m.metric", "m.x")


SCORES = f"""{FACTS}, scores AS (SELECT arm || '-' || control AS tag, arm, control, uid % 5 AS dataset, uid, item, line, gold, pick, metric, CASE metric WHEN 'recognition' THEN a ELSE b END AS x FROM facts, (VALUES ('recognition'), ('choice')) v(metric))"""
UNITS = "units AS (SELECT metric, tag, uid, avg(x) AS x FROM scores GROUP BY ALL)"


@R.add(f"""WITH {SCORES}, c AS (SELECT tag, count(DISTINCT line) AS rotations, max(pick) + 1 AS options, CAST(round(count(DISTINCT uid) / 20.0) AS BIGINT) AS series FROM scores GROUP BY tag),
v AS (SELECT *, count(*) OVER (PARTITION BY rotations, options, series) AS votes, min(tag) OVER (PARTITION BY rotations, options, series) AS f FROM c),
m AS (SELECT rotations AS mr, options AS mo, series AS ms FROM v ORDER BY votes DESC, f LIMIT 1)
SELECT tag, CAST(rotations AS BIGINT) AS rotations, CAST(options AS BIGINT) AS options, series, CAST(votes AS BIGINT) AS votes, NOT (rotations = mr AND options = mo AND series = ms) AS deviant FROM v, m""")
def model_alignment(spark, sf):
    """REP1 FLT20: settings of each model's runs, the vote on them, and who differs from most."""
    return G.aligned(_configs(spark, sf), "tag", ["rotations", "options", "series"])


def _configs(spark, sf):
    s = scores(spark, sf)
    return s.groupBy("tag").agg(F.countDistinct("line").alias("rotations"), (F.max("pick") + 1).alias("options"), F.round(F.countDistinct("uid") / 20).cast("long").alias("series"))


@R.add(f"""WITH {SCORES}, m AS (SELECT tag, metric, avg(x) AS x, count(*) AS n FROM scores GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY round(x, 9) DESC) AS rk FROM m)
SELECT tag, CAST(sum(n) AS BIGINT) AS n, round(max(x) FILTER (WHERE metric = 'recognition'), 6) AS recognition, round(max(x) FILTER (WHERE metric = 'choice'), 6) AS choice, CAST(max(rk) FILTER (WHERE metric = 'recognition') AS INTEGER) AS rank_recognition, CAST(max(rk) FILTER (WHERE metric = 'choice') AS INTEGER) AS rank_choice, round(avg(rk), 6) AS mean_rank FROM k GROUP BY tag""")
def model_ranks(spark, sf):
    """REP1 REP3: each model's summaries side by side with its ranks; a few rows."""
    from pyspark.sql import Window

    m = scores(spark, sf).groupBy("tag", "metric").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    k = m.withColumn("rk", F.rank().over(Window.partitionBy("metric").orderBy(F.desc(F.round("x", 9)))))
    of = lambda c, metric: F.max(F.when(F.col("metric") == metric, F.col(c)))
    return k.groupBy("tag").agg(F.sum("n").alias("n"), *(r(of("x", m)).alias(m) for m in ("recognition", "choice")), *(of("rk", m).alias(f"rank_{m}") for m in ("recognition", "choice")), r(F.avg("rk")).alias("mean_rank"))


@R.add(f"""WITH {SCORES} SELECT tag, dataset, metric, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS accuracy, round((avg(x) - 0.25) / 0.75, 6) AS above_chance, count(*) >= 1000 AS shown FROM scores GROUP BY ALL""")
def model_datasets(spark, sf):
    """REP1 REP2: models by data set and metric, with what lies above chance."""
    m = scores(spark, sf).groupBy("tag", "dataset", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))
    return m.select("tag", "dataset", "metric", "n", r("x").alias("accuracy"), r(T.chance_corrected(F.col("x"), F.lit(4))).alias("above_chance"), (F.col("n") >= 1000).alias("shown"))


@R.add(f"""WITH {SCORES}, m AS (SELECT tag, metric, gold, avg(x) AS x, avg(CAST(pick = gold AS DOUBLE)) AS p FROM scores GROUP BY ALL)
SELECT tag, metric, round(max(x) FILTER (WHERE gold = 0), 6) AS gold_a, round(max(x) FILTER (WHERE gold = 1), 6) AS gold_b, round(max(x) FILTER (WHERE gold = 2), 6) AS gold_c, round(max(x) FILTER (WHERE gold = 3), 6) AS gold_d, round(max(x) - min(x), 6) AS spread, round(max(p), 6) AS most_picked FROM m GROUP BY ALL""")
def model_positions(spark, sf):
    """REP1 REP2: control for the place of the gold option: accuracy by place, its spread, and how often the place is picked."""
    m = scores(spark, sf).groupBy("tag", "metric", "gold").agg(F.avg("x").alias("x"), F.avg((F.col("pick") == F.col("gold")).cast("double")).alias("p"))
    places = [r(F.max(F.when(F.col("gold") == i, F.col("x")))).alias(f"gold_{c}") for i, c in enumerate("abcd")]
    return m.groupBy("tag", "metric").agg(*places, r(F.max("x") - F.min("x")).alias("spread"), r(F.max("p")).alias("most_picked"))


_SIGN_P = sql_normal_p("greatest((abs(wins - losses) - 1) / sqrt(nullif(wins + losses, 0)), 0)")


@R.add(f"""WITH {SCORES}, {UNITS}, c AS (SELECT tag, count(DISTINCT line) AS k, max(pick) AS o, CAST(round(count(DISTINCT uid) / 20.0) AS BIGINT) AS s FROM scores GROUP BY tag),
v AS (SELECT *, count(*) OVER (PARTITION BY k, o, s) AS votes, min(tag) OVER (PARTITION BY k, o, s) AS f FROM c), m AS (SELECT k AS mk, o AS mo, s AS ms FROM v ORDER BY votes DESC, f LIMIT 1), kept AS (SELECT tag FROM v, m WHERE k = mk AND o = mo AND s = ms),
t AS (SELECT x.metric, x.tag AS one, y.tag AS other, count(*) AS n, count(*) FILTER (WHERE x.x > y.x) AS wins, count(*) FILTER (WHERE x.x < y.x) AS losses FROM units x JOIN units y ON x.metric = y.metric AND x.uid = y.uid AND x.tag < y.tag WHERE x.tag IN (FROM kept) AND y.tag IN (FROM kept) GROUP BY ALL)
SELECT metric, one, other, CAST(n AS BIGINT) AS n, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, {_SIGN_P}) END, 6) AS p FROM t""")
def model_sign_tests(spark, sf):
    """REP1 REP2 STA6: sign tests between the models that are aligned, over series."""
    kept = G.aligned(_configs(spark, sf), "tag", ["rotations", "options", "series"]).where("NOT deviant").select("tag")
    units = scores(spark, sf).groupBy("metric", "tag", "uid").agg(F.avg("x").alias("x")).join(kept, "tag")
    t = G.sign_tests(units, "tag", ["uid"], ["metric"], "x")
    return t.select("metric", "one", "other", "n", "wins", "losses", r("p").alias("p"))


@R.add(f"""WITH {SCORES}, done AS (SELECT tag, dataset, metric FROM scores WHERE NOT (dataset = 3 AND metric = 'choice') GROUP BY ALL HAVING count(*) >= 1000), t AS (SELECT DISTINCT tag FROM scores)
SELECT tag, CAST(dataset AS BIGINT) AS dataset, metric, 'grade --model ' || tag || ' --data ' || dataset || ' --metric ' || metric AS command FROM t, unnest(range(0, 5)) d(dataset), (VALUES ('recognition'), ('choice')) m(metric) WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.tag = t.tag AND done.dataset = d.dataset AND done.metric = m.metric)""")
def model_gaps(spark, sf):
    """REP1 REP7: cells that no run fills, each with the command that would."""
    s = scores(spark, sf)
    done = s.where(~((F.col("dataset") == 3) & (F.col("metric") == "choice"))).groupBy("tag", "dataset", "metric").count().where("count >= 1000")
    grid = F.explode(F.array(*(F.struct(F.lit(d).cast("long").alias("dataset"), F.lit(m).alias("metric")) for d in range(5) for m in ("recognition", "choice"))))
    wanted = s.select("tag").distinct().select("tag", grid.alias("g")).select("tag", "g.*")
    left = G.missing_cells(wanted, done, ["tag", "dataset", "metric"])
    return left.select("tag", "dataset", "metric", F.format_string("grade --model %s --data %d --metric %s", "tag", "dataset", "metric").alias("command"))


@R.add(f"""WITH {FACTS}, i AS (SELECT arm, item, avg(a) AS x FROM facts GROUP BY ALL), t AS (SELECT p.arm AS one, q.arm AS other, count(*) AS n, count(*) FILTER (WHERE p.x > q.x) AS wins, count(*) FILTER (WHERE p.x < q.x) AS losses FROM i p JOIN i q ON p.item = q.item AND p.arm < q.arm GROUP BY ALL)
SELECT one, other, CAST(n AS BIGINT) AS n, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, {_SIGN_P}) END, 6) AS p FROM t""")
def rotated_sign_tests(spark, sf):
    """REP4: sign tests between arms over items, each item's rotations averaged first."""
    i = facts(spark, sf).groupBy("arm", "item").agg(F.avg("a").alias("x"))
    return G.sign_tests(i, "arm", ["item"], [], "x").select("one", "other", "n", "wins", "losses", r("p").alias("p"))


@R.add(f"""WITH {FACTS}, c AS (SELECT arm, pick, count(*) AS k, avg(CAST(pick = gold AS DOUBLE)) AS hit FROM facts GROUP BY ALL), s AS (SELECT *, k / sum(k) OVER (PARTITION BY arm) AS share FROM c)
SELECT arm, chr(65 + CAST(pick AS INTEGER)) AS letter, CAST(k AS BIGINT) AS picks, round(share, 6) AS share, round(hit, 6) AS right_share, round(-sum(share * log2(share)) OVER (PARTITION BY arm), 6) AS entropy FROM s""")
def rotated_picks(spark, sf):
    """REP4 AGG31: which letters an arm picks, how often rightly, and the entropy of that."""
    c = facts(spark, sf).groupBy("arm", "pick").agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("pick") == F.col("gold")).cast("double")).alias("hit"))
    totals = c.groupBy("arm").agg(F.sum("k").alias("all"), S.entropy_bits(F.collect_list(F.col("k").cast("double"))).alias("entropy"))  # four counts
    return c.join(totals, "arm").select("arm", F.char(65 + F.col("pick")).alias("letter"), F.col("k").alias("picks"), r(F.col("k") / F.col("all")).alias("share"), r("hit").alias("right_share"), r("entropy").alias("entropy"))


@R.add(f"""WITH {SCORES}, m AS (SELECT metric AS reader, arm, control, count(*) AS n, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS se, avg(CAST(pick < 3 AS DOUBLE)) AS parsed FROM scores GROUP BY ALL)
SELECT reader, arm, control, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(mean - 1.96 * se, 6) AS low, round(mean + 1.96 * se, 6) AS high, round(parsed, 6) AS parsed, CAST(rank() OVER (PARTITION BY reader, control ORDER BY round(mean, 9) DESC) AS INTEGER) AS place FROM m""")
def reader_intervals(spark, sf):
    """REP5 REP6: each reader's accuracy on each arm and control with its interval, the rate of parsed replies and the arm's place."""
    from pyspark.sql import Window

    m = scores(spark, sf).groupBy(F.col("metric").alias("reader"), "arm", "control").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.avg((F.col("pick") < 3).cast("double")).alias("parsed"))
    place = F.rank().over(Window.partitionBy("reader", "control").orderBy(F.desc(F.round("mean", 9))))
    return m.select("reader", "arm", "control", "n", r("mean").alias("mean"), r(F.col("mean") - 1.96 * F.col("se")).alias("low"), r(F.col("mean") + 1.96 * F.col("se")).alias("high"), r("parsed").alias("parsed"), place.alias("place"))


@R.add(f"""WITH {SCORES}, c AS (SELECT control, arm, dataset, avg(x) FILTER (WHERE metric = 'recognition') AS p, avg(x) FILTER (WHERE metric = 'choice') AS q FROM scores GROUP BY ALL),
k AS (SELECT control, rank() OVER (PARTITION BY control ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY control, round(p, 9)) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY control ORDER BY round(q, 9)) + (count(*) OVER (PARTITION BY control, round(q, 9)) - 1) / 2.0 AS rq FROM c)
SELECT control, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) >= 3 THEN corr(rp, rq) END, 6) AS rho FROM k GROUP BY control""")
def reader_agreement(spark, sf):
    """REP5: rank correlation of two readers over the cells of arms and data sets."""
    c = scores(spark, sf).groupBy("control", "arm", "dataset").agg(*(F.round(F.avg(F.when(F.col("metric") == m, F.col("x"))), 9).alias(n) for n, m in (("p", "recognition"), ("q", "choice"))))
    return T.spearman(c, ["control"], "p", "q").select("control", "n", r("rho").alias("rho"))


_PAIRS = """d AS (SELECT {by}, count(*) AS n, avg(own) AS ours, avg(their) AS theirs, avg(own - their) AS delta, stddev_samp(own - their) AS sd FROM pairs GROUP BY ALL)"""
_Z = "(delta / nullif(sd / sqrt(n), 0))"
_FLAT = "CASE WHEN delta = 0 THEN 1.0 ELSE 0.0 END"


@R.add(f"""WITH {SCORES}, {UNITS}, pairs AS (SELECT o.metric AS reader, t.tag AS rival, o.uid, o.x AS own, t.x AS their FROM units o JOIN units t ON o.metric = t.metric AND o.uid = t.uid AND o.tag = 'N-O' AND t.tag <> 'N-O'), {_PAIRS.format(by="reader, rival")},
p AS (SELECT *, coalesce({sql_normal_p(_Z)}, {_FLAT}) AS p FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY p, rival) AS i, count(*) OVER (PARTITION BY reader) AS m FROM p)
SELECT reader, rival, CAST(n AS BIGINT) AS n, round(delta, 6) AS delta, round(p, 6) AS p, round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY reader ORDER BY i)), 6) AS p_holm FROM k""")
def control_tests(spark, sf):
    """REP5 STA3 STA5: one arm against its controls and rivals by series, adjusted inside each reader."""
    units = scores(spark, sf).groupBy(F.col("metric").alias("reader"), "tag", "uid").agg(F.avg("x").alias("x"))
    t = T.holm(G.against(units, "tag", "N-O", ["uid"], ["reader"], "x").withColumnRenamed("p_z", "p"), "p", ["reader"], ["rival"])
    return t.select("reader", "rival", "n", r("delta").alias("delta"), r("p").alias("p"), r("p_holm").alias("p_holm"))


@R.add(f"""WITH {SCORES}, u AS (SELECT metric, dataset % 3 AS col, tag, uid, avg(x) AS x FROM scores GROUP BY ALL), pairs AS (SELECT o.metric, o.col, t.tag AS rival, o.uid, o.x AS own, t.x AS their FROM u o JOIN u t ON o.metric = t.metric AND o.col = t.col AND o.uid = t.uid AND o.tag = 'N-O' AND t.tag <> 'N-O'), {_PAIRS.format(by="metric, col, rival")},
p AS (SELECT *, CASE WHEN rival LIKE 'N%' THEN 'same arm' ELSE 'reference' END AS family, coalesce({sql_normal_p(_Z)}, {_FLAT}) AS p FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, metric, col, rival) AS i, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, metric, col, rival, CAST(n AS BIGINT) AS n, round(ours, 6) AS ours, round(theirs, 6) AS theirs, round(p, 6) AS p, round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY family ORDER BY i)), 6) AS p_holm FROM k""")
def criteria_families(spark, sf):
    """REP10 JOI11: six columns against all rivals, paired by series, adjusted inside two families."""
    units = scores(spark, sf).groupBy("metric", (F.col("dataset") % 3).alias("col"), "tag", "uid").agg(F.avg("x").alias("x"))
    t = G.against(units, "tag", "N-O", ["uid"], ["metric", "col"], "x").withColumnRenamed("p_z", "p")
    t = t.withColumn("family", F.when(F.col("rival").startswith("N"), "same arm").otherwise("reference"))
    t = T.holm(t, "p", ["family"], ["metric", "col", "rival"])
    return t.select("family", "metric", "col", "rival", "n", r("ours").alias("ours"), r("theirs").alias("theirs"), r("p").alias("p"), r("p_holm").alias("p_holm"))


_MCNEMAR = "CASE WHEN x + y = 0 THEN 1.0 ELSE {} END"


@R.add(f"""WITH {FACTS}, c AS (SELECT control AS protocol, arm AS strategy, uid % 3 AS task, count(*) AS n, count(*) FILTER (WHERE a > b) AS x, count(*) FILTER (WHERE b > a) AS y FROM facts GROUP BY ALL),
p AS (SELECT *, {_MCNEMAR.format(sql_normal_p("abs(x - y) / sqrt(nullif(x + y, 0))"))} AS p, {_MCNEMAR.format(sql_normal_p("greatest(abs(x - y) - 1, 0) / sqrt(nullif(x + y, 0))"))} AS pc FROM c)
SELECT protocol, strategy, task, CAST(n AS BIGINT) AS n, CAST(x AS BIGINT) AS only_a, CAST(y AS BIGINT) AS only_b, round(p, 6) AS p, round(pc, 6) AS p_corrected, CASE WHEN p < 0.0005 / 16 THEN '***' WHEN p < 0.005 / 16 THEN '**' WHEN p < 0.05 / 16 THEN '*' ELSE '' END AS stars FROM p""")
def mcnemar_tables(spark, sf):
    """REP9 STA7 STA8 STA9: two readers' disagreements by protocol, strategy and task."""
    c = facts(spark, sf).groupBy(F.col("control").alias("protocol"), F.col("arm").alias("strategy"), (F.col("uid") % 3).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("b")).alias("only_a"), F.count_if(F.col("b") > F.col("a")).alias("only_b"))
    x, y = F.col("only_a"), F.col("only_b")
    p = T.mcnemar(x, y)
    return c.select("protocol", "strategy", "task", "n", "only_a", "only_b", r(p).alias("p"), r(T.mcnemar(x, y, True)).alias("p_corrected"), T.stars(p).alias("stars"))


@R.add(f"""WITH {FACTS}, w AS (SELECT *, CASE WHEN price < 20000 THEN 'short' WHEN price < 45000 THEN 'middle' ELSE 'long' END AS length FROM facts), c AS (SELECT length, arm, count(*) AS n, avg(a) AS own, avg(b) AS other FROM w GROUP BY ALL)
SELECT length, arm, CAST(n AS BIGINT) AS n, CASE WHEN n >= 100 THEN round(own, 6) END AS own, CASE WHEN n >= 100 THEN round(own - other, 6) END AS gap, round(avg(own - other) OVER (PARTITION BY arm), 6) AS gap_at_equal_length FROM c""")
def length_control(spark, sf):
    """REP9 AGG28: accuracies in bins of length, and the gap with all bins weighing the same."""
    bins = F.when(F.col("price") < 20000, "short").when(F.col("price") < 45000, "middle").otherwise("long")
    c = facts(spark, sf).groupBy(bins.alias("length"), "arm").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("own"), F.avg("b").alias("other"))
    level = c.groupBy("arm").agg(F.avg(F.col("own") - F.col("other")).alias("level"))
    shown = F.col("n") >= 100
    return c.join(level, "arm").select("length", "arm", "n", F.when(shown, r("own")).alias("own"), F.when(shown, r(F.col("own") - F.col("other"))).alias("gap"), r("level").alias("gap_at_equal_length"))


def runs(spark, sf):
    """(dataset, arm, seed, mse): five seeds of each cell."""
    f = facts(spark, sf).where("line <= 5")
    return f.groupBy((F.col("uid") % 4).alias("dataset"), F.concat_ws("-", "arm", "control").alias("arm"), F.col("line").alias("seed")).agg((F.avg("price") / 1000).alias("mse"))


RUNS = f"""{FACTS}, runs AS (SELECT uid % 4 AS dataset, arm || '-' || control AS arm, line AS seed, avg(price) / 1000 AS mse FROM facts WHERE line <= 5 GROUP BY ALL)"""


@R.add(f"""WITH {RUNS}, c AS (SELECT dataset, arm, count(*) AS seeds, avg(mse) AS mean, stddev_samp(mse) AS sd FROM runs GROUP BY ALL)
SELECT dataset, arm, CAST(seeds AS BIGINT) AS seeds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / mean, 6) AS cv, CAST(rank() OVER (PARTITION BY dataset ORDER BY round(mean, 9)) AS INTEGER) AS place FROM c""")
def seed_cells(spark, sf):
    """REP11 AGG23: each cell's mean, deviation and variation over seeds, and its place."""
    from pyspark.sql import Window

    c = G.seed_cells(runs(spark, sf), ["dataset", "arm"], "mse")
    place = F.rank().over(Window.partitionBy("dataset").orderBy(F.round("mean", 9)))
    return c.select("dataset", "arm", "seeds", r("mean").alias("mean"), r("sd").alias("sd"), r("cv").alias("cv"), place.alias("place"))


def _seed_sql(seeds: int, name: str) -> str:
    p = f"coalesce({sql_t_p(_Z, '(n - 1)')}, {_FLAT})"
    return f"""p{seeds} AS (SELECT o.dataset, t.arm AS rival, o.mse AS own, t.mse AS their FROM runs o JOIN runs t ON o.dataset = t.dataset AND o.seed = t.seed AND o.arm = 'N-O' AND t.arm <> 'N-O' WHERE o.seed <= {seeds}),
d{seeds} AS (SELECT dataset, rival, count(*) AS n, avg(own - their) AS delta, stddev_samp(own - their) AS sd FROM p{seeds} GROUP BY ALL), {name} AS (SELECT dataset, rival, delta, round({p}, 6) AS p, CASE WHEN {p} >= 0.05 THEN 'tie' WHEN delta < 0 THEN 'N-O' ELSE rival END AS verdict FROM d{seeds})"""


@R.add(f"""WITH {RUNS}, {_seed_sql(3, "three")}, {_seed_sql(5, "five")} SELECT dataset, rival, round(five.delta, 6) AS delta, three.p AS p_three, five.p AS p_five, three.verdict AS three, five.verdict AS five, three.verdict <> five.verdict AS changed FROM three JOIN five USING (dataset, rival)""")
def seed_verdicts(spark, sf):
    """REP11 STA10: paired t-tests of one arm against its rivals over three seeds and over five, and verdicts that change."""
    own = runs(spark, sf)
    both = []
    for n, name in ((3, "three"), (5, "five")):
        t = G.against(own.where(F.col("seed") <= n), "arm", "N-O", ["seed"], ["dataset"], "mse")
        both.append(t.select("dataset", "rival", F.col("delta").alias(f"delta_{name}"), r("p_t").alias(f"p_{name}"), G.verdict(F.col("delta"), F.col("p_t"), F.lit("N-O"), F.col("rival")).alias(name)))
    t = both[0].join(both[1], ["dataset", "rival"])
    return t.select("dataset", "rival", r("delta_five").alias("delta"), "p_three", "p_five", "three", "five", (F.col("three") != F.col("five")).alias("changed"))


@R.add(f"""WITH {RUNS}, {_seed_sql(5, "five")} SELECT rival, CAST(count(*) FILTER (WHERE verdict = 'N-O') AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE verdict = 'tie') AS BIGINT) AS ties, CAST(count(*) FILTER (WHERE verdict = rival) AS BIGINT) AS losses, round(max(p), 6) AS worst_p FROM five GROUP BY rival""")
def seed_tallies(spark, sf):
    """REP11 AGG25: wins, ties and losses over data sets, with the least certain test."""
    t = G.against(runs(spark, sf), "arm", "N-O", ["seed"], ["dataset"], "mse")
    v = t.select("rival", "p_t", G.verdict(F.col("delta"), F.col("p_t"), F.lit("N-O"), F.col("rival")).alias("v"))
    return v.groupBy("rival").agg(F.count_if(F.col("v") == "N-O").alias("wins"), F.count_if(F.col("v") == "tie").alias("ties"), F.count_if(F.col("v") == F.col("rival")).alias("losses"), r(F.max("p_t")).alias("worst_p"))


@R.add(f"""WITH {RUNS}, c AS (SELECT dataset, arm, avg(mse) FILTER (WHERE seed <= 2) AS short, avg(mse) FILTER (WHERE seed > 2) AS long, avg(mse) FILTER (WHERE seed = 1) AS got, round(avg(mse) FILTER (WHERE seed = 1) + CASE WHEN dataset = 2 THEN 0.5 ELSE 0 END, 3) AS published FROM runs GROUP BY dataset, arm)
SELECT dataset, string_agg(arm, ',' ORDER BY round(short, 9), arm) AS before, string_agg(arm, ',' ORDER BY round(long, 9), arm) AS after, string_agg(arm, ',' ORDER BY round(short, 9), arm) <> string_agg(arm, ',' ORDER BY round(long, 9), arm) AS changed, CAST(count(*) FILTER (WHERE abs(got - published) < 1e-3) AS BIGINT) AS reproduced, CAST(count(*) FILTER (WHERE abs(got - published) >= 1e-3) AS BIGINT) AS differ FROM c GROUP BY dataset""")
def rerun_verdict(spark, sf):
    """REP13 AGG37: rankings before and after a re-run at another length, and cells that reproduce their published number."""
    part = lambda cond: F.avg(F.when(cond, F.col("mse")))
    c = runs(spark, sf).groupBy("dataset", "arm").agg(F.round(part(F.col("seed") <= 2), 9).alias("short"), F.round(part(F.col("seed") > 2), 9).alias("long"), part(F.col("seed") == 1).alias("got"))
    c = c.withColumn("published", F.round(F.col("got") + F.when(F.col("dataset") == 2, 0.5).otherwise(0.0), 3))
    near = F.abs(F.col("got") - F.col("published")) < 1e-3
    counts = c.groupBy("dataset").agg(F.count_if(near).alias("reproduced"), F.count_if(~near).alias("differ"))
    before, after = (G.ranking(c, ["dataset"], "arm", x).withColumnRenamed("ranking", n) for x, n in (("short", "before"), ("long", "after")))
    return before.join(after, "dataset").join(counts, "dataset").select("dataset", "before", "after", (F.col("before") != F.col("after")).alias("changed"), "reproduced", "differ")


@R.add(f"""WITH {FACTS}, c AS (SELECT uid % 3 AS domain, line AS k, count(*) AS n, avg(a) AS x FROM facts GROUP BY ALL), u AS (SELECT uid % 3 AS domain, uid, avg(a) FILTER (WHERE line = 1) AS f, avg(a) FILTER (WHERE line = 7) AS l FROM facts GROUP BY ALL),
d AS (SELECT domain, count(*) AS m, avg(l - f) AS delta, stddev_samp(l - f) AS sd FROM u WHERE f IS NOT NULL AND l IS NOT NULL GROUP BY domain)
SELECT domain, k, CAST(n AS BIGINT) AS n, round(x, 6) AS accuracy, CASE WHEN k > 1 THEN round((x - 1.0 / k) / (1 - 1.0 / k), 6) END AS above_chance, round(delta, 6) AS last_minus_first, round(delta - 1.96 * sd / sqrt(m), 6) AS low, round(delta + 1.96 * sd / sqrt(m), 6) AS high, round(delta / 3, 6) AS slope_per_two FROM c JOIN d USING (domain)""")
def difficulty_by_k(spark, sf):
    """REP14 STA13 AGG35: accuracy by the number of candidates in each domain, and the paired change from the fewest to the most."""
    f = facts(spark, sf).withColumn("domain", F.col("uid") % 3)
    c = f.groupBy("domain", F.col("line").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("x"))
    u = f.groupBy("domain", "uid").agg(F.avg(F.when(F.col("line") == 1, F.col("a"))).alias("f"), F.avg(F.when(F.col("line") == 7, F.col("a"))).alias("l")).where("f IS NOT NULL AND l IS NOT NULL")
    d = T.paired_test(u, ["domain"], "l", "f")
    above = F.when(F.col("k") > 1, r((F.col("x") - 1 / F.col("k")) / (1 - 1 / F.col("k"))))
    return c.join(d.drop("n"), "domain").select("domain", "k", "n", r("x").alias("accuracy"), above.alias("above_chance"), r("delta").alias("last_minus_first"), r("low").alias("low"), r("high").alias("high"), r(F.col("delta") / 3).alias("slope_per_two"))


@R.add("""SELECT item_id AS id, '### ' || item_id || chr(10) || substr(coalesce(text, ''), 1, 80) || chr(10) || string_agg('- ' || chr(65 + CAST(k AS INTEGER)) || ') option ' || ((k + item_id) % 4), chr(10) ORDER BY k) AS question, chr(65 + CAST((4 - item_id % 4) % 4 AS INTEGER)) AS answer FROM benchmark, unnest(range(0, 4)) t(k) GROUP BY item_id, text""")
def pilot_questions(spark, sf):
    """REP15 UDF11: questions exported as text with options in the item's order, and the key to them."""
    b = table(spark, sf, "benchmark")
    k = F.col("item_id")
    options = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.concat(F.lit("- "), F.char(65 + i), F.lit(") option "), ((i + k) % 4).cast("string"))), "\n")
    text = F.concat(F.lit("### "), k.cast("string"), F.lit("\n"), F.substr(F.coalesce("text", F.lit("")), F.lit(1), F.lit(80)), F.lit("\n"), options)
    return b.select(k.alias("id"), text.alias("question"), F.char(65 + (4 - k % 4) % 4).alias("answer"))


@R.add(f"""WITH {FACTS}, c AS (SELECT control AS condition, CASE WHEN price < 20000 THEN 'low' WHEN price < 60000 THEN 'middle' ELSE 'high' END AS confidence, CASE WHEN pick = gold THEN 'right' WHEN pick = (gold + 1) % 4 THEN 'next' WHEN pick = (gold + 2) % 4 THEN 'opposite' ELSE 'before' END AS kind, count(*) AS n FROM facts GROUP BY ALL)
SELECT condition, confidence, kind, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY condition, confidence), 6) AS share FROM c""")
def pilot_picks(spark, sf):
    """REP15 AGG34: kinds of picks by condition and confidence."""
    confidence = F.when(F.col("price") < 20000, "low").when(F.col("price") < 60000, "middle").otherwise("high")
    step = F.pmod(F.col("pick") - F.col("gold"), F.lit(4))
    kind = F.element_at(F.array(*map(F.lit, ("right", "next", "opposite", "before"))), (step + 1).cast("int"))
    c = facts(spark, sf).groupBy(F.col("control").alias("condition"), confidence.alias("confidence"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("condition", "confidence").agg(F.sum("n").alias("all"))
    return c.join(total, ["condition", "confidence"]).select("condition", "confidence", "kind", "n", r(F.col("n") / F.col("all")).alias("share"))


@R.add(r"""WITH d AS (SELECT source, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT source, doc_id, length(t) AS chars, list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '') AS w, regexp_matches(t, '[0-9]') AS digits FROM d),
g AS (SELECT doc_id, w[i:i + 9] AS g, count(*) AS n FROM w, unnest(range(1, len(w) - 8)) x(i) GROUP BY ALL), m AS (SELECT doc_id, max(n) AS most FROM g GROUP BY doc_id)
SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(chars), 3) AS chars, round(avg(len(w)), 3) AS words, round(avg(CAST(digits AS DOUBLE)), 6) AS with_digits, round(avg(CAST(coalesce(most, 0) >= 2 AS DOUBLE)), 6) AS degenerate, arg_max(doc_id, (coalesce(most, 0), -doc_id)) AS worst FROM w LEFT JOIN m USING (doc_id) GROUP BY source""")
def caption_case_study(spark, sf):
    """REP17: measures of a corpus by source, the share of degenerate texts (ten words come again), and the worst one."""
    t = F.coalesce("text", F.lit(""))
    m = table(spark, sf, "documents").select("source", "doc_id", F.length(t).alias("chars"), F.size(X.tokens(t)).alias("words"), t.rlike("[0-9]").cast("double").alias("digits"), X.repeated_gram(t).alias("most"))
    return m.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r(F.avg("chars"), 3).alias("chars"), r(F.avg("words"), 3).alias("words"), r(F.avg("digits")).alias("with_digits"), r(F.avg((F.col("most") >= 2).cast("double"))).alias("degenerate"), F.max_by("doc_id", F.struct("most", -F.col("doc_id"))).alias("worst"))


@R.add(f"""WITH {FACTS}, i AS (SELECT uid % 5 AS dataset, control AS task, item, max(a) <> min(a) AS split FROM facts GROUP BY ALL), s AS (SELECT *, bool_or(split) OVER (PARTITION BY dataset, task) AS some_split FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, task ORDER BY item) AS place FROM s WHERE split OR NOT some_split) SELECT dataset, task, item, split, CAST(place AS INTEGER) AS place FROM k WHERE place <= 2""")
def worked_examples(spark, sf):
    """REP18: the first items of each data set and task on which arms disagree, or any where they never do."""
    i = facts(spark, sf).groupBy((F.col("uid") % 5).alias("dataset"), F.col("control").alias("task"), "item").agg((F.max("a") != F.min("a")).alias("split"))
    return G.worked_examples(i, ["dataset", "task"], "split", "item", 2).select("dataset", "task", "item", "split", "place")
