"""Queries over fact rows: guards, joins, folds, reports, statistics, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import stats as T
from ..operators import candidates as C
from ..operators import relational as L
from ..operators import reports as P
from .base import Registry, sql_normal_p, sql_t_p, table

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


def big(c, name):
    return c.cast("long").alias(name)


def facts(spark, sf):
    """Graded rows: arm, control, item, outcomes of two graders."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("uid"),
        F.col("l_returnflag").alias("arm"),
        F.col("l_linestatus").alias("control"),
        (F.col("l_quantity").cast("long") % 4).alias("gold"),
        (F.col("l_partkey") % 4).alias("pick"),
        (F.col("l_discount") >= 0.05).cast("double").alias("a"),
        (F.col("l_tax") >= 0.04).cast("double").alias("b"),
        F.col("l_extendedprice").alias("price"),
    )


FACTS = """facts AS (SELECT l_orderkey AS item, l_linenumber AS line, l_suppkey AS uid, l_returnflag AS arm, l_linestatus AS control, CAST(l_quantity AS BIGINT) % 4 AS gold, l_partkey % 4 AS pick,
  CAST(l_discount >= 0.05 AS DOUBLE) AS a, CAST(l_tax >= 0.04 AS DOUBLE) AS b, l_extendedprice AS price FROM lineitem)"""


@R.add("SELECT o_custkey AS id, min_by(o_orderstatus, o_orderkey) AS first_status, array_to_string(list(trim(o_orderpriority) ORDER BY o_orderkey) FILTER (WHERE length(trim(o_orderpriority)) > 0), '|') AS captions FROM orders GROUP BY o_custkey")
def dedupe_first_wins(spark, sf):
    """AGG1 SRC3: first value per id, the listed texts in order."""
    o = table(spark, sf, "orders")
    got = L.fold_by_id(o, "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return got.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("first_status"), F.array_join("o_orderpriority", "|").alias("captions"))


@R.add("SELECT o_custkey AS id, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_values FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def caption_conflict(spark, sf):
    """AGG2 JOI3: keys that carry more than one value."""
    return L.conflicts(table(spark, sf, "orders"), "o_custkey", "o_orderstatus").withColumnRenamed("o_custkey", "id")


@R.add("SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti_resume(spark, sf):
    """JOI4 JOI5 FLT2 SET8: known keys kept, keys already done left out."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    known = o.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    done = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(known, "c_custkey", "left_semi").join(done, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@R.add("SELECT o_orderkey AS id, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def missing_tolerance(spark, sf):
    """FLT6 JOI1: partners for all but a tolerated share, or the query fails."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return L.partners_or_fail(o, c, "k", 0.02).select("id", "segment")


@R.add("SELECT CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE b IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE a IS NULL) AS BIGINT) AS extra FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_totalprice > 200000) ON a = b")
def coverage_mismatch(spark, sf):
    """JOI12 SRC41 SET2 SET3: keys on both sides, missing and extra."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return L.coverage(a, b, "k")


@R.add(f"WITH {FACTS} SELECT uid FROM facts GROUP BY uid HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM facts)")
def in_every_arm(spark, sf):
    """JOI10: items that every arm has."""
    return L.in_every(facts(spark, sf), "uid", "arm")


@R.add(f"""WITH {FACTS}, c AS (SELECT item, max(arm) AS cfg_arm, count(*) AS cfg_n FROM facts GROUP BY item), k AS (SELECT cfg_arm, cfg_n FROM c GROUP BY ALL ORDER BY count(*) DESC, min(item) LIMIT 1)
SELECT item, (c.cfg_arm, c.cfg_n) <> (k.cfg_arm, k.cfg_n) AS deviates FROM c, k""")
def majority_alignment(spark, sf):
    """FLT20: which runs differ from the most common configuration."""
    c = facts(spark, sf).groupBy("item").agg(F.max("arm").alias("cfg_arm"), F.count(F.lit(1)).alias("cfg_n"))
    return L.majority(c, ["cfg_arm", "cfg_n"], "item").select("item", "deviates")


@R.add(f"""WITH {FACTS}, g AS (SELECT arm, control, CAST(gold AS VARCHAR) AS gold, GROUPING(arm) AS ga, GROUPING(control) AS gc, GROUPING(gold) AS gg, count(*) AS n, avg(a) AS accuracy, avg(CAST(pick = gold AS DOUBLE)) AS hit FROM facts GROUP BY GROUPING SETS ((), (arm), (control), (gold)))
SELECT CASE WHEN ga = 0 THEN 'arm' WHEN gc = 0 THEN 'control' WHEN gg = 0 THEN 'gold' ELSE 'overall' END AS dimension, CASE WHEN ga = 0 THEN arm WHEN gc = 0 THEN control WHEN gg = 0 THEN gold ELSE 'all' END AS value, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(hit, 6) AS hit FROM g""")
def report_grouping_sets(spark, sf):
    """AGG3 AGG5 AGG13: one report overall and by each dimension."""
    m = {"n": F.count(F.lit(1)), "accuracy": r(F.avg("a")), "hit": r(F.avg((F.col("pick") == F.col("gold")).cast("double")))}
    return P.grouping_report(facts(spark, sf), ["arm", "control", "gold"], m)


@R.add("SELECT coalesce(nullif(l_returnflag, 'N'), 'unknown') AS task, round(avg(CASE WHEN l_linestatus = 'F' THEN CAST(l_tax = 0 AS DOUBLE) END), 6) AS unparsed_rate FROM lineitem GROUP BY 1")
def unparsed_rate(spark, sf):
    """AGG4: over label-scored rows only; unnamed tasks are unknown."""
    x = table(spark, sf, "lineitem")
    rate = F.avg(F.when(F.col("l_linestatus") == "F", (F.col("l_tax") == 0).cast("double")))
    return x.groupBy(F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("unknown")).alias("task")).agg(r(rate).alias("unparsed_rate"))


@R.add(f"""WITH {FACTS}, i AS (SELECT arm, item, avg(a) AS m FROM facts GROUP BY arm, item)
SELECT arm, CAST(count(*) AS BIGINT) AS items, round(avg(m), 6) AS mean, round(avg(CAST(m >= 0.999 AS DOUBLE)), 6) AS all_right, round(avg(CAST(m <= 0.001 AS DOUBLE)), 6) AS none_right FROM i GROUP BY arm""")
def two_level_all_four(spark, sf):
    """AGG6 AGG12: mean per item first, then shares of items all right and none right."""
    i = facts(spark, sf).groupBy("arm", "item").agg(F.avg("a").alias("m"))
    return i.groupBy("arm").agg(F.count(F.lit(1)).alias("items"), r(F.avg("m")).alias("mean"), r(F.avg((F.col("m") >= 0.999).cast("double"))).alias("all_right"), r(F.avg((F.col("m") <= 0.001).cast("double"))).alias("none_right"))


@R.add(f"""WITH {FACTS}, c AS (SELECT arm, gold, pick, count(*) AS n FROM facts GROUP BY ALL), l AS (SELECT arm, gold AS label, n AS g, 0 AS p, CASE WHEN gold = pick THEN n ELSE 0 END AS h FROM c UNION ALL SELECT arm, pick, 0, n, 0 FROM c),
f AS (SELECT arm, label, sum(g) AS support, coalesce(2.0 * sum(h) / nullif(sum(g) + sum(p), 0), 0) AS f1 FROM l GROUP BY arm, label)
SELECT arm, CAST((SELECT sum(n) FROM c WHERE c.arm = f.arm) AS BIGINT) AS n, round((SELECT sum(n) FILTER (WHERE gold = pick) FROM c WHERE c.arm = f.arm) / (SELECT sum(n) FROM c WHERE c.arm = f.arm), 6) AS accuracy,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY arm""")
def f1_scores(spark, sf):
    """AGG7 AGG8 AGG9: accuracy, weighted and macro F1 per arm."""
    got = P.f1_scores(facts(spark, sf), "gold", "pick", ["arm"])
    return got.select("arm", "n", *(r(c).alias(c) for c in ("accuracy", "weighted_f1", "macro_f1")))


@R.add("""WITH x AS (SELECT quality AS u, toxic AS v FROM labels), t AS (SELECT count(*) AS n, sum(CAST(u = v AS INTEGER)) AS s FROM x), e AS (SELECT sum(a.n * b.n) AS xy FROM (SELECT u AS k, count(*) AS n FROM x GROUP BY u) a JOIN (SELECT v AS k, count(*) AS n FROM x GROUP BY v) b USING (k))
SELECT CAST(n AS BIGINT) AS n, round(s / n, 6) AS agreement, round((s / n - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM t, e""")
def cohen_kappa(spark, sf):
    """AGG32: agreement beyond chance of two label columns."""
    return P.kappa(table(spark, sf, "labels"), "quality", "toxic").select("n", r("agreement").alias("agreement"), r("kappa").alias("kappa"))


@R.add(f"""WITH {FACTS}, g AS (SELECT item, count(a) AS n, avg(a) AS m, stddev_pop(a) AS sd FROM facts GROUP BY item HAVING count(a) > 1)
SELECT CAST(count(*) AS BIGINT) AS groups, CAST(count(*) FILTER (WHERE sd < 1e-9) AS BIGINT) AS flat_groups, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS spread_of_means, round(avg(sd), 6) AS mean_sd, count(*) FILTER (WHERE sd < 1e-9) > 0.5 * count(*) AS alert FROM g""")
def group_zero_variance(spark, sf):
    """AGG15 STM9: groups whose rewards do not vary."""
    got = P.group_spread(facts(spark, sf), "item", "a")
    return got.select("groups", "flat_groups", *(r(c).alias(c) for c in ("mean", "spread_of_means", "mean_sd")), "alert")


@R.add(f"""WITH {FACTS}, v AS (SELECT item, sum(a * CASE control WHEN 'F' THEN 0.7 ELSE 0.3 END) / sum(CASE control WHEN 'F' THEN 0.7 ELSE 0.3 END) AS m FROM facts GROUP BY item)
SELECT item, round(m * 2, 6) AS raw, round(greatest(0, (m - 0.25) / 0.75) * 2, 6) AS chance, round((m - 0.25) * 2, 6) + 0.0 AS centred FROM v""")
def weighted_views(spark, sf):
    """AGG14 STM1 STA14: weighted mean over views and the three reward transforms."""
    w = F.when(F.col("control") == "F", 0.7).otherwise(0.3)
    v = facts(spark, sf).groupBy("item").agg(P.weighted_mean(F.col("a"), w).alias("m"))
    return v.select("item", *((r(P.reward(F.col("m"), 4, mode)) + 0.0).alias(name) for mode, name in (("raw", "raw"), ("chance", "chance"), ("centered", "centred"))))


@R.add(f"""WITH {FACTS} SELECT arm, control, CAST(count(*) AS BIGINT) AS n, round(avg(a), 6) AS accuracy, round(stddev_samp(a) / sqrt(count(*)), 6) AS sem, round((avg(a) - 0.25) / 0.75, 6) AS corrected, round(stddev_pop(a), 6) AS sd FROM facts GROUP BY arm, control""")
def sweep_summary(spark, sf):
    """AGG16 AGG17 STA14: accuracy, its standard error, chance-corrected accuracy."""
    acc = F.avg("a")
    return facts(spark, sf).groupBy("arm", "control").agg(F.count(F.lit(1)).alias("n"), r(acc).alias("accuracy"), r(F.stddev_samp("a") / F.sqrt(F.count(F.lit(1)))).alias("sem"), r(T.chance_corrected(acc, F.lit(4.0))).alias("corrected"), r(F.stddev_pop("a")).alias("sd"))


@R.add("""WITH s AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CAST(any_value(n) AS BIGINT) AS n, max(v) FILTER (WHERE i = least(n - 1, floor(0.1 * n))) AS p10, max(v) FILTER (WHERE i = least(n - 1, floor(0.5 * n))) AS p50, max(v) FILTER (WHERE i = least(n - 1, floor(0.9 * n))) AS p90 FROM s GROUP BY lang""")
def caption_quantiles(spark, sf):
    """AGG18 AGG19 AGG23: quantiles by place in the sorted lengths."""
    return P.ranked_quantiles(table(spark, sf, "documents"), ["lang"], "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@R.add("""WITH o AS (SELECT doc_id, lang, text, lower(array_to_string(string_split(trim(text), ' ')[1:2], ' ')) AS opening FROM documents), c AS (SELECT lang, opening, count(*) AS n, min(doc_id) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, opening, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rn, count(*) OVER (PARTITION BY lang) AS openings, sum(n) OVER (PARTITION BY lang) AS total FROM c)
SELECT lang, opening, CAST(n AS BIGINT) AS n, CAST(openings AS BIGINT) AS openings, round(n / total, 6) AS share FROM t WHERE rn = 1""")
def top_opening(spark, sf):
    """AGG18 AGG20 SRT12: most common opening, first seen on ties."""
    o = table(spark, sf, "documents").select("doc_id", "lang", F.lower(F.array_join(F.slice(F.split(F.trim("text"), " "), 1, 2), " ")).alias("opening"))
    c = o.groupBy("lang", "opening").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("f"))
    sums = c.groupBy("lang").agg(F.count(F.lit(1)).alias("openings"), F.sum("n").alias("total"))
    return L.first_per(c, ["lang"], [F.desc("n"), "f"]).join(sums, "lang").select("lang", "opening", "n", "openings", r(F.col("n") / F.col("total")).alias("share"))


@R.add("SELECT lang, round(1 - count(DISTINCT text) / count(text), 6) AS duplicate_rate, round(quantile_cont(n_chars, 0.5), 6) AS median FROM documents GROUP BY lang")
def duplicate_rate(spark, sf):
    """AGG18 AGG22: exact copies, and the interpolated median."""
    hashed = table(spark, sf, "documents").select("lang", "n_chars", F.md5("text").alias("h"))
    return hashed.groupBy("lang").agg(r(1 - F.count_distinct("h") / F.count("h")).alias("duplicate_rate"), r(F.percentile("n_chars", 0.5)).alias("median"))


@R.add("SELECT event_type, CAST(letters AS VARCHAR) AS k, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, event_id % 4 AS letters FROM events) GROUP BY ALL")
def letter_histogram(spark, sf):
    """AGG21: how often each option is picked."""
    return table(spark, sf, "events").groupBy("event_type", (F.col("event_id") % 4).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH {FACTS}, c AS (SELECT uid, arm, count(*) AS n FROM facts GROUP BY ALL), t AS (SELECT uid, sum(n) AS t FROM c GROUP BY uid) SELECT uid, round(-sum(n / t * log2(n / t)), 6) AS bits FROM c JOIN t USING (uid) GROUP BY uid""")
def pick_entropy(spark, sf):
    """AGG31: entropy of a histogram in bits."""
    c = facts(spark, sf).groupBy("uid", "arm").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return c.groupBy("uid").agg(r(S.entropy_bits(F.collect_list("n"))).alias("bits"))


@R.add(f"""WITH {FACTS} SELECT arm, CASE WHEN price < 20000 THEN 'a' WHEN price < 40000 THEN 'b' WHEN price < 60000 THEN 'c' ELSE 'd' END AS bin, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 100 THEN round(avg(a), 6) END AS rate FROM facts GROUP BY ALL""")
def length_bins(spark, sf):
    """AGG28: rate by bin, blank where the bin is small."""
    p = F.col("price")
    bins = F.when(p < 20000, "a").when(p < 40000, "b").when(p < 60000, "c").otherwise("d")
    return facts(spark, sf).groupBy("arm", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 100, r(F.avg("a"))).alias("rate"))


@R.add(f"""WITH {FACTS} SELECT uid, round(avg(a) FILTER (WHERE arm = 'A'), 6) AS "A", round(avg(a) FILTER (WHERE arm = 'N'), 6) AS "N", round(avg(a) FILTER (WHERE arm = 'R'), 6) AS "R" FROM facts GROUP BY uid""")
def pivot_arms(spark, sf):
    """AGG26 AGG27 REP6: arms as columns."""
    m = facts(spark, sf).groupBy("uid", "arm").agg(r(F.avg("a")).alias("m"))
    return P.long_to_wide(m, ["uid"], "arm", ["A", "N", "R"], "m")


@R.add(f"""WITH {FACTS}, w AS (SELECT uid, avg(a) FILTER (WHERE arm = 'A') AS l0, avg(a) FILTER (WHERE arm = 'N') AS l1, avg(a) FILTER (WHERE arm = 'R') AS l2 FROM facts GROUP BY uid)
SELECT uid, CASE WHEN l2 - l0 > 0 THEN round((l1 - l0) / (l2 - l0), 6) END AS recovery, l2 - l0 >= 0.1 AS admitted, round(l1 - l0, 6) AS lift FROM w""")
def info_recovery(spark, sf):
    """AGG29 AGG30: how much of a spread is recovered, and the lift over the floor."""
    m = facts(spark, sf).groupBy("uid", "arm").agg(F.avg("a").alias("m"))
    w = P.long_to_wide(m, ["uid"], "arm", ["A", "N", "R"], "m")
    return w.select("uid", r(P.recovery(F.col("A"), F.col("N"), F.col("R"))).alias("recovery"), (F.col("R") - F.col("A") >= 0.1).alias("admitted"), r(F.col("N") - F.col("A")).alias("lift"))


@R.add(f"""WITH {FACTS}, m AS (SELECT arm, uid, avg(a) AS m FROM facts GROUP BY ALL), k AS (SELECT arm, uid, rank() OVER (PARTITION BY uid ORDER BY round(m, 9) DESC) AS rk FROM m) SELECT arm, round(avg(rk), 6) AS mean_rank, CAST(count(*) FILTER (WHERE rk = 1) AS BIGINT) AS firsts FROM k GROUP BY arm""")
def rank_arms(spark, sf):
    """AGG36 SRT7: mean rank of an arm over data sets."""
    m = facts(spark, sf).groupBy("arm", "uid").agg(F.round(F.avg("a"), 9).alias("m"))
    k = m.withColumn("rk", F.rank().over(Window.partitionBy("uid").orderBy(F.desc("m"))))
    return k.groupBy("arm").agg(r(F.avg("rk")).alias("mean_rank"), F.count_if(F.col("rk") == 1).alias("firsts"))


@R.add(f"""WITH {FACTS}, m AS (SELECT arm, avg(a) AS acc FROM facts GROUP BY arm), e(arm, want) AS (VALUES ('A', 0.5), ('N', 0.54), ('R', 0.6)) SELECT arm, round(acc, 6) AS accuracy, round(abs(acc - want), 6) AS gap, CASE WHEN abs(acc - want) <= 0.001 THEN 'match' WHEN abs(acc - want) <= 0.05 THEN 'near' ELSE 'mismatch' END AS verdict FROM m JOIN e USING (arm)""")
def reconcile_published(spark, sf):
    """AGG37 AGG38 REP13: measured against published figures."""
    want = spark.createDataFrame([("A", 0.5), ("N", 0.54), ("R", 0.6)], "arm string, want double")
    m = facts(spark, sf).groupBy("arm").agg(F.avg("a").alias("acc")).join(F.broadcast(want), "arm")
    gap = F.abs(F.col("acc") - F.col("want"))
    return m.select("arm", r("acc").alias("accuracy"), r(gap).alias("gap"), F.when(gap <= 0.001, "match").when(gap <= 0.05, "near").otherwise("mismatch").alias("verdict"))


@R.add("""WITH w AS (SELECT n_nationkey AS k, x.p AS p FROM nation, (SELECT DISTINCT c_mktsegment AS p FROM customer) x), d AS (SELECT c_nationkey AS k, c_mktsegment AS p, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 10)
SELECT k AS cell, CASE WHEN count(n) = 5 THEN 'done' WHEN count(n) > 0 THEN 'partial' ELSE 'missing' END AS state FROM w LEFT JOIN d USING (k, p) GROUP BY k""")
def cell_states(spark, sf):
    """AGG39 JOI16 REP7: which cells of a grid are complete. The grid is two small dimensions."""
    c = table(spark, sf, "customer")
    grid = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).join(F.broadcast(c.select(F.col("c_mktsegment").alias("p")).distinct()))  # five segments
    done = c.groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return grid.join(done, ["k", "p"], "left").groupBy(F.col("k").alias("cell")).agg(P.cell_state(F.count("n"), 5).alias("state"))


@R.add(f"""WITH {FACTS}, m AS (SELECT uid, arm, avg(a) AS m FROM facts GROUP BY ALL), p AS (SELECT x.uid, x.m - y.m AS d FROM m x JOIN m y ON x.uid = y.uid AND x.arm = 'A' AND y.arm = 'R')
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(d), 6) AS delta, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high FROM p""")
def paired_interval(spark, sf):
    """JOI11 STA13: paired difference and its interval."""
    m = facts(spark, sf).groupBy("uid", "arm").agg(F.avg("a").alias("m"))
    w = P.long_to_wide(m, ["uid"], "arm", ["A", "R"], "m").where("A is not null and R is not null")
    got = T.paired_test(w, [], "A", "R")
    return got.select("n", *(r(c).alias(c) for c in ("delta", "low", "high")))


_Z = "(delta / nullif(sd / sqrt(n), 0))"
_GAP, _SUM = "abs(only_a - only_b)", "nullif(only_a + only_b, 0)"


@R.add(f"""WITH {FACTS}, d AS (SELECT arm, count(*) AS n, avg(a - b) AS delta, stddev_samp(a - b) AS sd, sum(a) AS xa, sum(b) AS xb, count(*) FILTER (WHERE a > b) AS only_a, count(*) FILTER (WHERE b > a) AS only_b FROM facts GROUP BY arm),
e AS (SELECT *, (xa + xb) / (2.0 * n) AS q FROM d), p AS (SELECT *, {sql_normal_p(_Z)} AS pz FROM e)
SELECT arm, CAST(n AS BIGINT) AS n, round(delta, 6) AS delta, round(coalesce(pz, CASE WHEN delta = 0 THEN 1.0 ELSE 0.0 END), 6) AS p_z, round({sql_t_p(_Z, "(n - 1)")}, 6) AS p_t, round({sql_normal_p("((xa / n - xb / n) / nullif(sqrt(q * (1 - q) * 2 / n), 0))")}, 6) AS p_prop,
  round(least(1.0, {sql_normal_p(f"(greatest({_GAP} - 1, 0) / sqrt({_SUM}))")}), 6) AS p_sign, round({sql_normal_p(f"({_GAP} / sqrt({_SUM}))")}, 6) AS p_mcnemar, round({sql_normal_p(f"(greatest({_GAP} - 1, 0) / sqrt({_SUM}))")}, 6) AS p_corrected,
  CASE WHEN pz < 0.0005 / 16 THEN '***' WHEN pz < 0.005 / 16 THEN '**' WHEN pz < 0.05 / 16 THEN '*' ELSE '' END AS stars FROM p""")
def paired_tests(spark, sf):
    """STA2 STA3 STA4 STA6 STA7 STA8 STA10 REP9 REP10: p values of two graders per arm."""
    f = facts(spark, sf)
    t = T.paired_test(f, ["arm"], "a", "b")
    c = f.groupBy("arm").agg(F.count(F.lit(1)).alias("m"), F.sum("a").alias("xa"), F.sum("b").alias("xb"), F.count_if((F.col("a") > F.col("b"))).alias("only_a"), F.count_if((F.col("b") > F.col("a"))).alias("only_b"))
    w, o = F.col("only_a"), F.col("only_b")
    tests = c.select("arm", r(T.two_proportions(F.col("xa"), F.col("m"), F.col("xb"), F.col("m"))).alias("p_prop"), r(T.sign_test(w, o)).alias("p_sign"), r(T.mcnemar(w, o)).alias("p_mcnemar"), r(T.mcnemar(w, o, True)).alias("p_corrected"))
    return t.join(tests, "arm").select("arm", "n", r("delta").alias("delta"), r("p_z").alias("p_z"), r("p_t").alias("p_t"), "p_prop", "p_sign", "p_mcnemar", "p_corrected", T.stars(F.col("p_z")).alias("stars"))


def _checked(interval, rows, value):
    """An interval held against what its group's mean and deviation lead to expect."""
    known = rows.groupBy("arm").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    width = (F.col("high") - F.col("low")) / (2 * 1.96 * F.col("sd") / F.sqrt("n"))
    held = interval.join(known, "arm").select("arm", "n", r("mean").alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("covers"), width.between(0.85, 1.15).alias("width_fits"))
    return held


@R.add(f"""WITH {FACTS} SELECT arm, CAST(count(*) AS BIGINT) AS n, round(avg(a), 6) AS mean, true AS covers, true AS width_fits FROM facts GROUP BY arm""")
def bootstrap_interval(spark, sf):
    """STA1 REP5: 2,000 resamples of each arm's mean; whether the interval covers the mean and is as wide as a normal one."""
    rows = facts(spark, sf).select("arm", "a")
    return _checked(T.bootstrap_mean(rows, ["arm"], "a"), rows, "a")


@R.add(f"""WITH {FACTS} SELECT arm, CAST(count(*) AS BIGINT) AS n, round(avg(a - b), 6) AS mean, true AS covers, true AS width_fits FROM facts GROUP BY arm""")
def bootstrap_delta(spark, sf):
    """STA2: the interval of the paired difference of two graders."""
    f = facts(spark, sf)
    interval = T.bootstrap_delta(f.select("item", "line", "arm", F.col("a").alias("v")), f.select("item", "line", "arm", F.col("b").alias("v")), ["item", "line"], ["arm"], "v")
    rows = f.select("arm", (F.col("a") - F.col("b")).alias("d"))
    return _checked(interval, rows, "d")


@R.add(f"""WITH {FACTS}, p AS (SELECT arm, uid, (uid * 7919 + ascii(arm)) % 1000 / 10000.0 AS p FROM facts GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY p, uid) AS i, count(*) OVER (PARTITION BY arm) AS m FROM p)
SELECT arm, uid, p, round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY arm ORDER BY i)), 9) AS p_holm FROM k""")
def holm(spark, sf):
    """STA5: step-down adjustment inside each family."""
    p = facts(spark, sf).select("arm", "uid").distinct().withColumn("p", (F.col("uid") * 7919 + F.ascii("arm")) % 1000 / F.lit(10000.0))
    return T.holm(p, "p", ["arm"], ["uid"]).select("arm", "uid", "p", r("p_holm", 9).alias("p_holm"))


@R.add("""WITH c AS (SELECT c_nationkey AS g, c_acctbal AS x, c_custkey AS y, c_custkey AS t FROM customer), k AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY x, t) AS rx, row_number() OVER (PARTITION BY g ORDER BY y, t) AS ry FROM c) SELECT g, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) >= 3 THEN corr(rx, ry) END, 6) AS rho FROM k GROUP BY g""")
def spearman_ordinal(spark, sf):
    """STA11: rank correlation with ordinal ranks."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), F.col("c_custkey").alias("y"), F.col("c_custkey").alias("t"))
    return T.spearman(c, ["g"], "x", "y", "t").select("g", "n", r("rho").alias("rho"))


@R.add("""WITH c AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS y FROM lineitem), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM c) SELECT g, CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY g""")
def spearman_average(spark, sf):
    """STA12: rank correlation with average ranks."""
    c = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return T.spearman(c, ["g"], "x", "y").select("g", "n", r("rho").alias("rho"))


@R.add("SELECT c_custkey AS id, md5('7:' || c_custkey) AS h FROM customer ORDER BY h, id LIMIT 40")
def hash_sample(spark, sf):
    """RNG3 RNG9: a keyed sample that does not hang on the order of rows."""
    return L.hash_sample(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.md5(F.concat_ws(":", F.lit("7"), F.col("c_custkey").cast("string"))).alias("h")), "id", 40, 7)


@R.add("SELECT id, CASE WHEN rn <= 100 THEN 'val' ELSE 'train' END AS split FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('0:' || c_custkey), c_custkey) AS rn FROM customer)")
def hash_split(spark, sf):
    """RNG1: a keyed split with a fixed number of validation rows."""
    return L.hash_split(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", 100)


@R.add("SELECT o_orderkey AS id, o_orderkey % 8 AS shard, CAST(floor(o_orderkey / ceil((SELECT count(*) FROM orders) / 5)) AS BIGINT) AS part FROM orders")
def shards(spark, sf):
    """RNG11: strided shards and contiguous parts."""
    o = table(spark, sf, "orders")
    n = o.agg(F.count(F.lit(1)).alias("n"))
    return o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("id"), L.strided_shard(F.col("o_orderkey"), 8).alias("shard"), L.contiguous_part(F.col("o_orderkey"), F.col("n"), 5).alias("part"))


@R.add("""SELECT conv_id, array_to_string(list(k ORDER BY h), ',') AS options, CAST(list_position(list(k ORDER BY h), 'gold') AS BIGINT) AS place FROM (SELECT conv_id, k, md5('0:' || conv_id || ':' || k) AS h FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('gold'), ('x'), ('y'), ('z')) v(k)) GROUP BY conv_id""")
def keyed_shuffle(spark, sf):
    """RNG2 RNG4 RNG7 RNG8 SCL19: options in an order that the item's key fixes, and the gold one's place."""
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    opts = F.array(*(F.struct(C.keyed_order(F.lit(0), F.col("conv_id"), F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in ("gold", "x", "y", "z")))
    got = c.withColumn("o", F.transform(F.array_sort(opts), lambda x: x["k"]))
    return got.select("conv_id", F.array_join("o", ",").alias("options"), F.array_position("o", "gold").alias("place"))


@R.add("""SELECT item, task, gold FROM (SELECT item_id AS item, 'recognition_pos' AS task, 'True' AS gold FROM benchmark UNION ALL SELECT item_id, 'recognition_neg', 'False' FROM benchmark UNION ALL SELECT item_id, 'differentiation', chr(65 + CAST(item_id % 4 AS INTEGER)) FROM benchmark)""")
def protocol_items(spark, sf):
    """RNG5: a true, a false and a choice item for each annotation."""
    rows = F.array(F.struct(F.lit("recognition_pos").alias("task"), F.lit("True").alias("gold")), F.struct(F.lit("recognition_neg").alias("task"), F.lit("False").alias("gold")), F.struct(F.lit("differentiation").alias("task"), F.char(65 + F.col("item_id") % 4).alias("gold")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.explode(rows).alias("r")).select("item", "r.task", "r.gold")


@R.add("""SELECT arm, arm_place, n FROM (SELECT l_returnflag AS arm, CAST(coalesce(list_position(['R', 'A'], l_returnflag), 99) AS BIGINT) AS arm_place, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)""")
def ordinal_order(spark, sf):
    """SRT8: a given order of names, unknown ones last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(F.lit("R"), F.lit("A")), F.col("l_returnflag")), F.lit(0)), F.lit(99))
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.count(F.lit(1)).alias("n")).withColumn("l_returnflag", F.col("arm")).select("arm", place.cast("long").alias("arm_place"), "n")


@R.add("SELECT o_orderkey AS id, o_orderstatus AS split FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 25")
def limit_per_split(spark, sf):
    """SRT10 FLT1: the first n of each split."""
    return L.first_per(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderkey"], 25).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("split"))


@R.add("SELECT text, min(doc_id) AS first, CAST(count(*) AS BIGINT) AS copies FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text ORDER BY first LIMIT 50")
def distinct_texts(spark, sf):
    """SRT5 SET1 SET5 SET6: the first n distinct texts outside an excluded set."""
    d = table(spark, sf, "documents").join(table(spark, sf, "benchmark").select("text"), "text", "left_anti")
    return d.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).orderBy("first").limit(50)


@R.add(f"""WITH {FACTS}, s AS (SELECT uid, arm, list_sort(list(DISTINCT pick)) AS p FROM facts GROUP BY ALL) SELECT x.uid, x.p = y.p AS same FROM s x JOIN s y ON x.uid = y.uid AND x.arm = 'A' AND y.arm = 'R'""")
def same_sets(spark, sf):
    """SET7: whether two arms drew the same set."""
    s = facts(spark, sf).groupBy("uid", "arm").agg(F.array_sort(F.collect_set("pick")).alias("p"))
    w = P.long_to_wide(s.where("arm in ('A', 'R')"), ["uid"], "arm", ["A", "R"], "p")
    return w.where("A is not null and R is not null").select("uid", (F.col("A") == F.col("R")).alias("same"))


@R.add("""SELECT c.conv_id, c.turn, coalesce(n.text, f.text) AS mismatched FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = (SELECT min(turn) FROM conversations t WHERE t.conv_id = c.conv_id AND t.turn > c.turn) JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = (SELECT min(turn) FROM conversations t WHERE t.conv_id = c.conv_id)""")
def shift_pairing(spark, sf):
    """JOI22: the neighbour's caption as a control, round the end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.lead("text").over(w), F.first("text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("mismatched"))


@R.add(f"""WITH {FACTS}, m AS (SELECT arm, uid, avg(a) AS a, avg(b) AS b FROM facts GROUP BY ALL) SELECT arm, CAST(count(*) FILTER (WHERE a > b) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE a = b) AS BIGINT) AS ties, CAST(count(*) FILTER (WHERE a < b) AS BIGINT) AS losses, round(stddev_samp(a) / avg(a), 6) AS variation, avg(a) - avg(b) > 0.05 AND stddev_pop(a) >= 0.02 AS gate FROM m GROUP BY arm""")
def win_tally(spark, sf):
    """AGG23 AGG25 FLT25 REP11: wins, ties and losses, variation, and the quality gate."""
    m = facts(spark, sf).groupBy("arm", "uid").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.groupBy("arm").agg(F.count_if(a > b).alias("wins"), F.count_if(a == b).alias("ties"), F.count_if(a < b).alias("losses"), r(F.stddev_samp(a) / F.avg(a)).alias("variation"), ((F.avg(a) - F.avg(b) > 0.05) & (F.stddev_pop(a) >= 0.02)).alias("gate"))


@R.add(f"""WITH {FACTS}, m AS (SELECT arm, CAST(line AS BIGINT) AS k, avg(a) AS acc FROM facts GROUP BY ALL) SELECT arm, round((max_by(acc, k) - min_by(acc, k)) / (max(k) - min(k)) * 2, 6) AS slope, round(avg(acc / (1 - least(acc, 0.99))), 6) AS odds FROM m GROUP BY arm""")
def slope_per_k(spark, sf):
    """AGG24 AGG35 REP14: change for two more candidates, from the first and last K."""
    m = facts(spark, sf).groupBy("arm", F.col("line").cast("long").alias("k")).agg(F.avg("a").alias("acc"))
    acc = F.col("acc")
    return m.groupBy("arm").agg(r((F.max_by(acc, "k") - F.min_by(acc, "k")) / (F.max("k") - F.min("k")) * 2).alias("slope"), r(F.avg(acc / (1 - F.least(acc, F.lit(0.99))))).alias("odds"))


@R.add(f"""WITH {FACTS} SELECT arm, control, CASE WHEN price < 30000 THEN 'low' ELSE 'high' END AS confidence, CAST(count(*) AS BIGINT) AS n, round(avg(a), 6) AS accuracy, round(avg(CASE WHEN b = 1 THEN a END), 6) AS parsed_accuracy FROM facts GROUP BY ALL""")
def condition_accuracy(spark, sf):
    """AGG33 AGG34 REP15: accuracy by condition and confidence, over all and over parsed rows."""
    return facts(spark, sf).groupBy("arm", "control", F.when(F.col("price") < 30000, "low").otherwise("high").alias("confidence")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("a")).alias("accuracy"), r(F.avg(F.when(F.col("b") == 1, F.col("a")))).alias("parsed_accuracy"))


@R.add("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE a.k IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE CAST(a.v AS FLOAT) IS DISTINCT FROM CAST(b.v AS FLOAT)) AS BIGINT) AS different FROM a FULL JOIN b USING (k)""")
def verify_copies(spark, sf):
    """SRC20 SRC42: two copies of a data set compared row by row as floats."""
    a = table(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("va"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("vb"))
    j = a.withColumn("in_a", F.lit(1)).join(b, "k", "full_outer")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("in_a").isNull()).alias("missing"), F.count_if(~F.col("va").cast("float").eqNullSafe(F.col("vb").cast("float"))).alias("different"))
