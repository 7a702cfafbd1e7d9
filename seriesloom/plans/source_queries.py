"""Queries over sources and sinks, reports that join several tables, and calls that can fail."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import stats as T
from ..functions import text as X
from ..operators import candidates as C
from ..operators import masking as K
from ..operators import verify as V
from ..operators.neighbours import k_nearest
from ..sources import adapters as A
from ..sources import readers as D
from ..streaming import rewards as W
from .base import SERIES, Registry, case_rows, case_sql, table, user_series
from .report_queries import FACTS, facts
from .text_queries import QUESTION_CASES, QUESTION_COLUMNS

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


@R.add("SELECT o_orderkey AS step, o_totalprice AS value FROM orders")
def forecast_scan(spark, sf):
    """SRC9 SRC2: a table written as CSV and scanned for its target column."""
    path = f"{D.scratch(spark, 'forecast')}.csv"
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").alias("OT"))
    D.write_local(rows, path, "csv")
    return D.forecast_series(spark, path, order="step")


@R.add("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def json_lines(spark, sf):
    """SRC2 SRC6 SRC8 SRC46: rows written as JSON lines with blank lines between, read back without them."""
    path = f"{D.scratch(spark, 'lines')}.jsonl"
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit(""))).alias("value")).write.text(path)
    return D.read_local(spark, path, rows.schema)


@R.add("SELECT CAST(c_custkey // 32 AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def series_files(spark, sf):
    """SRC13 UDF11: a text file per id with one value a line, opened by id; a file holds 32 values."""
    path = D.scratch(spark, "series")
    lines = table(spark, sf, "customer").groupBy(F.expr("c_custkey div 32").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))), lambda x: x["c_acctbal"].cast("string")), "\n").alias("value"))
    lines.repartition("id").write.partitionBy("id").text(path)
    got = D.series_files(spark, path)
    return got.select(F.col("id").cast("long").alias("id"), F.size("series").cast("long").alias("n"), r(F.aggregate("series", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@R.add(f"WITH {SERIES} SELECT id, CAST(len(s) AS BIGINT) AS n, round(list_sum(s), 4) AS total, CAST(2 AS BIGINT) AS distractors FROM series")
def manifest_scan(spark, sf):
    """SRC7: payloads three encodings deep."""
    payload = F.to_json(F.struct("id", F.col("s").alias("true"), F.array("s", F.reverse("s")).alias("distractors"), F.lit(2).alias("decimals")))
    roles = [("system", F.lit("It's a task")), ("user", F.lit("<image>")), ("answer", F.concat(F.lit("[('"), payload, F.lit("', '')]")))]
    message = F.to_json(F.array(*(F.struct(F.lit(n).alias("role"), c.alias("content")) for n, c in roles)))
    got = D.manifest_payloads(user_series(spark, sf).select(message.alias("message")))
    return got.select("id", F.size("true").cast("long").alias("n"), r(F.aggregate("true", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("distractors").cast("long").alias("distractors"))


@R.add("SELECT 'documents' AS source, lang AS kind, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang UNION ALL SELECT 'benchmark', NULL, CAST(count(*) AS BIGINT) FROM benchmark UNION ALL SELECT 'conversations', role, CAST(count(*) AS BIGINT) FROM conversations GROUP BY role")
def licensed_union(spark, sf):
    """SRC18: files in one table with where each row is from; those of an unclear licence need a yes."""
    parts = {"documents": table(spark, sf, "documents").select(F.col("lang").alias("kind"), "text"), "benchmark": table(spark, sf, "benchmark").select("text"), "conversations": table(spark, sf, "conversations").select(F.col("role").alias("kind"), "text")}
    return D.licensed_union(parts, {"conversations"}, accept_unclear=True).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, 'question ' || turn || ' of ' || conv_id || ' ' || repeat('x', 60 - length('question ' || turn || ' of ' || conv_id || ' ')) AS stem FROM t WHERE turn % 3 <> 0 AND before % 3 = 0""")
def timeout_stems(spark, sf):
    """SRC27: the stems of decisions that follow a time-out in a log."""
    t, c = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    decision = F.concat(F.lit("(1/2) [KEEP] kind | question "), t, F.lit(" of "), c, F.lit(" "), F.repeat(F.lit("x"), F.lit(80)))
    line = F.when(F.col("turn") % 3 == 0, "WARN Request timed out, retrying").otherwise(decision)
    return D.timeout_stems(table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


@R.add("""WITH e AS (SELECT user_id, event_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM events)
SELECT user_id, CAST(count(*) FILTER (WHERE so_far IS NULL OR value > so_far) AS BIGINT) AS kept, arg_max(event_id, (ts, event_id)) FILTER (WHERE so_far IS NULL OR value > so_far) AS best FROM e GROUP BY user_id""")
def best_checkpoints(spark, sf):
    """SRC54: a checkpoint is kept where its reward is greater than all before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").withColumn("so_far", F.max("value").over(w)).where("so_far IS NULL OR value > so_far")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.max_by("event_id", F.struct("ts", "event_id")).alias("best"))


@R.add(f"""WITH {SERIES}, f AS (SELECT id, id % 3 AS src, len(s) AS n, list_avg(s) AS m, list_stddev_pop(s) AS d FROM series),
z AS (SELECT id, src, n, (m - avg(m) OVER w) / coalesce(nullif(stddev_pop(m) OVER w, 0), 1) AS a, (d - avg(d) OVER w) / coalesce(nullif(stddev_pop(d) OVER w, 0), 1) AS b FROM f WINDOW w AS (PARTITION BY src, n)),
p AS (SELECT x.id AS id, y.id AS cand_id, round(sqrt((x.a-y.a)**2 + (x.b-y.b)**2), 6) AS dist FROM z x JOIN z y ON x.id <> y.id AND x.src = y.src AND x.n = y.n)
SELECT id, cand_id, CAST(rank AS INTEGER) AS rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cand_id) AS rank FROM p) WHERE rank <= 2""")
def nearest_same_source(spark, sf):
    """JOI7: nearest series of the same source and length."""
    s = F.col("s")
    from ..functions import sequence as S

    items = user_series(spark, sf).select("id", (F.col("id") % 3).alias("src"), F.size(s).alias("n"), F.array(S.mean(s), S.pop_std(s)).alias("f"))
    return k_nearest(C.standardised(items, "f", ["src", "n"], 2), 2, ["src", "n"])


@R.add(r"""WITH d AS (SELECT lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT lang, CAST(count(*) FILTER (WHERE n <= 300) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE n > 300) AS BIGINT) AS skipped, CAST(max(n) AS BIGINT) AS longest, round(avg(CAST(n > 300 AS DOUBLE)), 6) AS share FROM d GROUP BY lang""")
def token_budget_filter(spark, sf):
    """FLT18 UDF14: texts over a budget of tokens are skipped, never cut; how many there are."""
    n = F.size(X.tokens(F.coalesce("text", F.lit(""))))
    d = table(spark, sf, "documents").select("lang", n.alias("n"), (n > 300).alias("over"))
    return d.groupBy("lang").agg(F.count_if(~F.col("over")).alias("kept"), F.count_if("over").alias("skipped"), F.max("n").cast("long").alias("longest"), r(F.avg(F.col("over").cast("double"))).alias("share"))


@R.add(r"""WITH s AS (SELECT item_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS s FROM benchmark) SELECT item_id, round(list_sum(list_transform(list_filter(s, lambda x: regexp_matches(x, '(?i)\b(the|la|der)\b')), lambda x: length(x))) / list_sum(list_transform(s, lambda x: length(x))), 6) AS share FROM s""")
def boilerplate_share(spark, sf):
    """SCL27: the share of a text in sentences that match."""
    share = X.sentence_share(F.col("text"), r"(?i)\b(the|la|der)\b")
    return table(spark, sf, "benchmark").select("item_id", r(F.when(share > 0, share)).alias("share"))


@R.add("SELECT event_id, printf('%g', value * 37) AS text FROM events")
def compact_numbers(spark, sf):
    """SCL30: six significant digits, whole numbers plain."""
    return table(spark, sf, "events").select("event_id", K.compact_number(F.col("value") * 37).alias("text"))


@R.add("WITH p AS (SELECT event_id, (event_id * 7919 % 1000) / 1e5 * (event_id % 4) / 3.0 AS p FROM events) SELECT event_id, CASE WHEN p < 0.0005 / 16 THEN '***' WHEN p < 0.005 / 16 THEN '**' WHEN p < 0.05 / 16 THEN '*' ELSE '' END AS stars FROM p")
def significance_stars(spark, sf):
    """STA9: marks at levels shared out over sixteen tests."""
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", T.stars((i * 7919 % 1000) / 1e5 * (i % 4) / 3.0).alias("stars"))


@R.add("""WITH q AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN NULL ELSE chr(65 + CAST(turn % 4 AS INTEGER)) END AS reply, chr(65 + CAST((conv_id + turn) % 2 * 2 AS INTEGER)) AS gold, row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || ':' || turn), turn) AS rn FROM conversations)
SELECT conv_id AS request, CASE WHEN count(reply) = count(*) THEN round(avg(CAST(reply = gold AS DOUBLE)) * 2, 6) END AS all_asked, CASE WHEN count(reply) FILTER (WHERE rn <= 2) = count(*) FILTER (WHERE rn <= 2) THEN round(avg(CAST(reply = gold AS DOUBLE)) FILTER (WHERE rn <= 2) * 2, 6) END AS two_asked FROM q GROUP BY conv_id""")
def answerability_rewards(spark, sf):
    """STM5 STM6: rewards over all questions of a caption or two drawn by key; none where a call failed."""
    t, c = F.col("turn"), F.col("conv_id")
    rows = table(spark, sf, "conversations").select(c.alias("request"), t.alias("question"), F.when(~((c % 11 == 0) & (t == 1)), F.char(65 + t % 4)).alias("reply"), F.char(65 + (c + t) % 2 * 2).alias("gold"))
    both = W.answerability(rows).withColumnRenamed("reward", "all_asked").join(W.answerability(rows, 2).withColumnRenamed("reward", "two_asked"), "request")
    return both.select("request", r("all_asked").alias("all_asked"), r("two_asked").alias("two_asked"))


@R.add("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) SELECT conv_id, turn FROM t WHERE place >= conv_id % 3""")
def resumed_parts(spark, sf):
    """STM10: what is left of each part after the offset that its progress file names."""
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    progress = c.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 3).alias("done"))
    return W.resumed(c, progress, "conv_id", "turn")


@R.add(r"""WITH t AS (SELECT item_id, list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), lambda x: CAST(('0x' || substr(md5(x), 30, 3)) AS BIGINT) % 16) AS p FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(0, 16), lambda i: len(list_filter(p, lambda x: x = i))), ',') AS bag FROM t""")
def hashed_bags(spark, sf):
    """UDF5: token counts folded into sixteen places."""
    bag = F.transform(M.hashed_bag(F.col("text"), 16), lambda x: x.cast("int").cast("string"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(bag, ",").alias("bag"))


@R.add("SELECT c_custkey AS id, reverse(c_name) AS reply FROM customer")
def retried_replies(spark, sf):
    """UDF2 STM13: replies of a function that fails now and then, tried again with growing waits and then one by one."""

    def flaky():
        tried: dict[str, int] = {}

        def one(text: str) -> str:
            tried[text] = tried.get(text, 0) + 1
            if tried[text] < 1 + sum(map(ord, text)) % 3:
                raise TimeoutError(text)
            return text[::-1]

        return M.retrying(one, attempts=4, wait=lambda seconds: None)

    calls = flaky()
    return M.mapped(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "c_name", calls).select("id", "reply")


@R.add("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY md5('7:' || conv_id || ':' || turn), turn) AS INTEGER) AS place FROM conversations")
def shuffled_turns(spark, sf):
    """STM12: a read order shuffled by key, the same at every run."""
    w = Window.partitionBy("conv_id").orderBy(C.keyed_order(F.lit(7), F.col("conv_id"), F.col("turn")), "turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"))


@R.add("""WITH c AS (SELECT c_custkey AS i, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n, greatest(c_acctbal, 0) / 9973.0 AS lift FROM customer)
SELECT i AS id, ['rise', 'wave', 'step'][CAST(i % 3 + 1 AS BIGINT)] AS label, CASE WHEN place < 0.6 * n THEN 'train' WHEN place < 0.8 * n THEN 'val' ELSE 'test' END AS split,
  round(list_avg(list_transform(range(0, 96), lambda t: CASE i % 3 WHEN 0 THEN t / 95.0 * (1 + lift) WHEN 1 THEN sin(2 * pi() * t * (1 + i % 5) / 96) ELSE CASE WHEN t < 48 THEN 0.0 ELSE 1 + lift END END)), 6) AS mean FROM c""")
def synthetic_items(spark, sf):
    """SRC44: a labelled series for each customer, its height by the balance, with a split by place."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.greatest("c_acctbal", F.lit(0.0)) / 9973).alias("lift"))
    from ..functions import sequence as S

    return D.synthetic_items(c).select("id", "label", "split", r(S.mean(F.col("series"))).alias("mean"))


@R.add("SELECT s_suppkey AS id, CAST([24, 48, 96][CAST(s_suppkey % 3 + 1 AS BIGINT)] AS BIGINT) AS n, 'a ' || ['trend', 'bump', 'sine', 'step'][CAST(s_suppkey % 4 + 1 AS BIGINT)] AS caption, true AS near FROM supplier")
def synthetic_fragments(spark, sf):
    """SRC43: a fragment of one of four kinds around 10 for each supplier."""
    got = D.synthetic_fragments(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))
    return got.select("id", F.size("series").cast("long").alias("n"), "caption", F.forall("series", lambda x: x.between(7.5, 15.5)).alias("near"))


@R.add("""SELECT p_partkey AS id, ['rising', 'falling', 'flat', 'spiky'][CAST(p_partkey % 4 + 1 AS BIGINT)] AS cls, CAST(12 AS BIGINT) AS points, CAST(CASE p_partkey % 4 WHEN 0 THEN 11 WHEN 1 THEN -11 ELSE 0 END AS DOUBLE) AS net, CAST(CASE p_partkey % 4 WHEN 3 THEN 5 WHEN 2 THEN 0 ELSE 11 END AS DOUBLE) AS spread,
  CASE p_partkey % 4 WHEN 0 THEN 'the line rises|values go up' WHEN 1 THEN 'the line falls|values go down' WHEN 2 THEN 'the line is flat|values stay' ELSE 'the line is spiky|values jump' END AS annotations FROM part""")
def synthetic_annotations(spark, sf):
    """SRC45: a series of 12 points of one of four classes for each part, with two annotations."""
    got = D.synthetic_annotations(table(spark, sf, "part").select(F.col("p_partkey").alias("id")))
    s = F.col("series")
    return got.select("id", "cls", F.size(s).cast("long").alias("points"), (F.element_at(s, -1) - s[0]).alias("net"), (F.array_max(s) - F.array_min(s)).alias("spread"), F.array_join("annotations", "|").alias("annotations"))


@R.add("""WITH p AS (SELECT 0 AS pool, item_id AS id, 'letter_exact' AS scoring, 'A' AS gold, CAST(3 AS BIGINT) AS points FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn, 'tf_exact', CASE WHEN turn % 2 = 0 THEN 'T' ELSE 'F' END, CAST(2 AS BIGINT) FROM conversations)
SELECT id, scoring, gold, points FROM (SELECT *, row_number() OVER (ORDER BY pool, id) AS rn FROM p) WHERE rn <= 60""")
def two_pools(spark, sf):
    """SRC31: questions of two pools, the first with its series in the prompt; one limit over both."""
    first = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("Series: [1.5, 2, -3e1]. Which?\nA) up\nB) down").alias("prompt"), F.lit("A").alias("gold"))
    second = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("series"), F.lit("Does it rise?").alias("question"), F.when(F.col("turn") % 2 == 0, "T").otherwise("F").alias("gold"))
    got = A.two_pools(first, second, 60)
    return got.select("id", "scoring", "gold", F.size(F.col("series")[0]).cast("long").alias("points"))


#: Shapes of four options and the one asked for; the letter, where one option alone has it.
SHAPE_CASES = [("rising", "flat", "peak", "mixed", "flat", "B"), ("rising", "rising", "peak", "mixed", "rising", None), ("flat", "peak", "valley", "peak", "valley", "C"), ("flat", "peak", "valley", "mixed", "rising", None), ("flat", "peak", "peak", "volatile", "volatile", "D")]
SHAPE_COLUMNS = "one string, two string, three string, four string, wanted string, letter_of string"


@R.add(f"WITH {case_sql('orders', 'o_orderkey', SHAPE_CASES, SHAPE_COLUMNS)} SELECT id, letter_of AS letter FROM cases")
def sole_matches(spark, sf):
    """WIN15: an answer counts where exactly one option has the shape."""
    shapes = F.array(*(F.struct(F.lit(c).alias("letter"), F.col(n).alias("shape")) for c, n in zip("ABCD", ("one", "two", "three", "four"))))
    return case_rows(spark, sf, "orders", "o_orderkey", SHAPE_CASES, SHAPE_COLUMNS).select("id", V.sole_match(shapes, F.col("wanted")).alias("letter"))


@R.add(f"""WITH {FACTS}, m AS (SELECT arm, CAST(count(*) AS BIGINT) AS n, avg(a) AS acc_a, avg(b) AS acc_b, CAST(count(DISTINCT uid) AS BIGINT) AS series, CAST(count(*) FILTER (WHERE a > b) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE a < b) AS BIGINT) AS losses FROM facts GROUP BY arm)
SELECT arm, n, series, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b, wins, losses, CAST(rank() OVER (ORDER BY round(acc_a, 9) DESC) AS INTEGER) AS rank_a, CAST(rank() OVER (ORDER BY round(acc_b, 9) DESC) AS INTEGER) AS rank_b, round(acc_a - max(acc_a) OVER (), 6) AS behind FROM m""")
def all_models_report(spark, sf):
    """REP1: each arm's summaries side by side, ranked by each metric, with wins and losses and the gap to the best. One row an arm."""
    f = facts(spark, sf)
    m = f.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("series"), F.avg("a").alias("acc_a"), F.avg("b").alias("acc_b"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(F.round(c, 9))))
    return m.select("arm", "n", "series", r("acc_a").alias("acc_a"), r("acc_b").alias("acc_b"), "wins", "losses", rank("acc_a").alias("rank_a"), rank("acc_b").alias("rank_b"), r(F.col("acc_a") - F.max("acc_a").over(Window.partitionBy())).alias("behind"))


@R.add(f"""WITH {FACTS}, l AS (SELECT arm, control, gold, uid, 'recognition' AS metric, a AS x FROM facts UNION ALL SELECT arm, control, gold, uid, 'choice', b FROM facts UNION ALL SELECT arm, control, gold, uid, 'both', a * b FROM facts)
SELECT arm, control, metric, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT uid) AS BIGINT) AS series, round(avg(x), 6) AS overall, round(avg(x) FILTER (WHERE gold = 0), 6) AS gold_a, round(avg(x) FILTER (WHERE gold = 1), 6) AS gold_b, round(avg(x) FILTER (WHERE gold = 2), 6) AS gold_c, round(avg(x) FILTER (WHERE gold = 3), 6) AS gold_d FROM l GROUP BY ALL""")
def three_metric_report(spark, sf):
    """REP2: three metrics by arm and control, overall and by the gold's position."""
    metrics = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("x")) for n, c in (("recognition", F.col("a")), ("choice", F.col("b")), ("both", F.col("a") * F.col("b"))))))
    long = facts(spark, sf).select("arm", "control", "gold", "uid", metrics.alias("m")).select("arm", "control", "gold", "uid", "m.*")
    places = [r(F.avg(F.when(F.col("gold") == i, F.col("x")))).alias(f"gold_{c}") for i, c in enumerate("abcd")]
    return long.groupBy("arm", "control", "metric").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("series"), r(F.avg("x")).alias("overall"), *places)


@R.add(f"""WITH {FACTS}, i AS (SELECT arm, item, avg(a) AS m, avg(b) AS k, count(*) AS n FROM facts GROUP BY arm, item)
SELECT arm, CAST(count(*) AS BIGINT) AS items, round(avg(m), 6) AS mean, round(avg(CAST(m = 1 AS DOUBLE)), 6) AS all_right, round(avg(CAST(m = 0 AS DOUBLE)), 6) AS none_right, CAST(count(*) FILTER (WHERE m > k) AS BIGINT) AS better, CAST(count(*) FILTER (WHERE m < k) AS BIGINT) AS worse FROM i GROUP BY arm""")
def rotated_report(spark, sf):
    """REP4: means over an item's rotations first, then by arm: all right, none right, better and worse than the other reader."""
    i = facts(spark, sf).groupBy("arm", "item").agg(F.avg("a").alias("m"), F.avg("b").alias("k"))
    share = lambda c: r(F.avg(c.cast("double")))
    return i.groupBy("arm").agg(F.count(F.lit(1)).alias("items"), r(F.avg("m")).alias("mean"), share(F.col("m") == 1).alias("all_right"), share(F.col("m") == 0).alias("none_right"), F.count_if(F.col("m") > F.col("k")).alias("better"), F.count_if(F.col("m") < F.col("k")).alias("worse"))


@R.add(f"""WITH {FACTS}, c AS (SELECT uid % 5 AS dataset, control AS task, round(avg(a) FILTER (WHERE arm = 'A'), 6) AS low, round(avg(a) FILTER (WHERE arm = 'N'), 6) AS mid, round(avg(a) FILTER (WHERE arm = 'R'), 6) AS high, CAST(count(*) AS BIGINT) AS n FROM facts GROUP BY 1, 2)
SELECT dataset, task, n, low, mid, high, n >= 100 AS shown, CASE WHEN high - low > 0 THEN round((mid - low) / (high - low), 4) END AS recovery FROM c""")
def dataset_crosstab(spark, sf):
    """REP8: data set by task by arm, with the gate on rows and the recovery between two arms."""
    from ..operators import reports as P

    mean = lambda arm: r(F.avg(F.when(F.col("arm") == arm, F.col("a"))))
    c = facts(spark, sf).groupBy((F.col("uid") % 5).alias("dataset"), F.col("control").alias("task")).agg(F.count(F.lit(1)).alias("n"), mean("A").alias("low"), mean("N").alias("mid"), mean("R").alias("high"))
    return c.select("*", (F.col("n") >= 100).alias("shown"), r(P.recovery(F.col("low"), F.col("mid"), F.col("high")), 4).alias("recovery"))


@R.add(f"""WITH {FACTS}, m AS (SELECT uid % 4 AS dataset, arm, control, round(avg(price), 4) AS mse FROM facts GROUP BY 1, 2, 3), p AS (SELECT t.dataset, t.arm, t.mse AS cut, u.mse AS whole FROM m t JOIN m u ON t.dataset = u.dataset AND t.arm = u.arm AND t.control = 'F' AND u.control = 'O')
SELECT dataset, arm, cut, whole, round(whole - cut, 4) AS change, CAST(rank() OVER (PARTITION BY dataset ORDER BY cut) AS INTEGER) AS rank_cut, CAST(rank() OVER (PARTITION BY dataset ORDER BY whole) AS INTEGER) AS rank_whole FROM p""")
def truncation_report(spark, sf):
    """REP12: truncated against untruncated runs of each data set and arm, with both rankings."""
    m = facts(spark, sf).groupBy((F.col("uid") % 4).alias("dataset"), "arm", "control").agg(r(F.avg("price"), 4).alias("mse"))
    run = lambda control, name: m.where(F.col("control") == control).select("dataset", "arm", F.col("mse").alias(name))
    p = run("F", "cut").join(run("O", "whole"), ["dataset", "arm"])
    rank = lambda c: F.rank().over(Window.partitionBy("dataset").orderBy(c))
    return p.select("dataset", "arm", "cut", "whole", r(F.col("whole") - F.col("cut"), 4).alias("change"), rank("cut").alias("rank_cut"), rank("whole").alias("rank_whole"))


@R.add(f"""WITH {SERIES}, k AS (SELECT id, s, len(s) AS n FROM series) SELECT id, 'points ' || n || '; from ' || printf('%.1f', list_min(s)) || ' to ' || printf('%.1f', list_max(s)) AS truth, CAST(length('The series has ' || n || ' points') AS BIGINT) AS own, CASE WHEN id % 5 > 0 THEN CAST(length('It has ' || n || ' values.') AS BIGINT) END AS other FROM k WHERE id % 7 > 0""")
def caption_comparison(spark, sf):
    """REP16: captions of two arms side by side with a block of facts, for series that the first arm has."""
    s = F.col("s")
    base = user_series(spark, sf)
    own = base.where("id % 7 > 0").select("id", F.concat(F.lit("The series has "), F.size(s).cast("string"), F.lit(" points")).alias("c"))
    other = base.where("id % 5 > 0").select("id", F.concat(F.lit("It has "), F.size(s).cast("string"), F.lit(" values.")).alias("o"))
    bound = lambda f: F.regexp_replace(X.format_series(F.array(f), F.lit(1)), r"[\[\]]", "")
    truth = F.concat(F.lit("points "), F.size(s).cast("string"), F.lit("; from "), bound(F.array_min(s)), F.lit(" to "), bound(F.array_max(s)))
    return base.select("id", truth.alias("truth")).join(own, "id").join(other, "id", "left").select("id", "truth", F.length("c").cast("long").alias("own"), F.length("o").cast("long").alias("other"))


@R.add(f"""WITH {case_sql("orders", "o_orderkey", QUESTION_CASES, QUESTION_COLUMNS)} SELECT family_of AS family, CAST(count(*) FILTER (WHERE id % 2 = 0) AS BIGINT) AS v1, CAST(count(*) FILTER (WHERE id % 2 = 1) AS BIGINT) AS v2, CAST(sum(n_of) AS BIGINT) AS options FROM cases GROUP BY 1""")
def prompt_versions(spark, sf):
    """REP19: families of questions by version of the prompt."""
    q = case_rows(spark, sf, "orders", "o_orderkey", QUESTION_CASES, QUESTION_COLUMNS).withColumn("o", X.options(F.col("q")))
    family = X.question_family(F.transform("o", lambda o: o["text"]))
    return q.groupBy(family.alias("family")).agg(F.count_if(F.col("id") % 2 == 0).alias("v1"), F.count_if(F.col("id") % 2 == 1).alias("v2"), F.sum(F.size("o")).alias("options"))
