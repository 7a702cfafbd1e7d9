"""Queries for guards, distractor settings, masking and fan-out joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import text as X
from ..operators import candidates as C
from ..operators import masking as K
from ..operators import relational as L
from ..operators.neighbours import k_nearest
from ..sources.readers import stored
from .base import POINTS_SQL, SERIES, Registry, case_rows, case_sql, table, user_series

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


@R.add(f"""WITH {SERIES} SELECT id, CASE WHEN len(s) < 40 THEN 'short' WHEN len(list_distinct(s)) < 2 THEN 'degenerate' WHEN list_max(s) > 400 THEN 'too large' ELSE 'kept' END AS state FROM series""")
def length_and_validity(spark, sf):
    """FLT1 FLT3 FLT9: length bounds and degenerate series, with the reason."""
    s = F.col("s")
    return user_series(spark, sf).select("id", F.when(F.size(s) < 40, "short").when(F.size(F.array_distinct(s)) < 2, "degenerate").when(F.array_max(s) > 400, "too large").otherwise("kept").alias("state"))


@R.add("SELECT event_type, CAST(count(*) FILTER (WHERE event_type IN ('click', 'view')) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS BIGINT) AS skipped FROM events GROUP BY event_type")
def allow_list(spark, sf):
    """FLT5 FLT8: rows by an allow-list, skipped ones counted."""
    ok = F.col("event_type").isin("click", "view")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


@R.add("WITH q AS (SELECT conv_id, turn, chr(65 + CAST((conv_id + turn) % 30 AS INTEGER)) AS answer FROM conversations), v AS (SELECT conv_id, count(*) AS asked, count(*) FILTER (WHERE regexp_matches(answer, '^[A-Za-z]$')) AS good FROM q GROUP BY conv_id) SELECT conv_id, CAST(good AS BIGINT) AS good, CAST(asked - good AS BIGINT) AS bad FROM v WHERE good >= 2")
def answers_per_item(spark, sf):
    """FLT11 FLT12: single-letter answers, and items with two or more of them."""
    q = table(spark, sf, "conversations").select("conv_id", F.char(65 + (F.col("conv_id") + F.col("turn")) % 30).alias("answer"))
    ok = F.col("answer").rlike("^[A-Za-z]$")
    return q.groupBy("conv_id").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).where("good >= 2")


@R.add("SELECT o_orderkey AS id, coalesce(c_mktsegment, 'none') AS label, c_custkey IS NULL AS skipped FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def default_join(spark, sf):
    """JOI13: a partner or a default, and what is skipped for want of one."""
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    return o.join(c.withColumn("has", F.lit(True)), "k", "left").select("id", F.coalesce("c_mktsegment", F.lit("none")).alias("label"), F.col("has").isNull().alias("skipped"))


@R.add("SELECT doc_id, upper(source) || ':' || lang AS caption FROM documents")
def caption_fan_out(spark, sf):
    """JOI15 SRC52: each distinct key captioned once and joined back."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    once = d.select("source", "lang").distinct().withColumn("caption", F.concat(F.upper("source"), F.lit(":"), F.col("lang")))
    return d.join(once, ["source", "lang"]).select("doc_id", "caption")


@R.add("SELECT o_orderkey AS id, ['real', 'shift', 'flip', 'none'][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS kind FROM orders")
def answer_key(spark, sf):
    """JOI21: the kind of the option that a letter picks."""
    letter = F.char(65 + F.col("o_orderkey") % 4)
    kinds = F.array(*map(F.lit, ("real", "shift", "flip", "none")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(kinds, F.ascii(letter) - 64).alias("kind"))


@R.add(f"""WITH {SERIES}, f AS (SELECT id, id % 4 AS src, list_avg(s) AS m, list_stddev_pop(s) AS d FROM series), z AS (SELECT id, src, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS a, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS b FROM f),
p AS (SELECT x.id AS id, y.id AS cand_id, x.src = y.src AS same, round(sqrt((x.a-y.a)**2 + (x.b-y.b)**2), 6) AS dist FROM z x JOIN z y ON x.id <> y.id),
ring AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n, md5('random:' || id) AS h FROM series),
draws AS (SELECT id, j AS rk, (place + 1 + (CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n - 1) + (j - 1) * (CAST('0x' || substr(h, 9, 8) AS BIGINT) % greatest((n - 1) // 3, 1) + 1)) % (n - 1)) % n AS place FROM ring, unnest(range(1, 4)) t(j)),
k AS (SELECT id, 'near' AS setting, cand_id, row_number() OVER (PARTITION BY id ORDER BY dist, cand_id) AS rk FROM p UNION ALL SELECT id, 'same_source', cand_id, row_number() OVER (PARTITION BY id ORDER BY dist, cand_id) FROM p WHERE same UNION ALL SELECT d.id, 'random', r.id, rk FROM draws d JOIN ring r USING (place))
SELECT id, setting, cand_id, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= 3""")
def distractor_settings(spark, sf):
    """SRT2 SRT4 RNG2: distractors by distance, by distance inside the source, and at random."""
    s = F.col("s")
    items = user_series(spark, sf).select("id", (F.col("id") % 4).alias("src"), F.array(S.mean(s), S.pop_std(s)).alias("f"))
    z = stored(C.standardised(items, "f", [], 2).select("id", "src", "z"), "series")  # events are read for all three settings at once
    found = {"near": k_nearest(z, 3, []), "same_source": k_nearest(z, 3, ["src"]), "random": C.random_others(z, 3, "random")}
    parts = [df.select("id", F.lit(name).alias("setting"), "cand_id", "rank") for name, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


_EIGHT = ("m", "d", "lo", "hi", "slope", "lag1", "step", "turns")
_DIST8 = " + ".join(f"(x.{c} - y.{c}) ** 2" for c in _EIGHT)
_DIST4 = " + ".join(f"(x.{c} - y.{c}) ** 2" for c in _EIGHT[:4])


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, st AS (SELECT id, pos, x, n, x - lag(x) OVER (PARTITION BY id ORDER BY pos) AS d, lead(x) OVER (PARTITION BY id ORDER BY pos) AS nx FROM points), t AS (SELECT *, lag(d) OVER (PARTITION BY id ORDER BY pos) AS pd FROM st),
f AS (SELECT id, any_value(n) AS n, avg(x) AS m, stddev_pop(x) AS d, min(x) AS lo, max(x) AS hi, coalesce(regr_slope(x, pos), 0) AS slope, coalesce(corr(x, nx), 0) AS lag1, avg(abs(d)) AS step, CAST(count(*) FILTER (WHERE d * pd < 0) AS DOUBLE) AS turns FROM t GROUP BY id),
z AS (SELECT id, n, {", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in _EIGHT)} FROM f),
sh AS (SELECT a.id AS id, b.id AS cand_id, any_value(b.n) AS n, count(*) AS shared FROM (SELECT DISTINCT id, n, round(x, 1) AS v FROM points) a JOIN (SELECT id, n, round(x, 1) AS v FROM points) b ON a.n = b.n AND a.v = b.v AND a.id <> b.id GROUP BY a.id, b.id),
p AS (SELECT x.id AS id, y.id AS cand_id, round(sqrt({_DIST8}), 6) AS d8, round(sqrt({_DIST4}), 6) AS d4 FROM z x JOIN z y ON x.n = y.n AND x.id <> y.id WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.id = x.id AND sh.cand_id = y.id AND shared > 0.3 * sh.n)),
k AS (SELECT id, 'rich_stat' AS setting, cand_id, row_number() OVER (PARTITION BY id ORDER BY d8, cand_id) AS rk, 3 AS most FROM p UNION ALL SELECT id, 'n8', cand_id, row_number() OVER (PARTITION BY id ORDER BY d4, cand_id), 7 FROM p
  UNION ALL SELECT id, 'same_source', cand_id, row_number() OVER (PARTITION BY id ORDER BY shared DESC, cand_id DESC), 3 FROM sh WHERE shared <= 0.3 * n)
SELECT id, setting, cand_id, CAST(rk AS INTEGER) AS rank FROM k WHERE rk <= most""")
def distractor_overlap(spark, sf):
    """SRT4: distractors by eight numbers, seven of them by four, and those that share most values, all of the same length and without those that share three tenths and more."""
    items = user_series(spark, sf).withColumn("n", F.size("s"))
    for name, features, size in (("z8", C.features8, 8), ("z4", C.features4, 4)):
        items = C.standardised(items.withColumn("f", features(F.col("s"))), "f", [], size, name)
    items = stored(items.drop("f"), "series")
    classes, members = C.series_classes(items, ["n"], ["z8", "z4"], 7)
    banned, near = C.most_shared(classes, members, ["n"], 3, 0.3, 1)
    found = {"rich_stat": C.nearest_of_classes(classes, members, banned, 3, ["n"], "z8"), "n8": C.nearest_of_classes(classes, members, banned, 7, ["n"], "z4"), "same_source": near}
    parts = [df.select("id", F.lit(name).alias("setting"), "cand_id", "rank") for name, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@R.add("SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS brand, CAST(dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)) - 1 AS INTEGER) AS label FROM part")
def reindexed_labels(spark, sf):
    """SRC11 SRT9: labels numbered by their sorted values, numbers in names sorted as numbers. Classes are few: ranked apart and joined."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand"))
    labels = p.select("brand").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("brand")) - 1)
    return p.join(labels, "brand").select("id", "brand", "label")


@R.add("""WITH c AS (SELECT l_suppkey AS id, max(l_extendedprice) - min(l_extendedprice) AS spread, l_returnflag AS arm FROM lineitem GROUP BY ALL), a AS (SELECT id FROM c WHERE arm = 'A' ORDER BY spread DESC, id LIMIT 1), b AS (SELECT id FROM c WHERE arm = 'N' AND id NOT IN (SELECT id FROM a) ORDER BY spread DESC, id LIMIT 1)
SELECT 'A' AS arm, id FROM a UNION ALL SELECT 'N', id FROM b""")
def picked_cases(spark, sf):
    """SRT11 REP17 REP18: the widest case of each arm, without one picked before."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("arm")).agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread"))
    top = lambda rows: rows.orderBy(F.desc("spread"), "id").limit(1).select("arm", "id")
    a = top(c.where("arm = 'A'"))
    return a.union(top(c.where("arm = 'N'").join(a.select("id"), "id", "left_anti")))


#: A text, a reply that flags its numbers; the masked text, numbers that the reply does not name.
MASK_CASES = [
    ("Sales hit 45 in week 45.", "45 0\n45 1", "Sales hit 45 in week <val>.", 0),
    ("Closes near 812.", "812 1", "Closes near <val>.", 0),
    ("5812, then 812, then 812.25", "812 1\n5812 0\n812.25 1", "5812, then <val>, then <val>", 0),
    ("3) Lull: sinks to 96 in hour 14", "3 0\n96 1\n14 0", "3) Lull: sinks to <val> in hour 14", 0),
    ("Climbs to 51 in hour 6, back to 12 in hour 30.", "51 1\n6 0", "Climbs to <val> in hour 6, back to 12 in hour 30.", 2),
    ("Climbs to 51 in hour 6.", "There is nothing to flag here.", "Climbs to 51 in hour 6.", 2),
    ("Climbs to 51 in hour 6, back to 12 in hour 30.", "My flags:\n51 1\n777 0\n6 0\n* 12 1 *\n30 0\nthat is all", "Climbs to <val> in hour 6, back to <val> in hour 30.", 0),
    ("No figure is given for the slump", "", "No figure is given for the slump", 0),
    ("floats from 2.5 to 6.75 in days 11-13", "2.5 to 6.75 1\n11-13 0", "floats from <val> to <val> in days 11-13", 0),
    ("first 8 and 9, last 60–61", "8 and 9 1\n60 – 61: 1", "first <val> and <val>, last <val>–<val>", 0),
    ("spends days 40 to 44 at 0.3, having left 1.9 on day 38", "40 to 44 0\n1.9, 1\n38 0\n0.3 1", "spends days 40 to 44 at <val>, having left <val> on day 38", 0),
    ("eases to 0.50 on day 2, to 0.25 on day 5", "0.5 1\n2.0 0\n0.250 1\n5.00 0", "eases to <val> on day 2, to <val> on day 5", 0),
    ("from -7 up to -2 on day 9", "7 1\n2 1\n9 0", "from <val> up to <val> on day 9", 0),
    ("Tops out at 230 on day 17", "4) 230 1", "Tops out at <val> on day 17", 1),
    ("6\n7", "6\n7", "6\n7", 2),
]
MASK_COLUMNS = "text string, reply string, masked_of string, unnamed_of int"


@R.add(f"WITH {case_sql('events', 'event_id', MASK_CASES, MASK_COLUMNS)} SELECT id, masked_of AS masked, CAST(unnamed_of AS INTEGER) AS unnamed FROM cases")
def applied_masks(spark, sf):
    """SCL23 SCL24: numbers masked as reply lines say, the others kept and counted."""
    got = case_rows(spark, sf, "events", "event_id", MASK_CASES, MASK_COLUMNS)
    m = got.select("id", K.masked(F.col("text"), K.mask_flags(F.col("reply"))).alias("m"))
    return m.select("id", F.col("m.text").alias("masked"), F.col("m.unnamed").alias("unnamed"))


#: A text; how many places on the time axis it names, and their sum.
ANCHOR_CASES = [
    ("1. It peaks at time 7 and is flat from step 20 to 40, up 30%", 3, 67.0),
    ("2) steps 5-9 rise; at index 12.5 it turns", 3, 26.5),
    ("no places, only 40 and 50%", 0, 0.0),
    ("At t = 3, around point 8 and 9, it falls", 3, 20.0),
    ("time steps", 0, 0.0),
    ("Step 10% is no place, step 11 is", 1, 11.0),
]
ANCHOR_COLUMNS = "text string, n_of long, total_of double"


@R.add(f"WITH {case_sql('orders', 'o_orderkey', ANCHOR_CASES, ANCHOR_COLUMNS)} SELECT id, CAST(n_of AS BIGINT) AS anchors, CAST(total_of AS DOUBLE) AS total FROM cases")
def time_anchors(spark, sf):
    """SCL26 SCL28: places on the axis that a text names."""
    a = K.time_anchors(F.col("text"))
    return case_rows(spark, sf, "orders", "o_orderkey", ANCHOR_CASES, ANCHOR_COLUMNS).select("id", a.alias("a")).select("id", F.size("a").cast("long").alias("anchors"), F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("total"))


@R.add(f"WITH {SERIES} SELECT id, '89504E470D0A1A0A' AS head, true AS drawn FROM series")
def charts(spark, sf):
    """SRC50 SRC52 SRC53: a chart of each series; its first bytes, and whether it holds more than a blank one."""
    img = K.rendered(user_series(spark, sf), "id", "s")
    return img.select("id", F.substr(F.hex("image"), F.lit(1), F.lit(16)).alias("head"), (F.length("image") > 200).alias("drawn"))


@R.add("SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"n\":' || length(text) || '}' AS message FROM conversations")
def message_json(spark, sf):
    """SCL36 SCL38: messages as JSON, read back from chatter around them."""
    body = F.to_json(F.struct("role", F.length("text").alias("n")))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.inner_json(F.concat(F.lit("```json\n"), body, F.lit("\n``` done"))).alias("message"))


@R.add("WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer) SELECT c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE c_acctbal IS NULL OR c_acctbal < -1000) AS BIGINT) AS bad_values, CAST(count(*) FILTER (WHERE c_nationkey NOT BETWEEN 0 AND 24) AS BIGINT) AS bad_keys FROM c GROUP BY 1")
def shape_checks(spark, sf):
    """FLT24 STM11: data-quality checks counted over the whole table."""
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal").isNull() | (F.col("c_acctbal") < -1000)).alias("bad_values"), F.count_if(~F.col("c_nationkey").between(0, 24)).alias("bad_keys"))


@R.add("""WITH w AS (SELECT doc_id, source, md5('3:' || doc_id) AS h FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS rn FROM w) SELECT source, doc_id FROM k WHERE rn <= 2""")
def sample_per_source(spark, sf):
    """RNG9 SRT10: a keyed sample in each group."""
    d = table(spark, sf, "documents").select("source", "doc_id", C.keyed_order(F.lit(3), F.col("doc_id")).alias("h"))
    return L.first_per(d, ["source"], ["h", "doc_id"], 2).select("source", "doc_id")
