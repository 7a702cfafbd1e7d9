"""Queries over texts: parsers, scorers, prompts, masks, audits, sources, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import sequence as S
from ..functions import text as X
from ..operators import reports as P
from ..sources import adapters as A
from ..sources import readers as D
from ..streaming import rewards as W
from .base import POINTS_SQL, SERIES, Registry, case_rows, case_sql, table, user_series

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


#: reply; letter of A-D, of A-J, of a multiple choice, the first of A-I; truth value.
REPLY_CASES = [
    ("C", "C", "C", "C", "C", None),
    (" C.", "C", "C", "C", "C", None),
    ("The answer is B", "B", "B", "B", "B", None),
    ("A) is correct", "A", "A", "A", "A", None),
    ("nothing here", None, None, None, None, None),
    ("I think it is C", "C", "C", "C", "C", None),
    ("Option I", None, "I", None, "I", None),
    ("J)", None, "J", None, None, None),
    ("<answer>C</answer>", "C", "C", "C", "C", None),
    ("<ANSWER>d</ANSWER>", "D", "D", None, "D", None),
    ("D looks close but <answer>B</answer>", "B", "B", "B", "D", None),
    ("the answer is b", None, None, None, "B", None),
    ("A rising line, so A or B; final answer: D", "A", "A", "D", "B", None),
    ("Either B or C could fit, yet the low start speaks for C", "B", "B", "C", "B", None),
    ("B, not C", "B", "B", "B", "B", None),
    ("It is True.", None, None, None, None, "T"),
    ("false, it falls", None, None, None, None, "F"),
    ("f", None, None, None, "F", "F"),
    ("", None, None, None, None, None),
    ("A guess: A", "A", "A", "A", "A", None),
    ("I", None, "I", None, "I", None),
    ("Answer **(C)** fits", "C", "C", "C", "C", None),
    (None, None, None, None, None, None),
]
REPLY_COLUMNS = "reply string, four string, ten string, choice string, first_one string, truth_of string"
REPLY_SQL = case_sql("events", "event_id", REPLY_CASES, REPLY_COLUMNS)


def replies(spark, sf):
    return case_rows(spark, sf, "events", "event_id", REPLY_CASES, REPLY_COLUMNS)


def numeric_replies(spark, sf):
    """Replies made from ids with numbers in known places."""
    i, v = F.col("event_id"), F.col("value").cast("string")
    text = F.when(i % 3 == 0, F.concat(F.lit("It is true that value "), v, F.lit(" fits, False otherwise"))).when(i % 3 == 1, F.concat(F.lit("from -3 to "), v, F.lit("."))).otherwise(F.lit("no idea"))
    return table(spark, sf, "events").select(i.alias("id"), "value", text.alias("reply"))


REPLIES = """replies AS (SELECT event_id AS id, value, CASE event_id % 3 WHEN 0 THEN 'It is true that value ' || value || ' fits, False otherwise' WHEN 1 THEN 'from -3 to ' || value || '.' ELSE 'no idea' END AS reply FROM events)"""


@R.add(f"""WITH {REPLY_SQL} SELECT id, four AS letter, ten AS of_ten, choice AS mcq, first_one AS first, truth_of AS truth FROM cases""")
def reply_letter(spark, sf):
    """SCL1 SCL2 SCL3 SCL4: answer letters and truth values in replies of many forms."""
    c = F.col("reply")
    return replies(spark, sf).select("id", X.answer_letter(c).alias("letter"), X.answer_letter(c, "A-J").alias("of_ten"), X.mcq_letter(c).alias("mcq"), X.first_letter(c).alias("first"), X.truth_value(c).alias("truth"))


@R.add(f"""WITH {REPLIES}, n AS (SELECT id, value, list_transform(regexp_extract_all(reply, '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS nums FROM replies)
SELECT id, CAST(len(nums) AS BIGINT) AS n, round(list_max(list_transform(nums, lambda x: greatest(0.0, 1 - abs(x - (value + 1)) / nullif(abs(value + 1), 0)))), 6) AS score, len(list_filter(nums, lambda x: abs(x - value * 1.04) <= 0.05 * abs(value * 1.04))) > 0 AS close FROM n""")
def scorer_numeric(spark, sf):
    """SCL8 SCL9 SCL10: numbers in replies against gold numbers."""
    near, g, nums = F.col("value") * 1.04, F.col("value") + 1, X.numbers(F.col("reply"))
    close = F.exists(nums, lambda n: F.abs(n - near) <= 0.05 * F.abs(near))
    each = F.transform(nums, lambda n: F.greatest(F.lit(0.0), 1 - F.abs(n - g) / F.nullif(F.abs(g), F.lit(0.0))))
    return numeric_replies(spark, sf).select("id", F.size(nums).cast("long").alias("n"), r(F.array_max(each)).alias("score"), close.alias("close"))


#: scorer, gold, reply; score; label that a label scorer reads.
SCORER_CASES = [
    ("letter_exact", "E", "My pick would be E, given the late drop", 1.0, "E"),
    ("letter_exact", "F", "It has to be G", 0.0, "G"),
    ("letter_exact", "D", "both curves look the same to me", 0.0, None),
    ("letter_exact", " h ", "option h", 1.0, "H"),
    ("letter_exact", "I", "I would say F", 0.0, "F"),
    ("tf_exact", "F", "That is false: week nine is lower.", 1.0, "F"),
    ("tf_exact", "F", "TRUE", 0.0, "T"),
    ("tf_exact", "true", "t", 1.0, "T"),
    ("tf_exact", "F", "hard to tell", 0.0, None),
    ("letter_flexible", "D) Plateau", "Going by the middle part: d) plateau.", 1.0, None),
    ("letter_flexible", "D) Plateau", "C) Sawtooth, surely", 0.0, None),
    ("ordering_exact", "D,B,C,A", "From low to high: D < B < C < A", 1.0, None),
    ("ordering_exact", "D,B,C,A", "From low to high: D < C < B < A", 0.0, None),
    ("ordering_exact", "C, A", "C first, A second, and D after C", 1.0, None),
    ("ordering_exact", "d,c", "d, once more d, then c", 1.0, None),
    ("ordering_exact", "B,D,A", "B and D", 0.0, None),
    ("numeric_tolerance", "64", "64 units", 1.0, None),
    ("numeric_tolerance", "64", "it reads 48", 0.75, None),
    ("numeric_tolerance", "64", "sixty-four", 0.0, None),
    ("numeric_tolerance", "near 8", "8", 0.0, None),
    ("numeric_tolerance", " 2e3 ", "either 1400 or 3100", 0.7, None),
    ("numeric_tolerance", "0", "-0.00", 1.0, None),
    ("numeric_tolerance", "0", "0.02", 0.0, None),
    ("numeric_tolerance", "12", "960", 0.0, None),
    ("regex_numeric_extract_tolerance", "Week 31 of 2019 had the lowest load, 742.5 on the meter", "The low is at 743", 1.0, None),
    ("regex_numeric_extract_tolerance", "8 at first, 50 at last", "51.5 or else 8", 1.0, None),
    ("regex_numeric_extract_tolerance", "8 at first, 50 at last", "roughly 60", 0.0, None),
    ("regex_numeric_extract_tolerance", "not given", "17", 0.0, None),
]
SCORER_COLUMNS = "kind string, gold string, said string, want double, label string"


@R.add(f"WITH {case_sql('orders', 'o_orderkey', SCORER_CASES, SCORER_COLUMNS)} SELECT id, CAST(want AS DOUBLE) AS score, label FROM cases")
def scorer_dispatch(spark, sf):
    """SCL5 SCL6 SCL7 SCL8 SCL9 SCL11 SCL12: the scorer that an item names, and the label that label scorers read."""
    got = case_rows(spark, sf, "orders", "o_orderkey", SCORER_CASES, SCORER_COLUMNS)
    return got.select("id", r(X.score(F.col("kind"), F.col("gold"), F.col("said")), 9).alias("score"), X.parsed(F.col("kind"), F.col("said")).alias("label"))


#: A judge's words; grade of 1 to 10 (none counts as 1); verdict.
JUDGE_CASES = [("Grade: 7 of 10", 7, "false"), ("Yes, 12", 10, "true"), ("0", 1, "false"), ("none", 1, "false"), ("  YES", 1, "true"), ("I say yes", 1, "false"), ("8", 8, "false"), ("[yes] 3/10", 3, "true"), ("No. 2", 2, "false"), ("", 1, "false")]
JUDGE_COLUMNS = "said string, grade_of long, yes_of string"


@R.add(f"WITH {case_sql('orders', 'o_orderkey', JUDGE_CASES, JUDGE_COLUMNS)} SELECT id, round((grade_of - 1) / 9.0 * 2, 6) AS grade, yes_of = 'true' AS yes FROM cases")
def judge_grades(spark, sf):
    """SCL13 SCL14 STM7: grades and verdicts in a judge's words."""
    got = case_rows(spark, sf, "orders", "o_orderkey", JUDGE_CASES, JUDGE_COLUMNS)
    return got.select("id", r(X.judge_grade(F.col("said"))).alias("grade"), X.verdict(F.col("said")).alias("yes"))


@R.add(f"""WITH {SERIES}, d AS (SELECT id, s, list_max(list_transform(s, lambda x: abs(x))) AS top FROM series), k AS (SELECT id, s, CASE WHEN top <= 0 THEN 2 ELSE least(3, greatest(0, 3 - floor(log10(top)))) END AS k FROM d)
SELECT id, CAST(k AS INTEGER) AS decimals, '[' || array_to_string(list_transform(s, lambda x: CASE k WHEN 0 THEN printf('%.0f', x) WHEN 1 THEN printf('%.1f', x) WHEN 2 THEN printf('%.2f', x) ELSE printf('%.3f', x) END), ', ') || ']' AS text,
  md5('[' || array_to_string(list_transform(s, lambda x: printf('%.3f', x)), ', ') || ']') AS three FROM k""")
def series_texts(spark, sf):
    """SCL29 SCL32: series as text, with decimals by size and with three."""
    got = user_series(spark, sf).withColumn("decimals", S.decimals_for(F.col("s")).cast("int"))
    return got.select("id", "decimals", X.format_series("s", "decimals").alias("text"), F.md5(X.format_series("s", F.lit(3))).alias("three"))


@R.add("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_nationkey > 5 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS text,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 5 > 0 THEN 'trend/' || c_name END AS type FROM customer""")
def first_texts(spark, sf):
    """SCL40: the first candidate that holds text; a type from a text or a list."""
    i = F.col("c_custkey")
    a, b = F.when((i % 3 == 0) & (F.col("c_nationkey") > 5), F.col("c_mktsegment")).when(i % 3 == 0, ""), F.when(i % 3 == 1, F.col("c_name"))
    several = F.when(i % 5 > 0, F.array(F.lit("trend"), F.col("c_name"))).otherwise(F.array().cast("array<string>"))
    one = F.when(i % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit(" "))
    return table(spark, sf, "customer").select(i.alias("id"), X.first_text(a, b, F.col("c_nationkey")).alias("text"), X.joined_type(one, several).alias("type"))


@R.add(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?:^|[^0-9.])-?[0-9]+(?:\.[0-9]+)?')) AS BIGINT) AS numbers, md5(regexp_replace(text, '-?\d+\.?\d*', '[NUM]', 'g')) AS masked, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS tokens,
  least(1536, 96 + 8 * len(regexp_extract_all(text, '(?:^|[^0-9.])-?[0-9]+(?:\.[0-9]+)?'))) AS budget FROM documents""")
def masked_numbers(spark, sf):
    """SCL20 SCL21 SCL25: numbers masked and counted, and the token budget that follows."""
    t = F.col("text")
    n = X.number_count(t)
    return table(spark, sf, "documents").select("doc_id", n.alias("numbers"), F.md5(X.masked_numbers(t)).alias("masked"), F.size(X.tokens(t)).cast("long").alias("tokens"), X.token_budget(n).alias("budget"))


@R.add(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) < 80 THEN 'short' WHEN NOT regexp_matches(t, '[.!?")]$') THEN 'unfinished' END AS fault FROM d""")
def caption_qc(spark, sf):
    """FLT7: why a caption is refused."""
    return table(spark, sf, "documents").select("doc_id", X.caption_fault(F.col("text")).alias("fault"))


@R.add(r"""SELECT doc_id, regexp_matches(text, '\d') OR regexp_matches(text, '(?i)\b(percent|per cent)\b') AS leak, regexp_matches(text, '(?i)\b(only|sole|exactly one|unique)\b') AS claims, contains(lower(text), 'license') OR contains(lower(text), 'token') AS mentions FROM documents""")
def caption_flags(spark, sf):
    """FLT13 FLT15 FLT22 FLT23: leaks of numbers, claims of uniqueness, keywords."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.number_leak(t).alias("leak"), X.claims_uniqueness(t).alias("claims"), X.mentions(t, ["license", "token"]).alias("mentions"))


#: A text, the sizes of its chunks, and its numbers.
CHUNK_CASES = [
    ("Opened on 03.11.1998 and closed on 9.9.9; build 2.0.1 ran 4 times. Then 5, 6 and 7", "67,15", 7),
    ("1 2 3 4 5 6 in one breath without a stop", "40", 6),
    ("a 1, 2; b 3! c 4? d 5: e 6. f 7\n\ng 8", "23,13", 8),
    ("1 2 3\n4 5\n\n6 7 8 9\n10", "11,10", 10),
    ("\n 0.5-0.7 up. ", "14", 2),
    ("", "0", 0),
]
CHUNK_COLUMNS = "text string, sizes_of string, n_of long"


@R.add(f"WITH {case_sql('customer', 'c_custkey', CHUNK_CASES, CHUNK_COLUMNS)} SELECT id, sizes_of AS sizes, CAST(n_of AS BIGINT) AS numbers, CAST(96 + 8 * n_of AS BIGINT) AS budget FROM cases")
def chunk_cases(spark, sf):
    """SCL22 SCL25: chunks, numbers and token budgets of dates, versions, ranges, long sentences and empty texts."""
    t = F.col("text")
    rows = case_rows(spark, sf, "customer", "c_custkey", CHUNK_CASES, CHUNK_COLUMNS)
    sizes = F.array_join(F.transform(X.chunks(t), lambda c: F.length(c).cast("string")), ",")
    return rows.select("id", sizes.alias("sizes"), X.number_count(t).alias("numbers"), X.token_budget(X.number_count(t)).alias("budget"))


@R.add(r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?;:]\s+|\n+)', '\1' || chr(31), 'g'), chr(31)) AS ps FROM documents),
s AS (SELECT doc_id, text, list_transform(ps, lambda p: {'k': CAST(len(regexp_extract_all(p, '(?:^|[^0-9.])-?[0-9]+(?:\.[0-9]+)?')) AS BIGINT), 'size': CAST(length(p) AS BIGINT), 'done': CAST([] AS BIGINT[])}) AS ps FROM p),
f AS (SELECT doc_id, text, list_reduce(ps, lambda a, b: CASE WHEN a.size > 0 AND a.k + b.k > 5 THEN {'k': b.k, 'size': b.size, 'done': list_append(a.done, a.size)} ELSE {'k': a.k + b.k, 'size': a.size + b.size, 'done': a.done} END) AS f FROM s)
SELECT doc_id, array_to_string(CASE WHEN f.size > 0 OR len(f.done) = 0 THEN list_append(f.done, f.size) ELSE f.done END, ',') AS sizes, md5(text) AS joined FROM f""")
def lossless_chunks(spark, sf):
    """SCL22 JOI14: sizes of the pieces of each text, and what they join to."""
    got = table(spark, sf, "documents").select("doc_id", X.chunks(F.coalesce("text", F.lit(""))).alias("c"))
    return got.select("doc_id", F.array_join(F.transform("c", lambda c: F.length(c).cast("string")), ",").alias("sizes"), F.md5(F.array_join("c", "")).alias("joined"))


@R.add(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM w, unnest(range(1, len(w) - 8)) t(i)), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS repeats FROM w LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def repeated_gram(spark, sf):
    """WIN30: most frequent run of ten words of each text."""
    return table(spark, sf, "documents").select("doc_id", X.repeated_gram(F.col("text")).alias("repeats"))


@R.add(r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, md5(url) AS stem, regexp_extract(url, '/([^/?#]*)[?#]?[^/]*$', 1) AS last FROM pages""")
def slugs(spark, sf):
    """SCL39 SRC21-23 JOI2: slugs, stem keys and parts of paths."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.slug(u).alias("slug"), F.md5(u).alias("stem"), F.regexp_extract(u, r"/([^/?#]*)[?#]?[^/]*$", 1).alias("last"))


@R.add("""SELECT conv_id, substr(sha256(array_to_string(list(text ORDER BY turn)[1:20], chr(30))), 1, 12) AS fingerprint FROM conversations GROUP BY conv_id""")
def prompt_fingerprint(spark, sf):
    """SCL37 FLT21: one fingerprint over the first prompts in order."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return c.select("conv_id", X.fingerprint(F.col("t")).alias("fingerprint"))


@R.add("""SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 5 = 0 THEN '(no caption)' ELSE o_orderpriority END) || chr(10) || 'A) ' || o_orderstatus || chr(10) || 'B) x' || chr(10) || 'Answer with one letter from A to B.' AS prompt FROM orders""")
def prompt_build(spark, sf):
    """SCL33 SCL34 SCL35: question, lettered options, what to answer with."""
    q = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.prompt(q, F.array("o_orderstatus", F.lit("x"))).alias("prompt"))


@R.add("""WITH h AS (SELECT item_id, text, substr(text, 1, 60) AS h FROM benchmark), c AS (SELECT *, greatest(CASE WHEN instr(reverse(h), ' .') > 0 THEN length(h) - instr(reverse(h), ' .') - 1 ELSE -1 END, CASE WHEN instr(reverse(h), chr(10) || '.') > 0 THEN length(h) - instr(reverse(h), chr(10) || '.') - 1 ELSE -1 END) AS stop FROM h)
SELECT item_id, CASE WHEN length(text) <= 60 THEN text WHEN stop > 30 THEN left(h, stop + 1) ELSE h END AS head, CAST(('0x' || substr(md5(text), 30, 3)) AS BIGINT) AS bucket FROM c""")
def cut_texts(spark, sf):
    """SCL41 SCL42: texts cut at a sentence's end; md5 buckets."""
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", X.cut_at_sentence(t, 60).alias("head"), X.md5_bucket(t).alias("bucket"))


@R.add(f"""WITH {SERIES} SELECT id, CAST(len(regexp_extract_all('[' || array_to_string(s, ', ') || ']', '[-\\d.]+')) AS BIGINT) AS n, round(list_sum(s), 4) AS total FROM series""")
def literal_arrays(spark, sf):
    """SRC4 SRC5: series written as a literal and read back."""
    lit = F.concat(F.lit("["), F.array_join(F.col("s").cast("array<string>"), ", "), F.lit("]"))
    back = user_series(spark, sf).select("id", D.literal_array(lit, strict=False).alias("b"), D.literal_array(lit).alias("c"))
    return back.where(F.col("b") == F.col("c")).select("id", F.size("b").cast("long").alias("n"), r(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@R.add("SELECT CAST(sum(event_id % 7) AS BIGINT) AS bad, CAST(sum(10) AS BIGINT) AS total FROM events")
def unparsed_from_log(spark, sf):
    """SRC25: counts summed from log lines."""
    lines = table(spark, sf, "events").select(F.concat(F.lit("step done unparsed="), (F.col("event_id") % 7).cast("string"), F.lit("/10 ok")).alias("value"))
    return D.unparsed_share(lines)


@R.add("""SELECT k AS stem, CASE WHEN k LIKE 'r%' THEN 'r1' ELSE 'empty' END AS arm, CASE k WHEN 'r1_mismatch' THEN 'mismatch' WHEN 'r1_valmask_random' THEN 'valmask' WHEN 'empty' THEN 'empty' ELSE 'none' END AS control, CASE WHEN k LIKE '%_random' THEN 'random' ELSE 'knn' END AS "order" FROM (VALUES ('r1'), ('r1_mismatch'), ('r1_valmask_random'), ('empty'), ('r1_random')) v(k)""")
def stem_parts(spark, sf):
    """SRC24: arm, control and order in a file stem."""
    rows = spark.createDataFrame([(k,) for k in ("r1", "r1_mismatch", "r1_valmask_random", "empty", "r1_random")], "stem string")
    arm, control, order = D.stem_parts(F.col("stem"))
    return rows.select("stem", arm.alias("arm"), control.alias("control"), order.alias("order"))


@R.add("""WITH p AS (SELECT conv_id, turn, 'DROP' AS k FROM conversations WHERE turn % 2 = 1) SELECT conv_id, concat('img', CAST(turn // 2 AS BIGINT)) AS image, CAST(0 AS BIGINT) AS question, 'why' AS reason FROM p""")
def report_drops(spark, sf):
    """SRC26 SRC28 JOI18: dropped questions of markdown reports, with headers carried on."""
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    line = F.when(t % 2 == 0, F.concat(F.lit("## img"), F.floor(t / 2).cast("string"), F.lit(" (1/2 survive)"))).otherwise("- q **DROP** [region/max] — why")
    return D.report_drops(c.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line").select("conv_id", "image", F.col("question").cast("long").alias("question"), "reason")


@R.add("""WITH f AS (SELECT event_id AS ord, user_id AS uid, value, event_type AS a, min(CASE WHEN value > 20 THEN event_id END) OVER (PARTITION BY user_id) AS ok FROM events), k AS (SELECT * FROM f WHERE ord >= ok)
SELECT uid, round(min_by(value, ord), 6) AS first, CAST(count(DISTINCT a) AS BIGINT) AS annotations FROM k GROUP BY uid""")
def fold_annotations(spark, sf):
    """SRC12 SRC39: the first finite series opens a uid, later rows add annotations."""
    e = table(spark, sf, "events")
    s = F.when(F.col("value") > 20, F.array("value")).otherwise(F.array(F.lit(float("nan"))))
    got = D.fold_annotations(e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("ord"), s.alias("series"), F.col("event_type").alias("annotation")))
    return got.select("uid", r(F.col("series")[0]).alias("first"), F.size("annotations").cast("long").alias("annotations"))


@R.add("""SELECT o_orderkey AS id, 'letter_exact' AS scoring, chr(64 + CAST(o_orderkey % 3 + 1 AS INTEGER)) AS gold, CAST(3 AS BIGINT) AS options, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS variates FROM orders""")
def lettered_items(spark, sf):
    """SRC29 SRC35 SRC38: items with lettered options and one or two series."""
    i = F.col("o_orderkey")
    one = F.array(F.lit(1.0), F.lit(2.0))
    rows = table(spark, sf, "orders").select(i.alias("id"), F.lit("Which?").alias("question"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("choices"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (i % 3 + 1).cast("int")).alias("answer"), F.when(i % 2 == 0, one).alias("ts"), one.alias("ts1"), one.alias("ts2"))
    return A.ADAPTERS["lettered_choice"](rows).select("id", "scoring", "gold", F.size("options").cast("long").alias("options"), F.size("series").cast("long").alias("variates"))


@R.add("""SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'tf_exact' ELSE 'letter_exact' END AS scoring, CASE WHEN item_id % 2 = 0 THEN 'T' ELSE 'B' END AS gold, CAST(3 AS BIGINT) AS points FROM benchmark""")
def tagged_items(spark, sf):
    """SRC34 SRC37: questions and answers between tags."""
    text = F.concat(F.lit("<QUE> Look at [1, 2.5, 3] please. <ANS> "), F.when(F.col("item_id") % 2 == 0, "True").otherwise("B) it falls"))
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), text.alias("text"))
    return A.tagged_text(rows).select("id", "scoring", "gold", F.size(F.col("series")[0]).cast("long").alias("points"))


@R.add("""WITH q AS (SELECT DISTINCT conv_id AS request FROM conversations), a AS (SELECT request, g, (request + g) % 4 = g AS hit FROM q, unnest(range(0, 4)) t(g)) SELECT request, round(avg(CAST(hit AS DOUBLE)), 6) AS accuracy, round(avg(CAST(hit AS DOUBLE)) * 2, 6) AS reward FROM a GROUP BY request""")
def reward_batch(spark, sf):
    """STM1 STM2 RNG6: captions asked at every place, replies scored, rewards by caption."""
    q = table(spark, sf, "conversations").select(F.col("conv_id").alias("request")).distinct()
    rows = q.select("request", F.lit(1).alias("id"), F.lit("a caption").alias("caption"), F.lit("gold").alias("true"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("distractors"), F.sequence(F.lit(0), F.lit(3)).alias("places"))
    parts = lambda key, i: F.split(key, ":")[i].cast("int")
    answer = lambda prompt, key: F.char(65 + (parts(key, 0) + parts(key, 2)) % 4)
    return W.rewards(rows, answer, 4).select("request", r("accuracy").alias("accuracy"), r("reward").alias("reward"))


@R.add("""WITH k AS (SELECT conv_id AS request, i, md5(conv_id || ':1:' || i) AS h FROM (SELECT DISTINCT conv_id FROM conversations), unnest(range(0, 8)) t(i)) SELECT request, array_to_string(list('d' || i ORDER BY rn), ',') AS distractors FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY h) AS rn FROM k) WHERE rn <= 3 GROUP BY request""")
def fresh_distractors(spark, sf):
    """STM3 STM4: distractors drawn anew for each request, by its key."""
    q = table(spark, sf, "conversations").select(F.col("conv_id").alias("request")).distinct().select("request", F.lit(1).alias("id"), F.array(*(F.lit(f"d{i}") for i in range(8))).alias("pool"))
    return W.fresh_distractors(q, "pool", 3).select("request", F.array_join("distractors", ",").alias("distractors"))


@R.add(f"""WITH {REPLY_SQL} SELECT coalesce(four, 'unparsed') AS letter, CAST(count(*) AS BIGINT) AS n FROM cases GROUP BY 1""")
def running_totals(spark, sf):
    """STM8: calls and picks so far (as a batch; the same plan runs on a stream)."""
    return W.running_totals(replies(spark, sf))


#: Word characters: ASCII letters, digits, underscore, and all beyond ASCII.
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^0-9A-Za-z_\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> ''))"


@R.add(f"""WITH i AS (SELECT DISTINCT ON (item_id) item_id, text FROM benchmark ORDER BY item_id, text), v AS (SELECT a.item_id, {_WORDS.format("a.text")} AS w, {_WORDS.format("b.text")} AS o FROM i a JOIN i b ON b.item_id = a.item_id + 1)
SELECT item_id, round(len(list_intersect(w, o)) / len(w), 6) AS p, len(list_intersect(w, o)) / len(w) >= 0.2 AS entails FROM v""")
def entailment_rates(spark, sf):
    """UDF3 AGG13: entailment of each text by that of the next id, by the stand-in."""
    b = table(spark, sf, "benchmark").groupBy("item_id").agg(F.min("text").alias("text"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    p = M.overlap_entailment(F.col("other"), F.col("text"))
    return b.join(other, "item_id").select("item_id", r(p).alias("p"), (p >= 0.2).alias("entails"))


@R.add(f"""WITH {SERIES}, {POINTS_SQL}, t AS (SELECT id, regr_slope(x, pos) * count(*) / nullif(stddev_pop(x), 0) AS m, avg(x) AS mean, min(x) AS lo, max(x) AS hi, count(*) AS n FROM points GROUP BY id)
SELECT id, 'The series has ' || n || ' points with a mean of ' || printf('%.2f', mean) || ', goes from ' || printf('%.2f', lo) || ' to ' || printf('%.2f', hi) || ' and its trend is ' || CASE WHEN m > 0.5 THEN 'upward' WHEN m < -0.5 THEN 'downward' ELSE 'flat' END || '.' AS caption FROM t""")
def mock_captions(spark, sf):
    """UDF1 UDF4 SCL44 SCL45: captions from statistics."""
    return user_series(spark, sf).select("id", M.mock_caption(F.col("s")).alias("caption"))


@R.add("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment ELSE c_name END AS caption FROM customer")
def control_captions(spark, sf):
    """UDF12 UDF13: empty, mismatched or own captions."""
    control = F.when(F.col("c_custkey") % 3 == 0, "empty").when(F.col("c_custkey") % 3 == 1, "mismatch").otherwise("none")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), M.controlled_caption(control, F.col("c_name"), F.col("c_mktsegment")).alias("caption"))


#: A question; stem, number of options, family.
QUESTION_CASES = [
    ("When?\n- A) t = 5\n- B) t=10\n- C) **T = 15\n- D) never", "When?", 4, "time"),
    ("How much?\n- A) about 5 units\n- B) 7.5 %\n- C) roughly 10\n- D) none", "How much?", 4, "numeric"),
    ("Shape?\n- A) up\n- B) down\n- C) flat\n- D) wavy", "Shape?", 4, "verbal"),
    ("Which?\n- A) rises by 5 near its slow start\n- B) 3\n- C) 4\n- D) falls", "Which?", 4, "verbal"),
    ("Two of three times?\n- A) t = 1\n- B) t = 2\n- C) 7", "Two of three times?", 3, "verbal"),
    ("Range?\n- A) ~1-2 points\n- B) a drop of (3.5)\n- C) +4%\n- D) an increase", "Range?", 4, "numeric"),
    ("No options here", "No options here", 0, "unparsed"),
]
QUESTION_COLUMNS = "q string, stem_of string, n_of long, family_of string"


@R.add(f"""WITH {case_sql("orders", "o_orderkey", QUESTION_CASES, QUESTION_COLUMNS)} SELECT id, stem_of AS stem, CAST(n_of AS BIGINT) AS n, family_of AS family FROM cases""")
def question_options(spark, sf):
    """SCL16 SCL17 SCL18 FLT14: option lines, the stem before them and the family of the question."""
    opts = X.options(F.col("q"))
    got = case_rows(spark, sf, "orders", "o_orderkey", QUESTION_CASES, QUESTION_COLUMNS)
    return got.select("id", X.stem(F.col("q")).alias("stem"), F.size(opts).cast("long").alias("n"), X.question_family(F.transform(opts, lambda o: o["text"])).alias("family"))


@R.add("SELECT doc_id, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, 'License') THEN 'license' ELSE 'prose' END AS family, CAST(round(100 * len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[0-9]'))) / len(string_split(text, ' '))) AS BIGINT) AS digits FROM documents")
def text_family(spark, sf):
    """SCL43: families by what a text contains."""
    t = F.col("text")
    words = F.split(t, " ")
    return table(spark, sf, "documents").select("doc_id", F.when(F.contains(t, F.lit("|")), "table").when(F.contains(t, F.lit("License")), "license").otherwise("prose").alias("family"), F.round(100 * F.size(F.filter(words, lambda x: x.rlike("[0-9]"))) / F.size(words)).cast("long").alias("digits"))


@R.add("SELECT l_returnflag AS arm, CAST(count(*) AS BIGINT) AS n, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, CAST(count(*) AS BIGINT), NULL FROM orders GROUP BY 1")
def union_runs(spark, sf):
    """SET1 SRC48 REP3: runs with different columns in one table."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_tax")).alias("tax"))
    b = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    return P.union_all([a, b])
