"""Queries over what texts claim and series made from series: question blocks, audits, positions, anchors, perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captions as Q
from ..functions import sequence as S
from ..functions import text as X
from ..operators import masking as K
from ..operators import perturb as U
from ..operators.candidates import keyed_order
from ..operators.neighbours import placed
from ..streaming import rewards as W
from .base import SERIES, Registry, case_rows, case_sql, table, user_series

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


@R.add(r"""WITH b AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS form, regexp_replace(lower(coalesce(text, '')), '[^a-z ]', ' ', 'g') AS q FROM conversations),
k AS (SELECT conv_id, turn, CASE form WHEN 0 THEN 'B' WHEN 1 THEN 'C' ELSE 'D' END AS answer, trim(CASE form WHEN 0 THEN 'Q ' ELSE '' END || q || chr(10) || '- A) up' || chr(10) || '- B) down', ' ' || chr(10)) AS question FROM b WHERE form < 3)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n, answer, md5(question) AS question FROM k""")
def qa_blocks(spark, sf):
    """SCL17: questions and answers out of a model's text, made of all turns of a conversation; broken blocks give nothing."""
    c = table(spark, sf, "conversations")
    q = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]", " ")
    ask = "\n- A) up\n- B) down\n"
    forms = [(F.lit("## 3. **Q** "), q, f"{ask}**Answer:** B) down"), (q, f"{ask}answer: c) flat"), (q, f"{ask}I would pick D"), (q, "\nAnswer: A)"), (F.lit("Answer: B) "), q), (q, "\n- A) up\nanswer) none")]
    block = F.lit(None).cast("string")
    for i, parts in enumerate(forms):
        block = F.when((F.col("conv_id") + F.col("turn")) % 6 == i, F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))).otherwise(block)
    texts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n------\n").alias("text"))
    found = texts.select("conv_id", F.posexplode(Q.qa_blocks(F.col("text"))).alias("n", "x"))
    return found.select("conv_id", "n", "x.answer", F.md5("x.question").alias("question"))


#: Patterns of the audit as DuckDB has them, without looking ahead.
_AUDIT_SQL = {name: pattern.replace("'", "''") for name, pattern in Q.CHECKS.items()}


def _numbers_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{Q.AUDIT_NUMBER}'), lambda x: replace(x, ',', ''))"


@R.add(rf"""WITH n AS (SELECT max(item_id) + 1 AS m FROM benchmark), g AS (SELECT item_id, min(text) AS gold FROM benchmark GROUP BY item_id),
t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(gold, '') AS g FROM documents CROSS JOIN n LEFT JOIN g ON item_id = doc_id % m)
SELECT doc_id, regexp_matches(t, '(?i)\bindex\s+\d+|\b\d+(?:st|nd|rd|th)\s+point|\b({Q.ORDINALS})\s+point\b') OR len(list_filter(regexp_extract_all(t, '(?i)\b\d+\s+points\b(?:\s+(?:to|toward|towards)\b)?'), lambda x: NOT regexp_matches(x, '(?i)\s(to|toward|towards)$'))) > 0 AS point_numbering,
  regexp_matches(t, '{_AUDIT_SQL["time_unit_count"]}') AS time_unit_count, regexp_matches(t, '{_AUDIT_SQL["month_or_date"]}') AS month_or_date, regexp_matches(t, '{_AUDIT_SQL["unit_or_currency"]}') AS unit_or_currency,
  regexp_matches(t, '{_AUDIT_SQL["external_statistic"]}') AS external_statistic, regexp_matches(t, '{_AUDIT_SQL["frequency_word"]}') AS frequency_word,
  len(list_filter({_numbers_sql("t")}, lambda x: NOT list_contains({_numbers_sql("g")}, x))) > 0 AS number_not_in_gold,
  coalesce(list_contains(list_transform(list_filter(regexp_extract_all(g, '(?:in|from|to|by|since|during|of|,)\s+(?:18|19|20)\d\d[\d.]?'), lambda x: regexp_matches(x, '\s(18|19|20)\d\d$')), lambda x: right(x, 4)), nullif(regexp_extract(t, '{Q.AUDIT_YEAR}', 1), '')), false) AS year FROM t""")
def caption_audit(spark, sf):
    """FLT23: eight flags of each document against a benchmark item as its gold text."""
    b = table(spark, sf, "benchmark")
    n = b.agg(F.max("item_id") + 1).first()[0]
    gold = b.groupBy("item_id").agg(F.min("text").alias("gold"))
    docs = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % F.lit(n)).alias("item_id")).join(gold, "item_id", "left")
    return docs.select("doc_id", *(c.alias(name) for name, c in Q.audit_flags(F.col("text"), F.col("gold")).items()))


PEAK = r"maximum|peak\w*|highest"
#: A text; where its dates put the peak, and the words for it.
POSITION_CASES = [
    ("Between March 2010 and March 2012 demand grew; its peak came in September 2011", 0.75, None),
    ("From 2000 to 2004, the highest level was at the start, in 2001", 0.25, "early"),
    ("The peak is midway and the maximum near the end", None, "mid"),
    ("Peaks appear a third way through the record", None, "early"),
    ("maximum of 7 late in the series; from 1990 to 1980 it fell, peak in 1985", None, "late"),
    ("From 2001 to 2003 sales rose. The maximum was by June 2010.", None, None),
    ("between january 1999 - July 1999: a PEAK on April 3, 1999", 0.5, None),
    ("nothing of the kind", None, None),
    ("", None, None),
]
POSITION_COLUMNS = "text string, fraction_of double, phrase_of string"


@R.add(f"WITH {case_sql('customer', 'c_custkey', POSITION_CASES, POSITION_COLUMNS)} SELECT id, CAST(fraction_of AS DOUBLE) AS fraction, phrase_of AS phrase, CASE WHEN fraction_of < 1/3 THEN 'early' WHEN fraction_of > 2/3 THEN 'late' WHEN fraction_of IS NOT NULL THEN 'mid' END AS bucket FROM cases")
def position_cases(spark, sf):
    """SCL28: dates and position words as parts of the axis."""
    rows = case_rows(spark, sf, "customer", "c_custkey", POSITION_CASES, POSITION_COLUMNS)
    at = Q.date_fraction(F.col("text"), PEAK)
    return rows.select("id", r(at).alias("fraction"), Q.phrase_position(F.col("text"), PEAK).alias("phrase"), Q.position_bucket(at).alias("bucket"))


_MONTH_SQL = "greatest(coalesce(list_position([" + ", ".join(f"'{m}'" for m in Q.MONTHS) + "], lower({})), 0), 1)"


@R.add(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' From ' || (1950 + doc_id % 30) || ' to ' || ['May', 'august', 'December'][CAST(doc_id % 3 + 1 AS BIGINT)] || ' ' || (1985 + doc_id % 25) || ' it ran, and the peak came ' || ['early on', 'midway', 'near the end', 'once'][CAST(doc_id % 4 + 1 AS BIGINT)] || ' in July ' || (1970 + doc_id % 40) AS t FROM documents),
m AS (SELECT doc_id, regexp_matches(t, '{Q.SPAN}') AND regexp_matches(t, '(?i)(?:{PEAK}){Q.DATED}') AS told, regexp_extract(t, '{Q.SPAN}', ['am', 'ay', 'bm', 'by']) AS s, regexp_extract(t, '(?i)(?:{PEAK}){Q.DATED}', ['pm', 'py']) AS p, substr(regexp_extract(t, '(?is)(?:{PEAK})([^,.;]*)', 1), 1, 70) AS c FROM t),
n AS (SELECT doc_id, c, told, try_cast(s.ay AS BIGINT) * 12 + {_MONTH_SQL.format("s.am")} AS a, try_cast(s.by AS BIGINT) * 12 + {_MONTH_SQL.format("s.bm")} AS b, try_cast(p.py AS BIGINT) * 12 + {_MONTH_SQL.format("p.pm")} AS p FROM m)
SELECT doc_id, CASE WHEN told AND b > a AND p BETWEEN a AND b THEN round((p - a) / (b - a), 6) END AS fraction,
  CASE WHEN regexp_matches(c, '{Q.EARLY}') THEN 'early' WHEN regexp_matches(c, '{Q.MIDDLE}') THEN 'mid' WHEN regexp_matches(c, '{Q.LATE}') THEN 'late' ELSE (MAP {{'two-thirds': 'late', 'three-quarter': 'late', 'quarter': 'early', 'one-third': 'early', 'third': 'early', 'half': 'mid'}})[lower(regexp_extract(c, '{Q.THROUGH}', 1))] END AS phrase FROM n""")
def document_positions(spark, sf):
    """SCL28: the same over documents that end in a sentence with a span, a peak and a date."""
    i = F.col("doc_id")
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (i % n + 1).cast("int"))
    year = lambda a, n: (F.lit(a) + i % n).cast("string")
    sentence = F.concat(F.lit(" From "), year(1950, 30), F.lit(" to "), pick(3, "May", "august", "December"), F.lit(" "), year(1985, 25), F.lit(" it ran, and the peak came "), pick(4, "early on", "midway", "near the end", "once"), F.lit(" in July "), year(1970, 40))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), sentence).alias("t"))
    return rows.select("doc_id", r(Q.date_fraction(F.col("t"), PEAK)).alias("fraction"), Q.phrase_position(F.col("t"), PEAK).alias("phrase"))


@R.add(f"""WITH {SERIES}, f AS (SELECT id, s, len(s) AS n, list_position(s, list_max(s)) - 1 AS top, list_min(s) AS lo, list_max(s) AS hi, list_avg(s) AS mean, coalesce(nullif(list_stddev_pop(s), 0), 1) AS sd FROM series),
c AS (SELECT *, list_transform([top, 3, 7, 12], lambda a: least(9, floor(a / n * 10))) AS bins, [CAST(printf('%.1f', hi) AS DOUBLE), CAST(printf('%.1f', mean) AS DOUBLE)] AS bare FROM f),
v AS (SELECT *, list_concat(bare, [0.0, 500.0]) AS vals FROM c)
SELECT id, CAST(4 AS BIGINT) AS anchors, CAST(1 AS BIGINT) AS prose, round(len(list_distinct(bins)) / 10, 6) AS coverage, round(-list_sum(list_transform(list_distinct(bins), lambda b: len(list_filter(bins, lambda x: x = b)) / 4 * log2(len(list_filter(bins, lambda x: x = b)) / 4))), 6) + 0.0 AS entropy, CAST(4 AS BIGINT) AS claims,
  round(list_median(list_transform(vals, lambda v: list_min(list_transform(s, lambda x: abs(v - x))) / sd)), 5) AS gap, round(len(list_filter(vals, lambda v: v < lo - 0.1 * (hi - lo) OR v > hi + 0.1 * (hi - lo))) / 4, 6) AS outside,
  round(list_median(list_transform(bare, lambda v: list_min(list_transform(s, lambda x: abs(v - x))) / sd)), 5) AS gap_bare, round(len(list_filter(bare, lambda v: v < lo - 0.1 * (hi - lo) OR v > hi + 0.1 * (hi - lo))) / 2, 6) AS outside_bare FROM v""")
def caption_anchors(spark, sf):
    """WIN31 SCL26 SCL27: captions of whole series: bins of the axis that they name and their entropy, claimed values against the series, with and without talk about axes."""
    s = F.col("s")
    text = F.format_string("1. At step %d it peaks at %.1f, near the end.\nFrom steps 3 to 7 and 12 it holds %.1f, 40%% of all. The y-axis ranges from 0 to 500.", S.argmax(s), F.array_max(s), S.mean(s))
    m = user_series(spark, sf).select("id", Q.caption_measures(text, s).alias("m"))
    return m.select("id", "m.anchors", "m.prose", r("m.coverage").alias("coverage"), r("m.entropy").alias("entropy"), "m.claims", r("m.gap", 5).alias("gap"), r("m.outside").alias("outside"), r("m.gap_bare", 5).alias("gap_bare"), r("m.outside_bare").alias("outside_bare"))


_CLOSE = "({o} IS NOT NULL AND len(list_filter(range(1, len(s) + 1), lambda i: NOT abs({z}[i] - {o}[i]) <= 1e-8 + 1e-5 * abs({o}[i]))) = 0)"
_MOVED = "len(list_filter(range(1, len(s) + 1), lambda i: abs({z}[i] - s[i]) > 1e-9)) / len(s)"
_BLOCK = "s[len(s) * {q} // 4 + 1:len(s) * ({q} + 1) // 4]"
_SWAPS = " ".join("WHEN {} THEN {}".format(n, "list_concat(list_concat({}, {}), list_concat({}, {}))".format(*(_BLOCK.format(q=j if q == i else i if q == j else q) for q in range(4)))) for n, (i, j) in enumerate(U.QUARTER_PAIRS))


@R.add(f"""WITH {SERIES}, forms AS (SELECT id, f, CASE f WHEN 'own' THEN s WHEN 'steps' THEN list_transform(s, lambda x: floor(x / 100)) WHEN 'mirror' THEN list_concat(s[1:8], list_reverse(s[1:8])) ELSE list_transform(s, lambda x: 1.0) END AS s FROM series, (VALUES ('own'), ('steps'), ('mirror'), ('constant')) t(f)),
drawn AS (SELECT id, f, t, list(x ORDER BY md5(id || ':' || f || ':' || t || ':' || pos), pos) AS z FROM (SELECT id, f, unnest(s) AS x, unnest(range(0, len(s))) AS pos FROM forms), unnest(range(0, 20)) a(t) GROUP BY id, f, t),
shuffles AS (SELECT id, f, arg_min(z, t) AS shuffle FROM (SELECT d.*, s FROM drawn d JOIN forms USING (id, f)) WHERE {_MOVED.format(z="z")} >= 0.25 GROUP BY id, f),
turned AS (SELECT id, f, s, shuffle, CASE WHEN {_MOVED.format(z="list_reverse(s)")} >= 0.25 AND NOT {_CLOSE.format(z="list_reverse(s)", o="shuffle")} THEN list_reverse(s) END AS reverse FROM forms LEFT JOIN shuffles USING (id, f)),
pairs AS (SELECT *, md5(id || ':' || f || ':pair:' || p) AS h, CASE p {_SWAPS} END AS z FROM turned, unnest(range(0, 6)) a(p) WHERE len(s) >= 8),
swaps AS (SELECT id, f, arg_min(z, h) AS swap FROM pairs WHERE {_MOVED.format(z="z")} >= 0.25 AND NOT {_CLOSE.format(z="z", o="shuffle")} AND NOT {_CLOSE.format(z="z", o="reverse")} GROUP BY id, f),
k AS (SELECT id, f, 'shuffle' AS kind, s, shuffle AS z FROM turned UNION ALL SELECT id, f, 'reverse', s, reverse FROM turned UNION ALL SELECT id, f, 'segment_swap', s, swap FROM turned LEFT JOIN swaps USING (id, f))
SELECT id, f AS form, kind, CASE WHEN z IS NOT NULL THEN round({_MOVED.format(z="z")}, 6) END AS moved, md5(array_to_string(list_transform(z, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ' ')) AS points, z IS NULL OR {_MOVED.format(z="z")} >= 0.25 AS enough, true AS apart FROM k""")
def valid_perturbations(spark, sf):
    """WIN29: shuffled, reversed and swapped distractors with a quarter moved at least, none like another; of series, coarse, mirrored and constant ones."""
    s = F.col("s")
    forms = {"own": s, "steps": F.transform(s, lambda x: F.floor(x / 100).cast("double")), "mirror": F.concat(F.slice(s, 1, 8), F.reverse(F.slice(s, 1, 8))), "constant": F.transform(s, lambda x: F.lit(1.0))}
    rows = user_series(spark, sf).select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("form"), c.alias("s")) for n, c in forms.items()))).alias("f")).select("id", "f.form", "f.s")
    made = rows.select("id", "form", "s", U.perturbed(s, F.concat_ws(":", F.col("id").cast("string"), "form")).alias("p"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").alias("z")) for k in U.KINDS)))
    alike = [F.coalesce(U.close(F.col(f"p.{a}"), F.col(f"p.{b}")), F.lit(False)) for i, a in enumerate(U.KINDS) for b in U.KINDS[:i]]
    out = made.select("id", "form", "s", (~(alike[0] | alike[1] | alike[2])).alias("apart"), kinds.alias("k"))
    share = U.moved(F.col("k.z"), s)
    points = F.md5(F.array_join(F.transform("k.z", lambda x: F.round(x * 100).cast("long").cast("string")), " "))
    return out.select("id", "form", "k.kind", r(F.when(F.col("k.z").isNotNull(), share)).alias("moved"), points.alias("points"), (F.col("k.z").isNull() | (share >= U.MOVED)).alias("enough"), "apart")


@R.add(f"WITH {SERIES} SELECT id, CAST(id % 10 + 1 AS BIGINT) AS channels, id % 10 + 1 > 8 AS truncated, '89504E470D0A1A0A' AS head FROM series")
def channel_charts(spark, sf):
    """SRC51: charts of one to ten channels: eight panels at most, and whether channels were left out."""
    s = F.col("s")
    kinds = F.array(s, F.reverse(s), S.diffs(s), S.centred(s), S.z_normalised(s), S.quantised(s), F.slice(s, 1, 12), S.resampled(s, 16), S.detrended(s), S.block_means(s))
    rows = user_series(spark, sf).select("id", F.slice(kinds, F.lit(1), (F.col("id") % 10 + 1).cast("int")).alias("c"))
    drawn = rows.select("id", F.size("c").cast("long").alias("channels"), K.multi_chart("c").alias("x"))
    return drawn.select("id", "channels", "x.truncated", F.substr(F.hex("x.image"), F.lit(1), F.lit(16)).alias("head"))


@R.add("SELECT conv_id, turn, nullif(regexp_extract(coalesce(text, ''), '([A-I])', 1), '') AS letter FROM conversations")
def easy_letters(spark, sf):
    """SCL15: the first capital A to I anywhere in a reply."""
    return table(spark, sf, "conversations").select("conv_id", "turn", X.easy_letter(F.coalesce("text", F.lit(""))).alias("letter"))


@R.add("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id AS request, worker, CAST(count(*) AS BIGINT) AS n, min(turn) AS first, max(turn) AS last FROM (SELECT *, CAST(floor(place / ceil(n / 3.0)) AS BIGINT) AS worker FROM t) GROUP BY ALL")
def worker_chunks(spark, sf):
    """STM2: each request's rows in equal neighbouring chunks for three workers."""
    rows = W.chunked(table(spark, sf, "conversations").select(F.col("conv_id").alias("request"), "turn"), "turn", 3)
    return rows.groupBy("request", F.col("worker").cast("long").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@R.add(f"""WITH {SERIES}, c AS (SELECT id, id % 3 AS split, s, 'series ' || id || ' ends at ' || printf('%.2f', s[len(s)]) AS caption, md5('ring:' || id) AS h FROM series),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, id) - 1 AS place, count(*) OVER (PARTITION BY split) AS n FROM c)
SELECT a.id, '' AS none, b.caption AS permuted, {", ".join(f"array_to_string(list_transform(range(0, {k}), lambda i: printf('%.2f', a.s[CAST(round_even(i * (len(a.s) - 1) / {k - 1}.0, 0) AS BIGINT) + 1])), ', ') AS points{k}" for k in (8, 16))} FROM p a JOIN p b ON a.split = b.split AND b.place = (a.place + 1) % a.n""")
def caption_controls(spark, sf):
    """UDF13: controls of a caption: none, another one of the same split in a keyed ring, and 8 or 16 points of the series."""
    s = F.col("s")
    rows = user_series(spark, sf).select("id", (F.col("id") % 3).alias("split"), "s", F.concat(F.lit("series "), F.col("id").cast("string"), F.lit(" ends at "), F.format_string("%.2f", F.element_at(s, -1))).alias("caption"), keyed_order(F.lit("ring"), F.col("id")).alias("h"))
    ring = placed(rows, ["split"], ["h", "id"])
    nxt = ring.select("split", F.pmod(F.col("place") - 1, F.col("size")).alias("place"), F.col("caption").alias("permuted"))
    points = lambda k: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.format_string("%.2f", F.element_at(s, (F.bround(i * (F.size(s) - 1) / F.lit(float(k - 1))) + 1).cast("int")))), ", ")
    return ring.join(nxt, ["split", "place"]).select("id", F.lit("").alias("none"), "permuted", points(8).alias("points8"), points(16).alias("points16"))
