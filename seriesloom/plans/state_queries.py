"""Queries over state, sources and sinks: streams that restart, channel files, buffers, published versions, columns out of paths, benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources import channels as H
from ..sources import published as V
from ..sources import readers as D
from ..streaming import shuffle as B
from ..streaming import state as W
from .base import Registry, table

R = Registry()


def r(c, digits=6):
    return F.round(c, digits)


@R.add(r"""WITH q AS (SELECT 'r' || (conv_id % 3) AS reader, chr(65 + CAST(turn % 4 AS INTEGER)) AS gold, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '<answer>' || chr(65 + CAST(conv_id % 4 AS INTEGER)) || '</answer> ' || text ELSE 'It is ' || chr(65 + CAST((conv_id + turn) % 4 AS INTEGER)) || '. ' || text END AS reply FROM conversations),
p AS (SELECT *, coalesce(upper(nullif(regexp_extract(reply, '(?is)<answer>\s*([A-D])\s*</answer>', 1), '')), nullif(regexp_extract(regexp_replace(reply, '^\s+|\s+$', '', 'g'), '(?s)^\W*([A-D])\W*$', 1), ''), nullif(regexp_extract(reply, '\b([A-D])\b', 1), '')) AS letter FROM q),
s AS (SELECT reader, CAST(count(*) AS BIGINT) AS calls, CAST(count(letter) AS BIGINT) AS parsed, CAST(count(*) FILTER (WHERE regexp_matches(reply, '(?is)<answer>\s*[A-D]\s*</answer>')) AS BIGINT) AS tagged, CAST(count(*) FILTER (WHERE letter = gold) AS DOUBLE) AS rewarded FROM p GROUP BY reader),
k AS (SELECT reader, letter, CAST(count(*) AS BIGINT) AS picks FROM p WHERE letter IS NOT NULL GROUP BY reader, letter)
SELECT * FROM s LEFT JOIN k USING (reader)""")
def streamed_totals(spark, sf):
    """STM8 STM9: totals and picks of each reader kept by a stateful stream over files of replies; it is stopped half-way and goes on from its checkpoint."""
    t, c = F.col("turn"), F.col("conv_id")
    reply = F.when(t % 3 == 0, F.col("text")).when(t % 3 == 1, F.concat(F.lit("<answer>"), F.char(65 + c % 4), F.lit("</answer> "), "text")).otherwise(F.concat(F.lit("It is "), F.char(65 + (c + t) % 4), F.lit(". "), "text"))
    rows = table(spark, sf, "conversations").select(c.alias("request"), F.concat(F.lit("r"), (c % 3).cast("string")).alias("reader"), reply.alias("reply"), F.char(65 + t % 4).alias("gold"))
    source, log, checkpoint = (D.scratch(spark, f"totals-{n}") for n in ("replies", "log", "state"))
    for half in (0, 1):
        rows.where(F.pmod(F.xxhash64("request", "gold"), F.lit(2)) == half).write.mode("append").parquet(source)
        W.keep_totals(spark, source, rows.schema.simpleString()[7:-1].replace(":", " "), log, checkpoint)
    return W.totals_so_far(spark, log)


@R.add("SELECT e.event_id AS id, 'letter_exact' AS scoring, chr(65 + CAST(e.event_id % 4 AS INTEGER)) AS gold, round(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))), 3) AS total FROM events e JOIN embeddings v ON e.user_id = v.vec_id")
def channel_questions(spark, sf):
    """SRC14 SRC36: questions joined to channels of binary files, which hold 64 vectors each; only channels that are asked for are read."""
    path = D.scratch(spark, "channels")
    vectors = table(spark, sf, "embeddings").select(F.expr("vec_id div 64").alias("file"), (F.col("vec_id") % 64).cast("int").alias("channel"), F.col("embedding").cast("array<double>").alias("values"))
    held = vectors.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("channel", "values"))).alias("m"))
    H.write_channels(held.select("file", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.try_element_at("m", i)).alias("channels")), path)
    i = F.col("user_id")
    qa = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("user_id div 64").alias("file"), (i % 64).cast("int").alias("channel"), F.lit("Which?").alias("question"), F.char(65 + F.col("event_id") % 4).alias("gold"))
    asked = [x["channel"] for x in qa.select("channel").distinct().collect()]  # 64 at most
    channels = H.channel_table(spark, path, asked).where(F.size("values") > 0)
    got = A.channel_questions(qa, channels)
    return got.select("id", "scoring", "gold", r(F.aggregate(F.col("series")[0], F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@R.add("SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def buffered_turns(spark, sf):
    """STM12: turns in the order in which they leave a buffer of 64 rows; the rows are the same."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text"))
    return B.buffer_shuffled(c, 64, seed=7)


@R.add("SELECT CAST(1 AS INTEGER) AS version, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 UNION ALL SELECT CAST(2 AS INTEGER), CAST(count(*) AS BIGINT), round(sum(c_acctbal), 2) FROM customer UNION ALL SELECT CAST(0 AS INTEGER), CAST(count(*) AS BIGINT), round(sum(c_acctbal), 2) FROM customer")
def published_versions(spark, sf):
    """SRC47 SRC49 FLT19: a table published twice behind one manifest: the current version (0), and both by number."""
    root = D.scratch(spark, "published")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    V.publish(c.where("c_acctbal > 0"), root, {"name": "customers"})
    V.publish(c, root, {"name": "customers"})
    parts = [V.published(spark, root, v).select(F.lit(v or 0).alias("version"), "c_acctbal") for v in (None, 1, 2)]
    both = parts[0].union(parts[1]).union(parts[2])
    return both.groupBy("version").agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("total"))


@R.add("SELECT l_orderkey AS id, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 1000) GROUP BY 1")
def limited_ids(spark, sf):
    """SRC1: rows of the first 1,000 ids of a source that repeats them, found in its first files, with its wide column left out."""
    path = D.scratch(spark, "ids")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_comment" if "l_comment" in table(spark, sf, "lineitem").columns else F.lit("").alias("l_comment"))
    rows.repartitionByRange(16, "l_orderkey").write.parquet(path)
    got, _ = D.first_ids(spark, path, "l_orderkey", 1000, drop=["l_comment"])
    return got.groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), 2).alias("price"))


@R.add("SELECT lower(c_mktsegment) AS arm, 'k' || (c_nationkey % 4) AS control, CAST(c_nationkey AS INTEGER) AS seed, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def path_columns(spark, sf):
    """SRC21 SRC22 SRC23: columns out of folder and file names: arm, control and seed of files of metrics."""
    path = D.scratch(spark, "runs")
    c = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("arm"), F.concat(F.lit("k"), (F.col("c_nationkey") % 4).cast("string")).alias("control"), F.col("c_nationkey").cast("int").alias("seed"), "c_acctbal")
    c.groupBy("arm", "control", "seed").agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("total")).repartition("arm").write.partitionBy("arm", "control", "seed").json(path)
    rows = spark.read.schema("n long, total double").option("recursiveFileLookup", True).json(path).select("n", "total", F.col("_metadata.file_path").alias("path"))
    names = D.from_path(F.col("path"), r"arm=([^/]+)/control=([^/]+)/seed=(\d+)/", ["arm", "control", "seed"])
    return rows.select(*names, "n", "total").withColumn("seed", F.col("seed").cast("int"))


@R.add("""WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'tf_exact' ELSE 'letter_exact' END AS scoring, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'B' END AS gold, CASE WHEN o_orderkey % 2 = 0 THEN 'recognition' ELSE 'choice' END AS task, round(c_acctbal + c_nationkey, 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0),
b AS (SELECT doc_id || '-' || n AS id, scoring, gold, task, round(CAST(n_chars AS DOUBLE), 2) AS total FROM documents, (VALUES (0, 'letter_flexible', 'up', 'trend'), (1, 'numeric_tolerance', '12', 'season')) v(n, scoring, gold, task)),
c AS (SELECT (conv_id % 5) || '/' || conv_id || '.png#' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id, 'letter_exact' AS scoring, chr(65 + CAST(turn % 4 AS INTEGER)) AS gold, NULL AS task, round(CAST(conv_id AS DOUBLE), 2) AS total FROM conversations)
SELECT 'annotated' AS benchmark, * FROM a UNION ALL SELECT 'abilities', * FROM b UNION ALL SELECT 'by_path_suffix', * FROM c""")
def benchmark_items(spark, sf):
    """SRC29 SRC30 SRC32 SRC33: items of three benchmarks through one iterator: annotations joined to series by uid, an item for each ability with a scorer, questions joined to fragments by the end of a path."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    even = F.col("o_orderkey") % 2 == 0
    items = o.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("uid"), F.when(even, "recognition").otherwise("choice").alias("task"), F.col("o_orderpriority").alias("description"), F.when(even, "T").otherwise("B").alias("gold"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.col("o_orderstatus").alias("dataset"))
    series = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("uid"), F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("series"))
    d = table(spark, sf, "documents")
    tasks = d.select(F.col("doc_id").alias("id"), F.lit("Describe it").alias("question"), F.array(F.array(F.col("n_chars").cast("double"))).alias("series"), F.array(F.lit("trend"), F.lit("season"), F.lit("poetry")).alias("ability"), F.array(F.lit("up"), F.lit("12"), F.lit("-")).alias("answer"))
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.struct(F.col("turn").alias("n"), F.lit("Which?").alias("question"), F.char(65 + F.col("turn") % 4).alias("answer")).alias("q"))
    end = F.concat((F.col("conv_id") % 5).cast("string"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".png"))
    messages = talk.groupBy("conv_id").agg(F.array_sort(F.collect_list("q")).alias("qa")).select(F.concat(F.lit("/data/a/"), end).alias("image"), "qa")
    fragments = talk.select("conv_id").distinct().select(F.concat(F.lit("b/"), end).alias("image_path"), F.array(F.col("conv_id").cast("double")).alias("series"))
    parts = {"annotated": A.annotated(items, series), "abilities": A.abilities(tasks, {"trend": "letter_flexible", "season": "numeric_tolerance"}), "by_path_suffix": A.by_path_suffix(messages, fragments)}
    got = A.all_items(parts)
    return got.select("benchmark", "id", "scoring", "gold", "task", r(F.aggregate(F.col("series")[0], F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@R.add("""SELECT 'annotated' AS benchmark, CAST(count(*) AS BIGINT) AS asked, CAST(count(c_custkey) AS BIGINT) AS items, CAST(count(*) - count(c_custkey) AS BIGINT) AS skipped FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
UNION ALL SELECT 'typed_questions', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE event_type IN ('click', 'view')) AS BIGINT), CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS BIGINT) FROM events""")
def skipped_items(spark, sf):
    """SRC29 FLT5: items asked, kept and skipped of each benchmark: those without a series, and those without a scorer."""
    even = F.col("o_orderkey") % 2 == 0
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("uid"), F.when(even, "recognition").otherwise("choice").alias("task"), F.lit("d").alias("description"), F.lit("T").alias("gold"), F.array(F.lit("x")).alias("options"), F.lit("s").alias("dataset"))
    series = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("uid"), F.array("c_acctbal").alias("series"))
    typed = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("Which?").alias("question"), F.lit("A").alias("answer"), F.col("event_type").alias("question_type"), F.lit("[1, 2]").alias("series"))
    return A.skip_counts({"annotated": (items, A.annotated(items, series)), "typed_questions": (typed, A.typed_questions(typed, {"click": "letter_exact", "view": "tf_exact"}))})
