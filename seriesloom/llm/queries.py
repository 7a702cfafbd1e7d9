"""The registered queries ``opN_<name>``: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, remove, shared_dir


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import MIN_BLOCKED, judge_urls

    judged = judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), read_table(spark, sf_dir, "labels"), min_blocked=MIN_BLOCKED)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import LARGE_CACHE

    return pack_documents(read_table(spark, sf_dir, "documents"), cache=LARGE_CACHE)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary import read_documents, write_token_files

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    found = materialise(read_documents(spark, path), "token-rows")
    remove(spark, path)
    return found


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_sort("item_ids")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words as the contract has them, A-Z lower-cased.
_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM windows),
docs AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS ws FROM documents),
grams AS (
  SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(ws) - m + 2)) AS r(i)),
hits AS (SELECT doc_id, i, g.m AS m, item_id FROM grams g JOIN windows w ON g.gram = w.gram AND g.m = w.m),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, m)) AS r(k) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score, train

    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers without ``+`` and secrets pass unchanged; the key is that of the session, or random."""
    from .pii import KINDS, key_of, pseudonymise

    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return pseudonymise(docs, key_of(spark)).select("doc_id", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS), "text")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k, valid_vectors

    vectors = valid_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("id % 100 = 0"), vectors)


OP9_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(read_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_repeated_lines

    found = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
  SELECT row_no, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_no, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeats AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT row_no, l.doc_id, line, i, coalesce(l.doc_id <> r.first, false) AS gone FROM lines l LEFT JOIN repeats r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_no
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_interactions

    return filter_interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
flags AS (
  SELECT doc_id, part,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM words),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM flags f LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
judged AS (
  SELECT part, filter_order, step, o[step] AS f, good, toxic, fails[o[step]] AS failing,
    len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM docs, steps),
counted AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT failing AND NOT earlier) AS kept, count(*) FILTER (failing AND NOT earlier) AS removed,
    count(*) FILTER (failing AND earlier) AS redundant, count(*) FILTER (failing AND n_fails = 1) AS unique_fails,
    count(*) FILTER (failing AND NOT earlier AND good) AS good_lost, count(*) FILTER (failing AND NOT earlier AND toxic) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    made = manifest(read_table(spark, sf_dir, "documents"), struck, {"n_chars": F.col("n_chars") + 1})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Unsigned crc32 of a column's decimal text.
_SQL_CRC32 = """xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), 4294967295), 4294967295)"""


def _sql_leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN {_SQL_CRC32.format("doc_id")} % 7 = 0 THEN {_sql_leaf("(n_chars + 1)")} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS node FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2),
subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS level, place, n, node FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY level, place // 2),
folds AS (
  SELECT row_no, tree, 0 AS level, place, n, coalesce(changed, leaf) AS node, '' AS proof FROM placed
  UNION ALL
  SELECT row_no, f.tree, f.level + 1, f.place // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.place % 2 = 1 THEN s.node || f.node ELSE f.node || coalesce(s.node, '') END), f.proof || coalesce(s.node, '')
  FROM folds f LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.place = xor(f.place, 1) WHERE f.n > 1),
higher AS (
  SELECT row_no, 0 AS level, r.place, r.n, f.node, f.proof FROM folds f JOIN subroots r USING (tree) WHERE f.n = 1
  UNION ALL
  SELECT row_no, h.level + 1, h.place // 2, (h.n + 1) // 2,
    sha256(CASE WHEN h.place % 2 = 1 THEN s.node || h.node ELSE h.node || coalesce(s.node, '') END), h.proof || coalesce(s.node, '')
  FROM higher h LEFT JOIN crown s ON s.level = h.level AND s.place = xor(h.place, 1) WHERE h.n > 1)
SELECT p.doc_id, p.leaf, r.node AS subroot, t.node AS root, sha256(h.proof) AS proof_sha256, h.node AS folded_root, h.node = t.node AS verified
FROM placed p JOIN subroots r USING (tree) JOIN higher h ON h.row_no = p.row_no AND h.n = 1 JOIN crown t ON t.n = 1
"""


_OPERATORS = (op1_url_filters, op2_best_fit_packing, op3_benchmark_decontamination, op4_suffix_array_dedup, op5_simhash_near_dedup, op6_token_binary, op7_toxicity)
_OPERATORS += (op8_pii_pseudonyms, op9_exact_top_k, op10_lm_scoring, op11_line_dedup, op12_filter_audit, op13_merkle_manifest)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLE_SQL = {"op3_benchmark_decontamination": OP3_SQL, "op9_exact_top_k": OP9_SQL, "op11_line_dedup": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
