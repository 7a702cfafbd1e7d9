"""URL filters: fixed host rules first, then association rules mined from labels.

DataFrame functions and Spark's FP-growth only.  A URL becomes a set of tokens
(scheme, host names, site, path names, extension, query keys).  FP-growth mines
the tokens of labelled URLs together with a block mark.  Tokens in nearly all
labelled URLs or in too few of those to block are left out, and tokens of exactly
the same labelled URLs count as one (the first by name), so that no template of
tokens that always come together multiplies itemsets.  Rules "tokens -> block"
stay if they reach the support wanted, a share of the labelled URLs and
``min_blocked`` of them at least, if their confidence is ``min_confidence`` and
``min_lift`` times the share of URLs to block at least, and if no rule on fewer
of their tokens is as confident.  With ``significant`` the lower end of the confidence's 95 % interval
must reach that bound: then labels that URLs do not tell of give no rules.  An inverted index
maps each rule's least frequent token to the rule's other tokens; a URL is blocked
if a rule found through one of its tokens has all its tokens there.  Up to
``INDEX_RULES`` rules the index is a folded map literal, so judging is one pass
without a shuffle; more rules are joined on the indexed token.

A null URL or one without "://" has empty host and path, no tokens and the
verdict allow.  Repeated rows are judged alike.  Repeated labels of an id count
as block if one of them does; null labels do not.  Without labelled URLs no rule
is mined.  Extra columns are dropped by the query and kept by ``judge_urls``, but
for host, path, rule and verdict, which it replaces.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "=block"
INDEX_RULES = 4096
#: A token in a larger share of the labelled URLs tells nothing.
COMMON = 0.9
#: A rule's labelled URLs to block: at least this share of all labelled ones, and for the query so many; its confidence, and that against the share to block.
MIN_SUPPORT, MIN_BLOCKED, MIN_CONFIDENCE, MIN_LIFT = 0.005, 5, 0.5, 1.5
#: (host, path, verdict)
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def url_tokens(url: Column) -> Column:
    """Distinct tokens; numbers in paths are all alike."""
    host, path = url_parts(url)
    lower = F.lower(url)
    names = F.filter(F.split(host, r"\."), lambda x: x != "")
    site = F.array_join(F.slice(names, -2, 2), ".")
    parts = F.filter(F.split(F.lower(path), r"[/._\-]+"), lambda x: x != "")
    words = F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), "#").otherwise(x))
    keys = F.transform(F.filter(F.split(F.regexp_extract(lower, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.substring_index(x, "=", 1))
    tokens = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))),
        F.transform(names, lambda x: F.concat(F.lit("host:"), x)),
        F.when(F.size(names) >= 2, F.array(F.concat(F.lit("site:"), site))).otherwise(F.array().cast("array<string>")),
        F.transform(words, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def _lowest(p: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval of a share ``p`` of ``n``."""
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _telling(baskets: DataFrame, total: int, least: float) -> list[str]:
    """Tokens that are worth mining: each basket has few, so these are some tokens a basket over the support at most."""
    tokens = baskets.select("id", "block", F.explode("items").alias("token"))
    alike = F.sum(F.xxhash64("id").cast("decimal(38,0)"))
    tokens = tokens.groupBy("token").agg(F.count("id").alias("n"), F.count(F.when(F.col("block"), 1)).alias("bad"), alike.alias("where"))
    tokens = tokens.where((F.col("n") <= COMMON * total) & (F.col("bad") >= least))
    return [r["token"] for r in tokens.groupBy("n", "where").agg(F.min("token").alias("token")).collect()]


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_blocked: int = 1, significant: bool = False) -> DataFrame:
    """(items, confidence, support) of rules to block, of any length, but for those that a part of their items is as sure of. ``labelled``: url, block (boolean)."""
    spark = labelled.sparkSession
    baskets = labelled.select(url_tokens(F.col("url")).alias("items"), F.coalesce("block", F.lit(False)).alias("block"))
    baskets = materialise(baskets.where(F.size("items") > 0).withColumn("id", F.monotonically_increasing_id()), "baskets")
    total, bad = baskets.agg(F.count("id"), F.count(F.when(F.col("block"), 1))).first()
    least = max(min_support * total, min_blocked)
    telling = _telling(baskets, total, least) if bad else []
    if not telling:
        return spark.createDataFrame([], "items array<string>, confidence double, support double")
    own = F.array_intersect("items", F.array(*map(F.lit, telling)))
    marked = baskets.select(F.when(F.col("block"), F.concat(own, F.array(F.lit(BLOCK)))).otherwise(own).alias("items"))
    sets = materialise(FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total)).fit(marked).freqItemsets, "itemsets")
    with_mark = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("items"), F.col("freq").alias("bad"))
    rules = with_mark.join(sets.where(~F.array_contains("items", BLOCK)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "items")
    rules = rules.select("items", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(total)).alias("support"), "n")
    sure = _lowest(F.col("confidence"), F.col("n")) if significant else F.col("confidence")
    rules = materialise(rules.withColumn("sure", (F.col("confidence") >= min_confidence) & (sure >= min_lift * bad / total)).drop("n"), "rules")
    longest = rules.agg(F.coalesce(F.max(F.size("items")), F.lit(0))).first()[0]
    # unsure rules too: they carry the best confidence of their parts on to longer ones
    kept = rules.where((F.size("items") == 1) & F.col("sure")).drop("sure")
    best = rules.where(F.size("items") == 1).select(F.col("items").alias("part"), F.col("confidence").alias("top"))
    for size in range(2, longest + 1):
        parts = rules.where(F.size("items") == size).withColumn("part", F.explode(F.transform("items", lambda x: F.array_remove("items", x))))
        level = parts.join(best, "part", "left").groupBy("items", "confidence", "support", "sure").agg(F.coalesce(F.max("top"), F.lit(0.0)).alias("below"))
        level = materialise(level, "level")
        kept = kept.union(level.where(F.col("sure") & (F.col("confidence") > F.col("below"))).select("items", "confidence", "support"))
        best = level.select(F.col("items").alias("part"), F.greatest("confidence", "below").alias("top"))
    return kept


def _index(rules: DataFrame) -> DataFrame:
    """(rule, token, rest): each rule under the token that the fewest rules hold."""
    held = rules.select(F.xxhash64("items").alias("rule"), "items")
    tokens = held.select("rule", "items", F.explode("items").alias("token"))
    often = tokens.groupBy("token").count()
    first = Window.partitionBy("rule").orderBy("count", "token")
    return tokens.join(often, "token").withColumn("n", F.row_number().over(first)).where("n = 1").select("rule", "token", F.array_remove("items", F.col("token")).alias("rest"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=HOST_RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_blocked: int = 1, significant: bool = False) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``labels``: (doc_id, quality, toxic) of pages by page_id; low quality or toxic is to block."""
    bad = F.max((F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("int")) == 1
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("block"))
    labelled = pages.select("page_id", "url").where("url is not null").join(marks, "page_id").select("url", "block")
    index = materialise(_index(mine_rules(labelled, min_support, min_confidence, min_lift, min_blocked, significant)), "index")
    tokens = url_tokens(F.col("url"))
    own, hits = free_name(pages.columns, "own_tokens"), free_name(pages.columns, "own_hit")
    if index.count() <= INDEX_RULES:
        found = index.groupBy("token").agg(F.collect_list("rest").alias("rests")).collect()  # of INDEX_RULES rules at most
        if found:
            table = F.map_from_arrays(F.array(*(F.lit(r["token"]) for r in found)), F.array(*(F.array(*(F.array(*(F.lit(x) for x in rest)).cast("array<string>") for rest in r["rests"])) for r in found)))
            hit = F.exists(own, lambda t: F.coalesce(F.exists(F.try_element_at(table, t), lambda rest: F.size(F.array_except(rest, own)) == 0), F.lit(False)))
            judged = pages.withColumn(own, tokens).withColumn(hits, hit).drop(own)
        else:
            judged = pages.withColumn(hits, F.lit(False))
    else:
        urls = pages.select("url").where("url is not null").distinct().withColumn("tokens", tokens)
        posted = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
        blocked = posted.where(F.size(F.array_except("rest", "tokens")) == 0).select("url").distinct().withColumn(hits, F.lit(True))
        judged = pages.join(blocked, "url", "left").withColumn(hits, F.coalesce(hits, F.lit(False)))
    host, path = url_parts(F.col("url"))
    judged = judged.withColumns({"host": host, "path": path})
    rule, verdict = host_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col(hits), "block").otherwise("allow"))}).drop(hits)
