"""The pipeline's stages, one after the other and on odd rows, and the registered queries against brute force."""

import collections
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from seriesloom.llm.queries import ORACLE_SQL, QUERIES

from conftest import SF
from test_operators import BENCH, DOCS, brute_components, brute_fingerprint, brute_hits, brute_wide

from seriesloom.llm import pii, simhash, urls
from seriesloom.llm.tokens import Encoder, default_tokenizer


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, left = docs.columns, docs
    for name, stage in pipe.STAGES[:-1]:
        before = left.count()
        left = stage(spark, left, SF).cache()
        assert left.columns == columns and 0 < left.count() <= before, name
        if name == "toxicity":
            kept = {r["doc_id"] for r in left.collect()}
            gone = set(labels) - kept
            assert gone and all(labels[i] for i in gone)
        if name == "simhash_near_dedup":
            texts = [r["text"] for r in left.collect()]
            assert len(set(brute_components([brute_wide(t) for t in texts], simhash.WIDE_RADIUS))) == len(texts)
        if name == "benchmark_decontamination":
            from seriesloom.llm.decontaminate import find_contamination

            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert find_contamination(left, bench).where("n_hit > 0").count() == 0
        if name == "pii":
            assert left.where("n_chars <> length(text)").count() == 0
    packed = pipe.STAGES[-1][1](spark, left, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, pii string, own_hits int, words int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Odd documents (null, empty, long, repeated, without id) with columns of names that operators use, and their tables."""
    path = f"file://{tmp_path_factory.mktemp('odd')}"
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, 2, "x", 3, 4) for i, t in DOCS], COLUMNS).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 8)) for i, _ in DOCS if i is not None] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = collections.Counter(map(tuple, docs.collect()))
    stages = dict(pipe.STAGES)
    kept = stages["toxicity"](spark, docs, odd)
    assert kept.columns == docs.columns and not collections.Counter(map(tuple, kept.collect())) - rows
    assert {r["doc_id"] for r in kept.collect()} >= {3, 4, 5}  # nothing in them is toxic
    one = stages["simhash_near_dedup"](spark, docs, odd)
    assert one.columns == docs.columns and not collections.Counter(map(tuple, one.collect())) - rows
    assert one.count() == len(set(brute_components([brute_wide(t) for _, t in DOCS], simhash.WIDE_RADIUS)))
    clean = stages["benchmark_decontamination"](spark, docs, odd)
    assert clean.columns == docs.columns
    left = collections.Counter(r["doc_id"] for r in clean.collect())
    want = collections.Counter()
    for i, t in DOCS:
        n, hit, _ = brute_hits(t, BENCH)
        want[i] += len(hit) <= 0.8 * n or not hit
    assert left == +want
    masked = stages["pii"](spark, docs, odd)
    assert masked.schema == docs.schema and masked.count() == len(DOCS) and masked.where("n_chars <> length(text)").count() == 0
    packed = stages["best_fit_packing"](spark, docs, odd)
    assert collections.Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == collections.Counter(i for i, _ in DOCS)


def test_stages_on_an_empty_table(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, odd)
        assert out.count() == 0, name
        assert name == "best_fit_packing" or out.columns == docs.columns, name


def test_run(spark):
    assert pipe.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())


def documents(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def rows_of(df, *cols):
    return collections.Counter(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_queries_by_brute_force(spark, odd, table):
    """The digest columns of the queries that SQL cannot express."""
    path = odd if table == "odd" else SF
    docs, enc = documents(spark, path), Encoder(default_tokenizer()).tokenizer
    ids = {t: enc.encode(t or "", add_special_tokens=False).ids for _, t in docs}
    # op2
    want = collections.Counter()
    for i, t in docs:
        own = np.array([*ids[t], 0], "<u4")
        for k in range(0, len(own), 2048):
            want[i, k // 2048, k, len(own[k : k + 2048]), zlib.crc32(own[k : k + 2048].tobytes())] += 1
    packed = QUERIES["op2_best_fit_packing"](spark, path)
    assert rows_of(packed, "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = collections.defaultdict(list)
    for r in packed.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 2048
    # op4
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(hash(t[k : k + 200]) for _, t in texts for k in range(len(t) - 199))
    want = collections.Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[hash(t[k : k + 200])] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    assert rows_of(QUERIES["op4_suffix_array_dedup"](spark, path), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    # op5
    prints = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(prints, 4)
    least = {r: min((i for (i, _), x in zip(docs, roots) if x == r and i is not None), default=None) for r in set(roots)}
    want = collections.Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(docs, prints, roots))
    assert rows_of(QUERIES["op5_simhash_near_dedup"](spark, path), "doc_id", "fingerprint", "component_id") == want
    # op6
    got = QUERIES["op6_token_binary"](spark, path).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in docs)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((i, len(ids[t]) + 1, zlib.crc32(np.array([*ids[t], 2], "<u4").tobytes())) for i, t in docs)
    # op7
    held = lambda i, n, k: i is None or zlib.crc32(str(i).encode()) % n == k
    scored = QUERIES["op7_toxicity"](spark, path).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["predicted"]) for r in scored) == collections.Counter((r["doc_id"], held(r["doc_id"], 5, 0), int(r["score"] >= 0.5)) for r in scored)
    assert collections.Counter(r["doc_id"] for r in scored) == collections.Counter(i for i, _ in docs) and all(0 <= r["score"] <= 1 for r in scored)
    # op8
    spark.conf.set(pii.KEY_SETTING, "test")
    own, want = pii.Pseudonyms(b"test"), collections.Counter()
    for i, t in docs:
        text, counts = own.mask(t) if t else (t, dict.fromkeys(pii.KINDS, 0))
        want[i, text, *counts.values()] += 1
    assert rows_of(QUERIES["op8_pii_pseudonyms"](spark, path), "doc_id", "text", *(f"n_{k}" for k in pii.KINDS)) == want
    spark.conf.unset(pii.KEY_SETTING)
    # op10: what does not depend on the model
    parts = [(i, [*(t or "").encode().lower().split(), None]) for i, t in docs]
    c = collections.Counter(w for i, ws in parts if not held(i, 7, 2) for w in ws)
    n, v = sum(c.values()), len(c)
    lm = QUERIES["op10_lm_scoring"](spark, path)
    want = collections.Counter((i, held(i, 7, 2), len(ws), sum(c[w] > 0 for w in ws), n) for i, ws in parts)
    assert rows_of(lm, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens") == want
    base = sorted(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws) for _, ws in parts)
    assert sorted(r["base_score"] for r in lm.collect()) == pytest.approx(base, abs=1e-2)
    assert lm.where("score > 0 or score is null or isnan(score)").count() == 0


def test_url_query_by_brute_force(spark):
    import re

    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op1_url_filters"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    mined = plain_url_rules(spark, SF)
    tokens = {r["page_id"]: set(r["t"]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    for i, url in pages.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = sorted((-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, fits[0][1] if fits else None)
        assert r["verdict"] == (fits[0][2] if fits else "block" if any(x <= tokens[i] for x in mined) else "allow"), url


def plain_url_rules(spark, sf):
    """Token sets with the support and lift wanted, found by trying all sets of tokens of each URL to block; sets of tokens that always come together count by their first names."""
    bad = collections.defaultdict(bool)
    for i, quality, toxic in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect():
        bad[i] |= toxic == 1 or quality == 0
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()
    baskets = [(set(r["t"]), bad[r["page_id"]]) for r in rows if r["page_id"] in bad and r["t"]]
    total, to_block = len(baskets), sum(b for _, b in baskets)
    least = max(urls.MIN_SUPPORT * total, urls.MIN_BLOCKED)
    where = collections.defaultdict(list)
    for n, (own, _) in enumerate(baskets):
        for t in own:
            where[t].append(n)
    alike = {}
    for t in sorted(where):
        if len(where[t]) <= urls.COMMON * total and sum(baskets[n][1] for n in where[t]) >= least:
            alike.setdefault(tuple(where[t]), t)
    telling, sure, best = set(alike.values()), {}, {}
    for size in range(1, len(telling) + 1):
        for items in {frozenset(c) for own, b in baskets if b for c in itertools.combinations(sorted(own & telling), size)}:
            n, hits = sum(items <= own for own, _ in baskets), sum(items <= own and b for own, b in baskets)
            if hits < least or not to_block:
                continue
            below = max((best[p] for p in (items - {x} for x in items) if p in best), default=0.0)
            best[items] = max(below, hits / n)
            if hits / n >= max(urls.MIN_CONFIDENCE, urls.MIN_LIFT * to_block / total) and hits / n > below:
                sure[items] = hits / n
    return list(sure)


def test_url_query_where_urls_tell(spark, tmp_path):
    """Pages of one site with one path name are to block, and nothing else: the query finds that out."""
    url = lambda i: f"https://{('good', 'fine', 'bad')[i % 3]}.site{i % 2}.info/{('news', 'shop', 'spam')[i % 5 % 3]}/p{i}?id={i}"
    told = lambda i: i % 3 == 2 and i % 5 % 3 == 2
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, url(i), None) for i in range(400)] + [(400, None, None), (401, "no url", None)], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    spark.createDataFrame([(i, 1, int(told(i))) for i in range(300)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = {r["page_id"]: r["verdict"] for r in QUERIES["op1_url_filters"](spark, sf).collect()}
    assert got == {i: "block" if i < 400 and told(i) else "allow" for i in range(402)}


def test_queries_on_empty_tables(spark, odd, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{SF}/pages.parquet").limit(0).write.parquet(f"file://{tmp_path}/pages.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    for name, query in QUERIES.items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name


def test_all_are_registered(spark):
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
