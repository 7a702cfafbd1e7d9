"""Each operator on odd rows, against brute force; and on empty tables."""

import collections
import hashlib
import math
import os
import pathlib
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import attention, binary, decontaminate, graph, lm, packing, pii, simhash, suffix, topk, toxicity, urls
from seriesloom.llm.tokens import Encoder, default_tokenizer

BASE = "The quick brown fox jumps over the lazy dog while the old clock strikes nine in the cold evening air. " * 4
DOCS = [
    (0, BASE),
    (1, BASE),  # exact copy
    (2, BASE.replace("clock", "clack", 1) + " End."),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b"),
    (6, "short"),
    (7, "Ünïcode çà et là — <|endoftext|> <|ENDOFTEXT|> 漢字 ① it's 12,5!"),
    (None, "no id here but some words all the same"),
    (8, "one two three four five six seven eight nine ten eleven"),
    (9, "x " + "one two three four five six seven eight nine ten " * 3),
    (10, "word " * 6000 + "tail"),  # very long
    (11, "aaaa" * 300),
    (12, "dup row"),
    (12, "dup row"),
    (13, "Lone. " + "".join(chr(97 + (i * i * 7 + i // 5) % 26) for i in range(900))),
]
#: Columns whose names operators use inside.
EXTRA = "row long, h long, fp long, words long, n long, start long, length long, rank int, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *[1] * 9) for i, t in DOCS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def enc():
    return Encoder(default_tokenizer())


def ids_of(enc, text, end):
    return np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_tokens_equal_library(enc):
    for _, t in DOCS:
        if t is not None:
            assert enc.encode(t.encode()) == ids_of(enc, t, 0)[:-1].tobytes()


def test_packing(docs, none, enc):
    rows = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for i, t in DOCS:
        ids = ids_of(enc, t, 0)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack_documents(none).count() == 0


def test_sum_of_squares_is_close():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 4000)
    bins, offsets = packing.sum_of_squares(np.sort(lengths)[::-1], 2048)
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 2048 + 2


def test_sum_of_squares_places_as_a_plain_search_does():
    """Every open gap and a new bin are tried, the whole sum counted anew; ties go to the tighter gap."""
    rng = np.random.default_rng(2)
    for size in (1, 7, 40):
        lengths = rng.integers(1, size + 1, 300)
        gaps: list[int] = []  # of each bin
        total = lambda g: sum(n * n for n in collections.Counter(x for x in g if 0 < x < size).values())  # noqa: E731, B023
        bins, offsets = packing.sum_of_squares(lengths, size)
        for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
            options = {}
            for g in {x for x in gaps if x >= s}:
                i = gaps.index(g)
                options[total([*gaps[:i], g - s, *gaps[i + 1 :]]), g] = g
            options[total([*gaps, size - s]), size] = size
            best = options[min(options)]
            if best == size:
                assert (b, o) == (len(gaps), 0)
                gaps.append(size - s)
            else:
                assert gaps[b] == best and o == size - best
                gaps[b] -= s


def test_binary(docs, none, enc, spark, tmp_path):
    for name, part in (("docs", docs), ("none", none)):
        binary.write_token_files(part, f"file://{tmp_path}/{name}")
    rows = binary.read_documents(spark, f"file://{tmp_path}/docs", with_ids=True).collect()
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    names = [r["doc_id"] for r in rows]
    assert names[0] is None and names[1:] == sorted(names[1:])
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in rows) == collections.Counter((i, ids_of(enc, t, 2).tobytes()) for i, t in DOCS)
    assert binary.read_documents(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    counts = {int(i) * 3: int(c) for i, c in enumerate(rng.geometric(0.3, n) ** 6)}
    lengths = binary.code_lengths(counts, 12)
    assert max(lengths.values()) <= 12 and sum(2.0**-k for k in lengths.values()) <= 1
    code = binary.Code(lengths)
    ids = rng.choice(list(counts), 5000).astype("<u4")
    payload, marks = code.pack(ids)
    assert (code.unpack(payload, marks, len(ids)) == ids).all()


def test_code_is_optimal():
    """Against Huffman's own tree where the limit does not bind."""
    import heapq

    counts = {i: c for i, c in enumerate([5, 9, 12, 13, 16, 45, 1, 1, 2])}
    heap = list(counts.values())
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    got = binary.code_lengths(counts, 15)
    assert sum(counts[s] * k for s, k in got.items()) == cost


BENCH = [(1, "One two three four five six seven eight nine ten eleven"), (2, "lazy DOG"), (3, ""), (4, None), (5, "a b c d e f g h i j k l"), (1, "One two three four five six seven eight nine ten eleven"), (None, "quick brown"), (77, "漢字")]


def brute_hits(text, bench, window=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, items = low(text), set(), set()
    for i, t in bench:
        ws = low(t)
        m = min(window, len(ws))
        for k in range(len(ws) - m + 1) if ws else ():
            for a in range(len(words) - m + 1):
                if words[a : a + m] == ws[k : k + m]:
                    hit |= set(range(a, a + m))
                    items |= {str(i)} if i is not None else set()
    return len(words), hit, items


def test_automaton_by_brute_force():
    rng = np.random.default_rng(0)
    items = [(str(i), [bytes([97 + x]) for x in rng.integers(0, 4, n)]) for i, n in enumerate(rng.integers(0, 40, 30))]
    a = decontaminate.Automaton(items, 6)
    for _ in range(30):
        words = [bytes([97 + x]) for x in rng.integers(0, 5, 200)]
        spans, found = a.scan(words)
        hit, names = set(), set()
        for name, ws in items:
            m = min(6, len(ws))
            for k in range(len(ws) - m + 1) if ws else ():
                for p in range(len(words) - m + 1):
                    if words[p : p + m] == ws[k : k + m]:
                        hit |= set(range(p, p + m))
                        names.add(name)
        assert {x for s, e in spans for x in range(s, e)} == hit and found == names


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_contamination(docs, none, spark, block_words):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = decontaminate.find_contamination(docs, bench, block_words=block_words).collect()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(sorted(r["item_ids"]))) for r in rows)
    want = collections.Counter()
    for i, t in DOCS:
        n, hit, items = brute_hits(t, BENCH)
        want[i, n, len(hit), tuple(sorted(items))] += 1
    assert got == want
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontaminate(docs, spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    clash = decontaminate.decontaminate(docs.withColumn("own_hits", F.lit(1)), bench, block_words=20)
    assert clash.columns == [*docs.columns, "own_hits"] and clash.where("own_hits <> 1").count() == 0
    out = decontaminate.decontaminate(docs, bench, max_coverage=0.8)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 8 not in texts and 9 not in texts  # nearly all test words
    assert texts[6] == "short" and texts[3] is None
    assert "lazy dog" not in texts[0] and "jumps over the  while" in texts[0]


def brute_repeats(length):
    texts = [(i, (t or "").encode()) for i, t in DOCS]
    seen = collections.Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = collections.Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i, len(t), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard_bytes", [None, 900])
def test_repeats(docs, none, monkeypatch, shard_bytes):
    if shard_bytes:  # anchors are split over shards
        monkeypatch.setattr(suffix, "SHARD_BYTES", shard_bytes)
    rows = suffix.remove_repeats(docs, 200).collect()
    got = collections.Counter((r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)
    assert got == brute_repeats(200)
    if not shard_bytes:
        assert suffix.remove_repeats(none, 200).count() == 0


def test_repeats_of_an_anchor_with_long_segments(spark, monkeypatch):
    """Few but long segments of one anchor do not fit what is left of a shard; each shares 200 bytes with one other."""
    monkeypatch.setattr(suffix, "SHARD_BYTES", 20_000)
    rng = np.random.default_rng(0)
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    often = some(2_000_000)
    least = np.unique(suffix.anchors(np.frombuffer(often.encode(), np.uint8), 200))[:46] & np.uint64((1 << suffix.POSITION_BITS) - 1)
    *earlier, gram = (often[at : at + suffix.GRAM] for at in least.tolist())  # by rising hash, so these shards come first
    shared = [some(84) + gram + some(84) for _ in range(22)]
    rows = [(i, some(83) + "AB"[i // 22] + s + "AB"[i // 22] + some(83)) for i, s in enumerate(shared * 2)]
    rows += [(100 + i, t) for i, t in enumerate([*(some(84) + g + some(84) for g in earlier), *(some(200) for _ in range(400))] * 2)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got} == {i: [(84, 284)] if i < 100 else [(0, 200)] for i, _ in rows}


def test_repeats_of_large_unsplit_anchors(spark):
    """At the native shard size: two anchors of low hash fill a shard beyond its half, and none of their segments is lost."""
    rng = np.random.default_rng(1)
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    often = some(3_000_000)
    least = np.unique(suffix.anchors(np.frombuffer(often.encode(), np.uint8), 200))[:2] & np.uint64((1 << suffix.POSITION_BITS) - 1)
    rows, spans = [], {}
    for gram, pairs in zip((often[at : at + suffix.GRAM] for at in least.tolist()), (1300, 1720)):
        for _ in range(pairs):
            shared = some(109) + gram + some(109)
            for mark in "AB":
                spans[len(rows)] = [(84, 84 + len(shared))]
                rows.append((len(rows), some(83) + mark + shared + mark + some(83)))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got} == spans


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    text = np.frombuffer(b"".join([rng.choice([b"ab", b"abc", b"ba", b"a" * 40], 1)[0] for _ in range(400)]), np.uint8)
    raw = text.tobytes()
    sa, place, new = suffix.suffix_array(text, 64)
    pre = [raw[i : i + 64] for i in sa]
    assert pre == sorted(pre) and (place[sa] == np.arange(len(sa))).all()
    lcp = suffix.common_prefixes(text, sa, place, new, 64)
    for p in range(1, len(sa)):
        a, b = raw[sa[p - 1] :], raw[sa[p] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[p] == min(n, 64)


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                root[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, none):
    prints = [brute_fingerprint(t) for _, t in DOCS]
    roots = brute_components(prints, 4)
    least = {r: min((i for (i, _), x in zip(DOCS, roots) if x == r and i is not None), default=None) for r in roots}
    want = collections.Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(DOCS, prints, roots))
    rows = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs, 4, 4, 1)
    assert kept.count() == len(set(roots)) and kept.columns == docs.columns


def brute_wide(text, words=5):
    from xxhash import xxh3_128_intdigest

    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", " ".join(ws)) if w]
    hs = [xxh3_128_intdigest(" ".join(ws[i : i + words]).encode(), 42) for i in range(max(1, len(ws) - words + 1))] if ws else []
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_keep_one(spark, docs, none):
    """A row of each component of wide fingerprints, whatever the ids: repeated, null, or both."""
    rng = np.random.default_rng(0)
    some = lambda n: [rng.integers(97, 123, 6).astype(np.uint8).tobytes().decode() for _ in range(n)]
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (2, "red green blue white black grey"), (None, "lone text without id"), (None, "lone text without id"), (None, "another text of no id")]
    for k in range(40):
        words = some(120)
        rows.append((10 + 2 * k, " ".join(words)))
        if k % 2:
            words[60] = "changed"  # 10 of 116 shingles differ
            rows.append((11 + 2 * k if k % 3 else None, " ".join(words)))
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp long, __keep int")
    roots = brute_components([brute_wide(t) for _, t in rows], simhash.WIDE_RADIUS)
    assert len(set(roots)) < len(rows) - 15
    want = collections.Counter()
    for r in set(roots):
        ids = [i for (i, _), x in zip(rows, roots) if x == r]
        want[min((i for i in ids if i is not None), default=None)] += 1
    got = simhash.keep_one(frame)
    assert got.columns == frame.columns
    kept = got.collect()
    assert collections.Counter(r["doc_id"] for r in kept) == want
    assert sorted(roots[next(k for k, x in enumerate(rows) if x == (r["doc_id"], r["text"]))] for r in kept) == sorted(set(roots))
    assert {r["text"] for r in kept if r["doc_id"] == 1} == {rows[0][1], rows[1][1]}
    odd = simhash.keep_one(docs).collect()
    assert len(odd) == len(set(brute_components([brute_wide(t) for _, t in DOCS], simhash.WIDE_RADIUS)))
    assert simhash.keep_one(none).count() == 0


def test_fingerprints_block_by_block(monkeypatch):
    from seriesloom.llm import common

    text = ("Lorem ipsum dolor sit amet " * 40 + "consectetur\n\tadipiscing elit. " * 9).encode()
    whole = [simhash.fingerprints_of(text, k, n) for k in (1, 4, 5) for n in (1, 2)]
    monkeypatch.setattr(simhash, "word_blocks", lambda t: common.word_blocks(t, 13))
    assert [simhash.fingerprints_of(text, k, n) for k in (1, 4, 5) for n in (1, 2)] == whole


@pytest.mark.parametrize("tile", [16_384, 8])
def test_links_find_all_pairs(spark, tile):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = [int(c) for c in centres]
    for c in centres:
        for _ in range(12):
            v = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v, v) for v in signed], "node long, fp long")
    got = {r["node"]: r["root"] for r in graph.connected_components(simhash.links(prints, 4, tile)).collect()}
    groups = collections.defaultdict(set)
    for v, r in zip(signed, brute_components(values, 4)):
        groups[r].add(v)
    for group in groups.values():
        assert {got.get(v, v) for v in group} == {min(group)}


def test_block_masks_meet():
    rng = np.random.default_rng(0)
    for n in (10, 10**6, 10**9):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flips & m for m in masks)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(0)
    words = ["lorem", "ipsum", "dolor", "amet", "elit", "sed"]
    rows = [(i, " ".join(rng.choice(words, 20)) + (" you vile wretch" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, y)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    odd = toxicity.score(docs, model)
    assert odd.count() == len(DOCS) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(d, y.limit(0)) is None
    assert toxicity.score(d, None).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.drop_toxic(docs, y).columns == docs.columns


def plain_slots(text):
    """Hashed 3- to 5-grams of a text, gram by gram."""
    out, low = set(), f" {text.lower()} "
    for n in (3, 4, 5):
        for i in range(len(low) - n + 1):
            h = ord(low[i])
            for k in range(1, n):
                h = (h * 0x01000193 + ord(low[i + k]) + k + 1) % 2**32
            out.add((h ^ h >> 15) * 0x9E3779B1 % 2**32 >> 12)
    return out


def test_toxicity_model_equals_a_plain_one(spark):
    """Slot counts, log-count ratios, choice of features, and weights at the optimum of the penalised log loss."""
    rng = np.random.default_rng(3)
    words = ["lorem", "ipsum", "dolor", "amet", "elit", "Sed", "ut"]
    rows = [(i, " ".join(rng.choice(words, 8)) + (" vile wretch" if rng.random() < (0.8 if i % 3 == 0 else 0.1) else "")) for i in range(250)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(250)], "doc_id long, toxic int")
    model = toxicity.train(d, y, features=150, min_count=1)
    own = [(plain_slots(t), int(i % 3 == 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    n = [sum(t == c for _, t in own) for c in (0, 1)]
    count = {c: collections.Counter(s for ss, t in own if t == c for s in ss) for c in (0, 1)}
    table = {}
    for s in set(count[0]) | set(count[1]):
        p, q = (count[1][s] + 1) / (n[1] + 2), (count[0][s] + 1) / (n[0] + 2)
        mean = (count[1][s] + count[0][s] + 1) / (sum(n) + 2)
        table[s] = (-abs(p - q) / math.sqrt(mean * (1 - mean) * (1 / (n[1] + 1) + 1 / (n[0] + 1))), math.log(p / q))
    z = sorted(v[0] for v in table.values())[149]
    assert {s for s, v in table.items() if v[0] < z - 1e-9} <= set(model.slot.tolist()) <= {s for s, v in table.items() if v[0] <= z + 1e-9}
    ratio = np.array([table[s][1] for s in model.slot.tolist()])
    x = np.array([[s in ss for s in model.slot.tolist()] for ss, _ in own]) * ratio
    t = np.array([t for _, t in own])
    w = model.weight / np.where(ratio == 0, 1, ratio)
    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    assert np.abs(x.T @ (p - t) / len(t) + 1e-3 * w).max() < 2e-3 and abs((p - t).mean()) < 2e-3
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    for i, text in rows[:40]:
        have = plain_slots(text)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(float(v) for s, v in zip(model.slot.tolist(), model.weight) if s in have)))), abs=1e-5)


def test_long_text_has_all_grams(monkeypatch):
    text = "abcdefghij" * 40
    whole = np.sort(np.concatenate(toxicity.slots(text)))
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    assert (np.sort(np.concatenate(toxicity.slots(text))) == whole).all()


def test_pii_values():
    p = pii.Pseudonyms(b"k")
    text = "Call +1 (017) 555-7713 or ann.34@mail7.example.com, 97.51.17.173, card 4539 1488 0343 6467, born 1980-02-29 or 31/12/1999, ssn 123-45-6789."
    out, counts = p.mask(text)
    assert counts == {"email": 1, "ip": 1, "phone": 1, "ssn": 1, "date": 2, "card": 1}
    assert p.mask(text)[0] == out and pii.Pseudonyms(b"k").mask(text)[0] == out != pii.Pseudonyms(b"other").mask(text)[0]
    assert [re.sub("[a-z]", "a", re.sub(r"\d", "9", x)) for x in out.split() if "." not in x or "@" in x] == [re.sub("[a-z]", "a", re.sub(r"\d", "9", x)) for x in text.split() if "." not in x or "@" in x]
    card = re.search(r"card ([\d ]+),", out)[1].replace(" ", "")
    assert pii.check_digit(card[:-1]) == card[-1]
    assert p.mask(out)[1] == counts  # all are valid in their formats
    for left in ("4539148803436468", "300.1.1.1", "1980-02-30", "000-12-3456", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "version 2.0.1"):
        assert p.mask(left)[0] == left


STYLES = [
    ["2001-03-15", "15/3/2001", "15.03.2001", "3/15/2001", "03/15/2001"],
    ["1999-02-07", "7/2/1999", "07.02.1999"],
    ["+44 2012345678", "+442012345678", "+44 (0)20 1234 5678", "+44-20-12345678"],
    ["+1 202 555 0143", "+12025550143", "+1 (202) 555-0143"],
    ["+353 1 234 5678", "+35312345678"],
    ["Ann.Lee9@mail.example.com", "ann.lee9@mail.example.com", "ANN.LEE9@Mail.Example.com"],
    ["4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467"],
]


@pytest.mark.parametrize("styles", STYLES, ids=lambda s: s[0])
def test_pii_links_styles(styles):
    """One value, however it is written, has one pseudonym, written in the same style."""
    import datetime

    p = pii.Pseudonyms(b"k")
    got = [p.mask(f"on {x}, then")[0][3:-6] for x in styles]
    assert all(g != s for g, s in zip(got, styles))
    shape = lambda x: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", x)))
    if "2001" in styles[0] or "1999" in styles[0]:
        day = datetime.date.fromisoformat(got[0])
        want = {"-": day.isoformat(), "15/3/2001": f"{day.day}/{day.month}/{day.year}", "15.03.2001": f"{day.day:02}.{day.month:02}.{day.year}", "3/15/2001": f"{day.month}/{day.day}/{day.year}", "03/15/2001": f"{day.month:02}/{day.day:02}/{day.year}", "7/2/1999": f"{day.day}/{day.month}/{day.year}", "07.02.1999": f"{day.day:02}.{day.month:02}.{day.year}"}
        assert got[1:] == [want[s] for s in styles[1:]]
    else:
        value = lambda x: x.lower() if "@" in x else re.sub(r"\D", "", x.replace("(0)", ""))
        assert len({value(g) for g in got}) == 1 and [shape(g) for g in got] == [shape(s) for s in styles]


def undo(p, value, size, tweak, valid=lambda x: True):
    """The network backwards, round by round."""
    import hashlib

    a = max(2, math.isqrt(size - 1) + 1)
    while True:
        left, right = divmod(value, a)
        for i in reversed(range(pii.ROUNDS)):
            digest = hashlib.blake2b(f"{tweak}|{size}|{i}|{left}".encode(), key=p.key, digest_size=16).digest()
            left, right = (right - int.from_bytes(digest, "big")) % a, left
        value = left * a + right
        if value < size and valid(value):
            return value


def test_pii_kinds_can_be_undone():
    """Per kind: the pseudonym is what the network gives for the value alone, and goes back to it."""
    import datetime

    p, rng = pii.Pseudonyms(b"k"), np.random.default_rng(0)
    days = pii.LAST - pii.FIRST + 1
    for x in rng.choice(days, 300, replace=False).tolist():
        old = datetime.date.fromordinal(pii.FIRST + x)
        new = datetime.date.fromisoformat(p.date(old.isoformat()))
        late = lambda y: (datetime.date.fromordinal(pii.FIRST + y).day > 12) == (old.day > 12)  # noqa: E731, B023
        assert undo(p, new.toordinal() - pii.FIRST, days, "date", late) == x
    for _ in range(200):
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        number = lambda t: int.from_bytes(bytes(map(int, t.split("."))), "big")
        assert undo(p, number(p.ip(ip)), 1 << 32, "ip") == number(ip)
        n = "".join(map(str, rng.integers(0, 10, rng.integers(7, 11))))
        assert undo(p, int(p.phone("+44" + n)[3:]), 10 ** len(n), f"phone44{len(n)}") == int(n)
        body = "".join(map(str, rng.integers(0, 10, 15)))
        card = p.card(body + pii.check_digit(body))
        assert pii.check_digit(card[:-1]) == card[-1] and undo(p, int(card[:-1]), 10**15, "card15") == int(body)
        ssn = f"{rng.integers(1, 666):03}-{rng.integers(1, 100):02}-{rng.integers(1, 10000):04}"
        ok = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10_000 % 100 > 0 and x % 10_000 > 0
        assert undo(p, int(p.ssn(ssn).replace("-", "")), 10**9, "ssn", ok) == int(ssn.replace("-", ""))
    names = [a + b + str(d) for a in "abcdef" for b in "xyz" for d in range(5)]
    assert len({p.email(f"{n}@h.org") for n in names}) == len(names)


def test_pii_key(spark):
    assert pii.key_of(spark) != pii.key_of(spark)
    spark.conf.set(pii.KEY_SETTING, "s3")
    assert pii.key_of(spark) == b"s3"
    spark.conf.unset(pii.KEY_SETTING)


def test_permutation():
    p = pii.Pseudonyms(b"key")
    for size in (2, 10, 97, 1000):
        assert sorted(p.permute(i, size, "t") for i in range(size)) == list(range(size))
    even = [p.permute(i, 100, "t", lambda x: x % 2 == 0) for i in range(0, 100, 2)]
    assert sorted(even) == list(range(0, 100, 2))


def test_pii_table(docs, none, spark):
    out = pii.pseudonymise(docs, b"k")
    assert out.columns == [*docs.columns, "pii"] and out.count() == len(DOCS)
    texts = {(r["doc_id"]): r["text"] for r in out.collect()}
    assert texts[3] is None and texts[4] == "" and texts[0] == BASE
    assert pii.pseudonymise(none, b"k", counts=False).schema == none.schema
    clash = pii.pseudonymise(docs.withColumn("pii", F.lit(1)), b"k")
    assert clash.columns == [*docs.columns, "pii", "_pii"] and clash.where("pii = 1").count() == len(DOCS)


VECTORS = [(i, [float(np.float32(np.sin(i * k + k * k))) for k in range(1, 9)]) for i in range(0, 330)] + [(400, None), (401, [1.0, None]), (402, [math.nan] * 8), (403, [math.inf] * 8), (None, [1.0] * 8), (500, [0.5] * 8), (501, [0.5] * 8), (600, [1.0, 2.0]), (700, [])]


@pytest.mark.parametrize(("shard", "block"), [(8192, 2048), (50, 2)])
def test_top_k(spark, monkeypatch, shard, block):
    rows = spark.createDataFrame([(i, v, 1) for i, v in VECTORS], "vec_id long, embedding array<float>, rank int")
    valid = topk.valid_vectors(rows)
    got = collections.defaultdict(list)
    for r in topk.top_k(valid.where("id % 100 = 0"), valid, query_block=block, shard=shard).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in VECTORS if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in ok:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:10]
            want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    monkeypatch.setattr(topk, "CELLS", 3000)  # vectors of different lengths get shards of their own
    again = topk.top_k(valid.where("id % 100 = 0"), valid, query_block=block, shard=shard).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in again) == sorted(x for v in want.values() for x in v)
    assert topk.top_k(valid.limit(0), valid).count() == 0 and topk.top_k(valid.where("id = 0"), valid.limit(0)).count() == 0


def test_search_stops_early():
    """Vectors with few large components: the proof comes before the segments are done."""
    rng = np.random.default_rng(0)
    values = (rng.standard_normal((2000, 32)) ** 5 * 50).astype(np.int64)
    order = np.argsort(-values, axis=0, kind="stable").T
    ends = np.tile(np.linspace(0, 2000, topk.LEVELS + 1).astype("<i4")[1:], (32, 1))
    shard = topk.Shard(np.arange(2000, dtype="<i8").tobytes(), 2000, 32, values.astype("<i4").tobytes(), order.astype("<i4").tobytes(), ends.tobytes())
    total = 0
    for i in range(50):
        scores, ids, read = shard.search(values[i], i, 10, None)
        total += read
        want = sorted(((-int(values[j] @ values[i]), j) for j in range(2000) if j != i))[:10]
        assert sorted(zip((-scores).tolist(), ids.tolist()))[:10] == want
    assert total < 50 * 2000 * 32 / 4


def test_large_components(spark):
    big = spark.createDataFrame([(0, [3e38]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.valid_vectors(big).collect()
    wide = spark.createDataFrame([(100, [float(1 << 30)] * 4), (1, [float(1 << 30)] * 4)], "vec_id long, embedding array<double>")
    valid = topk.valid_vectors(wide)
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(valid.where("id = 100"), valid).collect()


def test_url_rules(spark):
    cases = [
        ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://b.net/de/", "b.net", "/de/", "net/", "block"),
        ("https://b.net", "b.net", "", None, "allow"),
        ("ftp://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        ("no scheme/net/", "", "", None, "allow"),
        ("a\n://q.net/z\n?p", "q.net", "/z\n", "net/", "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(cases)] + [(None, "http://b.net/", "x")], "page_id long, url string, block string")
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, labels).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: tuple(rest) for i, (_, *rest) in enumerate(cases)}
    assert urls.judge_urls(pages.limit(0), labels).count() == 0
    assert urls.judge_urls(pages, labels.limit(0)).where("verdict = 'allow'").count() > 0


@pytest.mark.parametrize("limit", [4096, 0])
def test_url_mining(spark, monkeypatch, limit):
    """The folded index and the joined one judge alike, as brute force over the rules does."""
    monkeypatch.setattr(urls, "INDEX_RULES", limit)
    rows = [(i, f"https://{'ads' if i % 3 == 0 else 'www'}.site{i % 5}.com/{'promo' if i % 2 else 'news'}/{i}") for i in range(120)]
    pages = spark.createDataFrame([*rows, rows[3]], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 and i % 2 else 1, 0) for i in range(0, 120, 2)] + [(i, 0 if i % 3 == 0 else 1, 0) for i in range(1, 120, 4)], "doc_id long, quality int, toxic int")
    marks = {i: i % 3 == 0 and i % 2 == 1 for i in [*range(0, 120, 2), *range(1, 120, 4)]}
    labelled = spark.createDataFrame([(u, marks[i]) for i, u in rows if i in marks], "url string, block boolean")
    rules = [set(r["items"]) for r in urls.mine_rules(labelled).collect()]
    assert rules and not any(a < b for a in rules for b in rules)
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, labels).collect()}
    assert got == {i: "block" if any(r <= t for r in rules) else "allow" for i, t in tokens.items()}
    assert got[3] == "block" and got[2] == "allow"


@pytest.mark.parametrize("significant", [False, True])
def test_mining_equals_all_itemsets(spark, significant):
    """Every set of tokens, counted one by one."""
    import itertools

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        parts = [f"{c}{rng.integers(3)}" for c in "abc"] + (["t1", "t2"] if rng.random() < 0.3 else [])
        rows.append(("http://x.com/" + "/".join(parts), bool(rng.random() < (0.9 if parts[0] == "a1" and parts[2] == "c2" else 0.8 if "t1" in parts else 0.1))))
    sets = [(set(u.split("/")[3:]) - {"t2"}, b) for u, b in rows]  # t1 and t2 always come together
    base, tokens = sum(b for _, b in sets) / 300, sorted(set().union(*(t for t, _ in sets)))
    found = {}
    for size in range(1, 5):
        for c in itertools.combinations(tokens, size):
            marks = [b for t, b in sets if t >= set(c)]
            if sum(marks) >= 0.02 * 300:
                p, n, z = sum(marks) / len(marks), len(marks), 1.96
                low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                found[c] = (p, p >= 0.5 and (low if significant else p) >= 1.5 * base)
    want = {c for c, (p, sure) in found.items() if sure and all(found[d][0] < p for d in found if set(d) < set(c))}
    got = urls.mine_rules(spark.createDataFrame(rows, "url string, block boolean"), 0.02, significant=significant).collect()
    assert {tuple(x[5:] for x in r["items"]) for r in got} == want and len(want) > 2
    assert all(r["confidence"] == pytest.approx(found[tuple(x[5:] for x in r["items"])][0]) for r in got)


def test_url_columns_of_the_same_name(spark):
    pages = spark.createDataFrame([(0, "http://b.net/x", "a", 1, 2)], "page_id long, url string, host string, own_hit int, own_tokens int")
    labels = spark.createDataFrame([(0, 0, 1)], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(pages, labels)
    assert sorted(got.columns) == sorted([*pages.columns, "path", "rule", "verdict"])
    assert got.first()["host"] == "b.net" and got.first()["own_hit"] == 1


def test_url_rules_of_four_tokens(spark):
    """Only four path names together tell; no three of them reach the confidence."""
    names = [(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    pages = spark.createDataFrame([(i, "http://x.com/p{}/q{}/r{}/s{}".format(*n)) for i, n in enumerate(names)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(n == (1, 1, 1, 1))) for i, n in enumerate(names)], "doc_id long, quality int, toxic int")
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", (F.col("toxic") == 1).alias("block"))
    assert [r["items"] for r in urls.mine_rules(labelled).collect()] == [["path:p1", "path:q1", "path:r1", "path:s1"]]
    assert [r["page_id"] for r in urls.judge_urls(pages, labels).where("verdict = 'block'").collect()] == [names.index((1, 1, 1, 1))]


def test_attention_gradient():
    rng = np.random.default_rng(0)
    vocabulary = attention.Vocabulary.from_counts(rng.integers(0, 99, 3000))
    flat = attention.fresh(vocabulary).astype(np.float64)
    places, leaf = rng.integers(0, attention.LEAVES + 1, (2, attention.CONTEXT)), rng.integers(0, attention.LEAVES, (2, attention.CONTEXT))
    weight = np.ones((2, attention.CONTEXT))
    weight[0, 9:] = 0
    grad = np.zeros(attention.SIZE)
    attention.gradient(attention.split(flat), places, leaf, weight, attention.split(grad))
    loss = lambda x: attention.gradient(attention.split(x), places, leaf, weight, attention.split(np.zeros(attention.SIZE)))
    ends = np.cumsum([0, *(int(np.prod(s)) for s in attention.SHAPES.values())])
    for a, b in zip(ends, ends[1:]):  # some of each kind of weight
        for i in rng.choice(a + np.flatnonzero(grad[a:b]), 6):
            step = np.zeros(attention.SIZE)
            step[i] = 1e-5
            assert grad[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=1e-5)


def plain_probabilities(flat, leaves):
    """The next leaf's distribution after some leaves, position by position, as the model is defined."""
    w = {k: v.astype(np.float64) for k, v in attention.split(flat).items()}
    d = attention.WIDTH
    norm = lambda x: x / math.sqrt((x * x).mean() + 1e-5)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    xs = [w["e"][p] for p in leaves]
    q, k, v = (np.array([norm(x) @ w["qkv"][:, i * d : (i + 1) * d] for x in xs]) for i in range(3))
    t = len(xs) - 1
    a = softmax(np.array([q[t] @ k[j] / math.sqrt(d) + w["r"][t - j] for j in range(t + 1)]))
    x = xs[t] + (a @ v) @ w["o"]
    x = x + np.maximum(norm(x) @ w["a"] + w["ab"], 0) @ w["z"]
    h = np.append(norm(x), 1)
    groups = softmax(h @ w["u"])
    return np.concatenate([g * softmax(h @ table) for g, table in zip(groups, w["t"])])


def test_attention_scores_equal_a_plain_model():
    rng = np.random.default_rng(0)
    vocabulary = attention.Vocabulary.from_counts(rng.integers(0, 50, 4000))
    assert np.bincount(vocabulary.leaf, 10**vocabulary.share, attention.LEAVES) == pytest.approx(1)
    flat = attention.fresh(vocabulary)
    flat += rng.standard_normal(attention.SIZE).astype(np.float32) * 0.2
    scorer = attention.Scorer(flat, vocabulary)
    texts = [rng.integers(0, 4000, n) for n in (1, 7, attention.CONTEXT, attention.CONTEXT + 1, 75)]

    def plain(tokens):
        leaves, total = [attention.LEAVES, *vocabulary.leaf[tokens].tolist()], 0.0
        for i, t in enumerate(tokens.tolist()):
            # the first CONTEXT tokens see all before them, later ones what their window holds
            start = 0 if i < attention.CONTEXT else ((i - attention.CONTEXT) // attention.STRIDE + 1) * attention.STRIDE
            p = plain_probabilities(flat, leaves[start : i + 1])
            assert p.sum() == pytest.approx(1)
            total += math.log10(p[vocabulary.leaf[t]]) + vocabulary.share[t]
        return total

    assert scorer.sequences(texts) == pytest.approx([plain(t) for t in texts], abs=1e-3)
    assert len(scorer.sequences([])) == 0


def lm_parts(texts):
    """Words and tokens of texts by the library alone."""
    enc, out = Encoder(default_tokenizer()), []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        # a special token's name keeps its case in the text
        chunks = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        tokens = []
        for c in chunks:
            ids = enc.tokenizer.encode(c.decode(), add_special_tokens=False).ids
            tokens += [2 * i + (k + 1 == len(ids)) for k, i in enumerate(ids)]
        out.append((words, [*tokens, 2 * enc.tokenizer.get_vocab_size() + 1]))
    return out


@pytest.mark.parametrize("frequent", [200_000, 5])
def test_lm(docs, none, monkeypatch, frequent):
    """Counts and base by brute force; the score is that of the model which the rounds give."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    models = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda train, n, vocabulary, *a, **k: models.append((fit(train, n, vocabulary, *a, **k), vocabulary)) or models[-1][0])
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    parts = lm_parts([t for _, t in DOCS])
    words = [[*ws, None] for ws, _ in parts]
    c = collections.Counter(w for (i, _), ws in zip(DOCS, words) if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = lm.lm_scores(docs).collect()
    flat, vocabulary = models[0]
    scores = attention.Scorer(flat, vocabulary).sequences([np.array(t) for _, t in parts])
    want = sorted(((i is not None, i or 0, out(i), len(ws), sum(c[w] > 0 for w in ws), n), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), s) for (i, _), ws, s in zip(DOCS, words, scores))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"]) for r in rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-3)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-4, abs=1e-3)
    counts = collections.Counter(t for (i, _), (_, ts) in zip(DOCS, parts) if not out(i) for t in ts)
    # words are counted lower-cased, so special names differ by a few
    assert vocabulary.leaf_count.sum() == pytest.approx(sum(counts.values()) + len(vocabulary.leaf), abs=20)
    if frequent > 5:
        assert lm.lm_scores(none).count() == 0


def test_lm_learns(spark):
    """Held-out texts score far better than by untrained weights, which follow the token counts alone."""
    rng = np.random.default_rng(0)
    words = [a + b + c for a in ("ba", "lo", "mi", "ter") for b in ("na", "ri", "so", "ten") for c in ("da", "li", "mo", "den", "ki")]
    texts = [" ".join(rng.choice(words[40 * (i % 2) : 40 * (i % 2) + 40], 150)) for i in range(900)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    r = lm.lm_scores(frame).where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    parts = [np.array(t) for _, t in lm_parts(texts)]
    vocabulary = attention.Vocabulary.from_counts(np.bincount(np.concatenate(parts)))
    held = [t for i, t in enumerate(parts) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert r[0] > attention.Scorer(attention.fresh(vocabulary), vocabulary).sequences(held).sum() + 0.5 * r[1]


@pytest.mark.parametrize("copies", [1, 400])
def test_training_windows_hold_every_token_once(copies):
    """Few texts or many: long ones are not thinned out, each token is predicted once and after the tokens before it."""
    size = attention.CONTEXT
    sequences = [np.arange(1, n) % 1000 for n in (2, 7, 24, 25, 26, 500, 6000)]
    want: collections.Counter = collections.Counter()
    for s in sequences:
        leaves = [attention.LEAVES, *s.tolist()]
        for i in range(0, len(leaves) - 1, size):
            want[tuple(leaves[i : i + size + 1])] += copies
    windows, valid = lm.training_windows(sequences * copies)
    assert collections.Counter(tuple(w[:n]) for w, n in zip(windows.tolist(), valid.tolist(), strict=True)) == want


def test_tokens_of_long_texts(monkeypatch):
    """Blocks cut no word."""
    from seriesloom.llm import common

    text = ("lorem ipsum\tdolor, " * 50 + "x" * 300 + "\n\n" + "Ünï " * 30).encode()
    whole = lm.Tokens(default_tokenizer()).whole(text, 7)
    assert [b"".join(common.word_blocks(text, n)) == text and max(len(b) for b in common.word_blocks(text, n)) < n + 320 for n in (1, 10, 64, 10**6)] == [True] * 4
    monkeypatch.setattr(lm, "word_blocks", lambda t: common.word_blocks(t, 17))
    assert (lm.Tokens(default_tokenizer()).whole(text, 7) == whole).all()


def test_training_does_not_depend_on_the_layout(spark, monkeypatch):
    """Several shards and rounds: the same weights from one partition and from many, from small batches and from large ones."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 400)
    monkeypatch.setattr(lm, "FED_TEXTS", 7)
    texts = [f"text {i} of some words that come again {i % 5} and {i % 3} times" for i in range(150)] + ["one text many times over"] * 20
    frame = spark.createDataFrame([(i % 160, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vocabulary = attention.Vocabulary.from_counts(np.bincount(np.concatenate([np.array(t) for _, t in lm_parts(texts)])))
    end = 2 * Encoder(default_tokenizer()).tokenizer.get_vocab_size() + 1
    tokens = sum(len(t) for _, t in lm_parts(texts))
    rounds, shards, rates = lm.training_plan(tokens)
    assert rounds >= 3 and shards > 1 and len(rates) == rounds and rates[0] == lm.FIRST_RATE and rates[-1] == pytest.approx(lm.LAST_RATE)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(key), []
    try:
        for parts, batch in ((1, "10000"), (6, "3"), (3, "50")):
            spark.conf.set(key, batch)
            got.append(lm.fit(frame.repartition(parts), tokens, vocabulary, default_tokenizer(), end))
    finally:
        spark.conf.set(key, before)
    assert not np.allclose(got[0], attention.fresh(vocabulary)) and all(np.allclose(got[0], g, rtol=0, atol=1e-6) for g in got[1:])


def test_training_steps_fault_no_pages_in():
    """A step works in memory that the steps before it had (before: about 1,400 faults a step)."""
    code = """
import resource
import numpy as np
from seriesloom.llm import attention as a
rng = np.random.default_rng(0)
windows, valid = rng.integers(0, a.LEAVES, (5 * a.BATCH, a.CONTEXT + 1)), np.full(5 * a.BATCH, a.CONTEXT + 1)
trainer = a.Trainer(a.fresh(a.Vocabulary.from_counts(rng.integers(0, 99, 3000))), 1e-2)
trainer.feed(windows, valid)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in range(4):
    trainer.feed(windows, valid)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 20)
"""
    root = pathlib.Path(lm.__file__).parents[2]
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root, env=os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"})
    assert float(got.stdout.split()[-1]) < 100


def test_texts_are_encoded_once(spark):
    """What is stored of a text gives its tokens' score, and training reads it as it reads texts."""
    texts = [(i, f"stored text {i} of words, and more of them " * (i % 4)) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", F.lit(False))
    parts = [np.array(t) for _, t in lm_parts([t for _, t in texts])]
    end = int(parts[0][-1])
    vocabulary = attention.Vocabulary.from_counts(np.bincount(np.concatenate(parts)))
    stored = lm.encoded(frame, vocabulary, default_tokenizer(), end)
    rows = {r["doc_id"]: r for r in stored.collect()}
    assert all((np.frombuffer(rows[i]["leaves"], "<u2") == vocabulary.leaf[t]).all() and rows[i]["share"] == pytest.approx(vocabulary.share[t].sum()) for i, t in enumerate(parts))
    n = sum(map(len, parts))
    flat = lm.fit(stored, n, vocabulary, default_tokenizer(), end)
    assert np.allclose(flat, lm.fit(frame.select("doc_id", "text"), n, vocabulary, default_tokenizer(), end), rtol=0, atol=1e-6)
    scorer = attention.Scorer(flat, vocabulary)
    assert scorer.leaf_sequences([vocabulary.leaf[t] for t in parts]) + [rows[i]["share"] for i in range(60)] == pytest.approx(scorer.sequences(parts))


@pytest.mark.parametrize("kept", [600_000, 3])
def test_new_words_of_many_texts_are_encoded_together(monkeypatch, kept):
    """The texts of a megabyte ask for their new words at once (before: each text did), and words that were forgotten get the same tokens again."""
    monkeypatch.setattr(lm, "KEPT_WORDS", kept)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["so", "na,", "Mi", "teré", "ba!?", "l'o", f"new{i}x", "x9", "<|endoftext|>"], 30)) for i in range(200)] + [""]
    held = lm.Tokens(default_tokenizer(), [b"so", b"mi", b"never"])
    asked = []
    pieces = held.encoder.pieces
    monkeypatch.setattr(held.encoder, "pieces", lambda chunks, *a: asked.append(len(chunks)) or pieces(chunks, *a))
    for _ in range(2):
        ((places, blocks),) = lm.block_groups([t.encode() for t in texts])
        words, numbers, tokens, n_words, n_tokens = held.of(blocks)
        assert places.tolist() == list(range(201)) and len(asked) <= 4
        parts = lm_parts(texts)
        assert words == [w for ws, _ in parts for w in ws] and n_words.tolist() == [len(ws) for ws, _ in parts]
        assert [*map(list, np.split(tokens, np.cumsum(n_tokens)[:-1]))] == [ts[:-1] for _, ts in parts]
        assert [n if n < 3 else 3 for n in numbers.tolist()] == [{b"so": 0, b"mi": 1}.get(w, 3) for w in words]


def test_training_plan_grows_with_the_tokens():
    plans = [lm.training_plan(n) for n in (0, 1, 10**6, 10**8, 10**11)]
    assert [r * s * lm.SHARD_TOKENS >= n for (r, s, _), n in zip(plans, (0, 1, 10**6, 10**8, 10**11))] == [True] * 5
    assert plans[0][:2] == (3, 1) and plans[-1][0] > plans[-2][0] > 3


def test_many_rows_of_one_id(spark, tmp_path, monkeypatch):
    """Rows of one doc_id, and rows without one, lie in several files and keep their ids; a frequent fingerprint joins by its count."""
    rows = [(5, f"text number {i}") for i in range(60)] + [(None, f"nameless {i}") for i in range(30)] + [(i, "the same text of all") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/tokens"
    binary.write_token_files(docs, path)
    got = binary.read_documents(spark, path, with_ids=True).collect()
    enc = Encoder(default_tokenizer())
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == collections.Counter((i, ids_of(enc, t, 2).tobytes()) for i, t in rows)
    ordered = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    ends = np.cumsum([r["n_tokens"] for r in ordered])
    assert [r["start"] for r in ordered] == [0, *ends[:-1].tolist()]
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    holding = [r["part"] for r in blocks if np.isin(5, np.frombuffer(r["doc_ids"], "<i8")[np.frombuffer(r["doc_valid"], bool)])]
    assert len(set(holding)) > 1
    near = simhash.near_duplicates(docs).collect()
    assert len(near) == len(rows) and {r["component_id"] for r in near if r["doc_id"] is not None and r["doc_id"] >= 100} == {100}


def test_wide_fingerprints_find_similar_texts():
    """Of edited copies whose sets of five-word shingles are similar by 0.8 or more, nine in ten and more are within the radius; unlike texts are not."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    shingles = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    near = far = found = wrong = 0
    for _ in range(400):
        ws = [words[i] for i in rng.integers(0, 3000, 300)]
        other = list(ws)
        for at in rng.integers(0, 300, rng.integers(1, 9)):
            other[at] = "edited"
        a, b = shingles(ws), shingles(other)
        x, y = (np.array(simhash.fingerprints_of(" ".join(t).encode(), 5, 2), np.int64).view(np.uint64) for t in (ws, other))
        if len(a & b) >= 0.8 * len(a | b):
            near += 1
            found += int(np.bitwise_count(x ^ y).sum()) <= simhash.WIDE_RADIUS
        z = np.array(simhash.fingerprints_of(" ".join(words[i] for i in rng.integers(0, 3000, 300)).encode(), 5, 2), np.int64).view(np.uint64)
        far += 1
        wrong += int(np.bitwise_count(x ^ z).sum()) <= simhash.WIDE_RADIUS
    assert near > 150 and found >= 0.9 * near and wrong == 0 < far
