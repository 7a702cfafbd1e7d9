"""Benchmark decontamination by a generalised suffix automaton over item words.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased.  The automaton holds all items; document words are streamed through
it and the longest suffix that matches an item is tracked.  A match of at least
``window`` words covers its words; an item with fewer words (but not none) must
match as a whole.  Runs between words that no item holds are taken one by one,
as no match crosses such a word, and runs too short for any window are passed.

The automaton is sent to executors in blocks of at most ``BLOCK_WORDS`` item
words; a larger benchmark takes one pass over the documents per block.  Nearly all
states have one step only, which is kept in flat arrays.

Null and empty texts have no words and no hits.  Repeated items count once by
item_id; an item without id covers words but is not listed.  Repeated documents
are judged one by one.  An empty benchmark hits nothing.  Extra columns are
kept by ``decontaminate`` and ignored by ``find_contamination``.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, free_name, materialise

BLOCK_WORDS = 300_000
#: Bytes of words keep their place, A-Z in lower case; all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of word sequences; states know which items' windows end in them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        # a state's first step; those with more have them all in `steps`
        self.word, self.to, self.steps = array("i", [-1]), array("i", [-1]), {0: {}}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = [(name, [self.vocabulary[w] for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            at = 0
            for w in ws:
                at = self._extend(at, w)
        # the suffix of `window` words of a state's longest string lies in this state
        n = len(self.link)
        self.window_state = array("i", [-1]) * n
        by_length = np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]
        for v in by_length:
            if self.length[v] >= window:
                up = self.window_state[self.link[v]]
                self.window_state[v] = v if up < 0 else up
        self.items: dict[int, set[str]] = {}
        ends: dict[int, dict[int, set[str]]] = {}
        for name, ws in coded:
            at = 0
            for i, w in enumerate(ws):
                at = self._next(at, w)
                if i + 1 >= window and name is not None:
                    self.items.setdefault(self.window_state[at], set()).add(name)
            if len(ws) < window:
                while self.length[self.link[at]] >= len(ws):
                    at = self.link[at]
                ends.setdefault(at, {}).setdefault(len(ws), set()).update([] if name is None else [name])
        # short items that end in a state or in one it links to, longest first
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for v in by_length if ends else ():
            if got := sorted(ends.get(v, {}).items(), reverse=True) + self.short.get(self.link[v], []):
                self.short[v] = got
        self.shortest = min([window, *(len(ws) for _, ws in coded)])

    def _next(self, state: int, w: int) -> int:
        """-1 where the state has no step by that word."""
        if (more := self.steps.get(state)) is not None:
            return more.get(w, -1)
        return self.to[state] if self.word[state] == w else -1

    def _set(self, state: int, w: int, to: int) -> None:
        if (more := self.steps.get(state)) is not None:
            more[w] = to
        elif self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.steps[state] = {self.word[state]: self.to[state], w: to}

    def _new(self, link: int, length: int) -> int:
        for kept, value in ((self.word, -1), (self.to, -1), (self.link, link), (self.length, length)):
            kept.append(value)
        return len(self.link) - 1

    def _copy(self, p: int, q: int, w: int) -> int:
        c = self._new(self.link[q], self.length[p] + 1)
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.steps:
            self.steps[c] = dict(self.steps[q])
        self.link[q] = c
        while p >= 0 and self._next(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self._next(last, w)) >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, w)
        new, p = self._new(0, self.length[last] + 1), last
        while p >= 0 and self._next(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self._next(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered spans of words (start, end), merged, and the items with a window there."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        starts, ends = known[::2], known[1::2]
        long_enough = ends - starts >= self.shortest
        link, length, window, states, step = self.link, self.length, self.window, self.window_state, self._next
        for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
            at = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                while (to := step(at, w)) < 0 and at:
                    at = link[at]
                    n = length[at]
                if to < 0:
                    continue
                at, n = to, n + 1
                best = n if n >= window else 0
                if best:
                    found |= self.items.get(states[at], found)
                if at in self.short:
                    for m, names in self.short[at]:
                        if m <= n:
                            found |= names
                            best = max(best, m)
                if best:
                    start = i - best
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def _blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    # a word has a byte at least and a byte between it and the next
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n = max(1, math.ceil(size / block_words))
    if n == 1:
        return [items]
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(key == k) for k in range(n)]


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish=None) -> DataFrame:
    """``docs`` with a last column of hits: {words, spans as flat bounds, items}; one pass per block.

    ``finish``, if given, makes the last pass's rows from a batch's columns and hits, in the same worker.
    """
    name, plain = free_name(docs.columns, "own_hits"), docs.schema.fields
    hits = T.StructType([T.StructField("words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    blocks = _blocks(benchmark, block_words)
    spark = docs.sparkSession
    for k, block in enumerate(blocks):
        items = [(r["item_id"], words_of(r["text"].encode())) for r in block.collect()]  # of a block's size at most
        shared = spark.sparkContext.broadcast(Automaton(items, window))
        schema = T.StructType([*plain, T.StructField(name, hits)])

        last = finish if k + 1 == len(blocks) else None

        def scan(batches, shared=shared, at=docs.columns.index("text"), first=not k, last=last):
            for batch in batches:
                old = None if first else batch.column(batch.num_columns - 1).to_pylist()
                out = []
                for i, text in enumerate(as_bytes(batch.column(at))):
                    words = words_of(text)
                    spans, found = shared.value.scan(words)
                    if old:
                        bounds = old[i]["spans"]
                        spans = _merged([*spans, *zip(bounds[::2], bounds[1::2], strict=True)])
                        found = found | set(old[i]["items"])
                    out.append({"words": len(words), "spans": [x for s in spans for x in s], "items": sorted(found)})
                kind = pa.struct([("words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
                columns = batch.columns if first else batch.columns[:-1]
                names = batch.schema.names if first else batch.schema.names[:-1]
                if last:
                    yield last(columns, out)
                    continue
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=[*names, name])

        docs = docs.mapInArrow(scan, T.StructType(plain) if last else schema)
        if k + 1 < len(blocks):
            docs = materialise(docs, "hits")
    return docs


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document: its words, hit words, items with occurring windows and hit spans (in words)."""
    found = _scan(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_words)
    bounds = F.col("own_hits.spans")
    spans = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2, F.lit(2)), lambda i: F.struct(bounds[i].alias("start"), bounds[i + 1].alias("end")))
    spans = F.when(F.size(bounds) > 0, spans).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    out = found.select("doc_id", F.col("own_hits.words").alias("n_words"), F.col("own_hits.items").alias("item_ids"), spans.alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_span: int = 1, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans of ``min_span`` words or more, and without documents whose hit share is above ``max_coverage``.

    A removed span reaches from its first word's first character to its last word's last one.  n_chars, where present, is set anew for changed texts.  Documents without hits stay as they are.
    """
    columns, at = docs.columns, docs.columns.index("text")
    length_at = columns.index("n_chars") if "n_chars" in columns else -1

    def cut(arrays: list, found: list[dict]) -> pa.RecordBatch:
        texts, keep, lengths = [], [], {}
        for i, (text, hits) in enumerate(zip(arrays[at].to_pylist(), found, strict=True)):
            bounds = hits["spans"]
            spans = [(a, b) for a, b in zip(bounds[::2], bounds[1::2], strict=True) if b - a >= min_span]
            keep.append(not bounds or sum(b - a for a, b in zip(bounds[::2], bounds[1::2], strict=True)) <= max_coverage * hits["words"])
            if spans:
                raw = text.encode()
                words = [m.span() for m in re.finditer(rb"\S+", raw.translate(WORD_BYTES))]
                edges = [0, *(x for a, b in spans for x in (words[a][0], words[b - 1][1])), len(raw)]
                text = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode()
                lengths[i] = len(text)
            texts.append(text)
        arrays = list(arrays)
        arrays[at] = pa.array(texts, arrays[at].type)
        if length_at >= 0 and lengths:
            old = arrays[length_at].to_pylist()
            arrays[length_at] = pa.array([lengths.get(i, n) for i, n in enumerate(old)], arrays[length_at].type)
        return pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, benchmark, window, block_words, cut)
