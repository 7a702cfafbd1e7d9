"""Language-model scores of whole texts by a causal self-attention model on subword ids.

A text is its words (between ASCII white space, A-Z lower-cased) as subword ids,
each marked with whether it ends a word, and then an end.  The score is log10 of
the attention model's (``attention``) probability of these tokens, without any
other model: texts are scored whole in overlapping windows, each token once.

The model is trained in data-parallel rounds over all tokens of the training
texts, at every size alike: each text belongs to one shard of one round, by a hash
of its row, and gives windows that follow each other, so each token is predicted
once in training.  A shard has about ``SHARD_TOKENS`` tokens; shards of a round
train side by side and their weights are averaged in stages of ``FAN_IN``.  There
are three rounds, and one more each time the shards double beyond ``SIDE_BY_SIDE``
a round.  Texts are encoded once, into a stored table that training and scoring read.  Shards, rounds and the order of texts follow from the texts alone, so
the number of partitions, executors or batches does not change the model.

Counts cover all texts.  Words are counted in Spark, and token counts follow from
the word counts.  The most frequent ``FREQUENT`` words go to the executors for
the base score; the other words of a text are joined with the count table, so no
count is lost and no such word is in many texts.

Null and empty texts hold only the end.  A word that the tokenizer gives no ids
has no part in the score.  Rows with a null doc_id are held out.  Repeated rows
are scored alike.  Very long texts are split into words block by block.  Extra
columns are ignored.  An empty table gives an empty one.  Without training texts,
N and V are 0.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import CONTEXT, LEAVES, Scorer, Trainer, Vocabulary, fresh
from .common import as_bytes, materialise, spread, word_blocks, worker_state
from .tokens import default_tokenizer, encoder

FREQUENT = 200_000
#: Rates of the first and the last training round; those between fall by equal factors.
FIRST_RATE, LAST_RATE, LEAST_ROUNDS = 2e-2, 3e-3, 3
#: Training tokens of a shard, shards of a round before there are more rounds, and texts that are fed together.
SHARD_TOKENS, SIDE_BY_SIDE, FED_TEXTS = 1_000_000, 8, 128
#: Words that a task counts before it hands them on.
HELD_WORDS = 1_000_000
#: Weights that are averaged in one task.
FAN_IN = 8
#: Tokens scored together, words beside the common ones whose tokens a worker keeps, and parts of words whose ids it keeps.
SCORED, KEPT_WORDS, CACHED_PARTS = 1 << 16, 600_000, 150_000


def held_out(doc_id, folds: int, fold: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def training_plan(n_tokens: int) -> tuple[int, int, list[float]]:
    """Rounds, shards of each, and the rounds' rates."""
    shards = max(1, -(-n_tokens // SHARD_TOKENS))
    rounds = LEAST_ROUNDS + max(0, math.ceil(math.log2(shards / (LEAST_ROUNDS * SIDE_BY_SIDE))))
    return rounds, -(-shards // rounds), [FIRST_RATE * (LAST_RATE / FIRST_RATE) ** (i / (rounds - 1)) for i in range(rounds)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): times in training texts and in all texts, counted in each task first. ``docs``: text, held_out."""

    def count(batches):
        train, others = Counter(), Counter()

        def hand_on():
            for held, trained in ((train, True), (others, False)):
                words, n = list(held), list(held.values())
                held.clear()
                for i in range(0, len(words), 50_000):
                    all_n = pa.array(n[i : i + 50_000], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), all_n if trained else pa.array([0] * len(all_n), pa.int64()), all_n], names=["word", "c", "n"])

        for batch in batches:
            for text, out in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for block in word_blocks(text):
                    (others if out else train).update(block.lower().split())
                if len(train) + len(others) > HELD_WORDS:
                    yield from hand_on()
        yield from hand_on()

    return docs.select("text", "held_out").mapInArrow(count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _marked(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of words, from their ids, and each word's number of them."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    marked = np.frombuffer(b"".join(pieces), "<u4") * 2
    marked[np.cumsum(sizes)[sizes > 0] - 1] += 1
    return marked, sizes


class Tokens:
    """Tokens of texts: twice a subword id, and one more where it ends a word.

    A word is looked up once and has a number; its tokens lie in one array with those of
    the others. Those of ``common`` have the first numbers and stay, the others are
    forgotten together once there are more than ``KEPT_WORDS``.
    """

    def __init__(self, tokenizer: str, common: list[bytes] = ()):
        self.encoder, self.n_common = encoder(tokenizer), len(common)
        self.number: dict[bytes, int] = {}
        self.size, self.start, self.held, self.end = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, "<u4"), 0
        for i in range(0, len(common), 50_000):
            self._learn(common[i : i + 50_000], False)

    def _learn(self, chunks: list[bytes], lowered: bool) -> None:
        if len(self.encoder.cache) > CACHED_PARTS:  # whole words are known here already; their parts come again
            self.encoder.cache.clear()
        marked, sizes = _marked(self.encoder.pieces(chunks, lowered))
        n, more = len(self.number), len(self.number) + len(chunks)
        if more > len(self.size):
            self.size, self.start = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.size, self.start))
        if self.end + len(marked) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(self.end + len(marked), "<u4")])
        self.size[n:more] = sizes
        self.start[n:more] = self.end + np.cumsum(sizes) - sizes
        self.held[self.end : self.end + len(marked)] = marked
        self.end += len(marked)
        self.number.update(zip(chunks, range(n, more)))

    def numbers(self, chunks: list[bytes], lowered: bool) -> np.ndarray:
        """Each chunk's number; valid until the next call."""
        if len(self.number) - self.n_common > KEPT_WORDS:
            self.number = dict(islice(self.number.items(), self.n_common))
            self.end = int(self.size[: self.n_common].sum())
        found = np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(found < 0)
        if len(new):
            own = [chunks[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(own)), lowered)
            found[new] = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
        return found

    def of(self, blocks: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of blocks of text: their words, lower-cased, these words' numbers (``n_common`` or more where not common), all tokens, and each block's number of words and of tokens."""
        split = [b.lower().split() for b in blocks]
        words = list(chain.from_iterable(split))
        # a special token's name keeps its case, and its ids, only if it is not lower-cased
        lowered = self.encoder.by_chunk and not any(b"<|" in b for b in blocks)
        chunks = words if lowered else list(chain.from_iterable(w if self.encoder.by_chunk and b"<|" not in b else b.split() for b, w in zip(blocks, split)))
        found = self.numbers(chunks, lowered)
        sizes = self.size[found]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[found] - ends + sizes, sizes)
        at += np.arange(len(at))
        tokens = self.held[at]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        n_tokens = np.diff(np.append(0, ends)[np.append(0, np.cumsum(n_words))])
        return words, found if lowered else self.numbers(words, False), tokens, n_words, n_tokens

    def whole(self, text: bytes, end: int) -> np.ndarray:
        return np.concatenate([*(self.of([b])[2] for b in word_blocks(text)), np.array([end], "<u4")])


def block_groups(texts: list[bytes], size: int = 1 << 20):
    """(places, blocks): the texts' blocks in their order, those of about ``size`` bytes at a time, and the place of each one's text."""
    places, blocks, held = [], [], 0
    for i, text in enumerate(texts):
        for block in word_blocks(text, size):
            places.append(i)
            blocks.append(block)
            held += len(block)
            if held >= size:
                yield np.array(places), blocks
                places, blocks, held = [], [], 0
    if blocks:
        yield np.array(places), blocks


def tokens(tokenizer: str, call: str, common: list[bytes]) -> Tokens:
    """The worker's, with what it learned since ``call`` began."""
    state = worker_state(("tokens", tokenizer))
    if state.get("call") != call:
        state.clear()
        state.update(call=call, t=Tokens(tokenizer, common))
    return state["t"]


def token_counts(words: DataFrame, tokenizer: str) -> DataFrame:
    """(id, n): tokens of each counted word, as often as the word is in training texts."""

    def count(batches):
        enc = encoder(tokenizer)
        total = np.zeros(0, np.int64)
        for batch in batches:
            marked, sizes = _marked(enc.pieces(batch.column(0).to_pylist()))
            got = np.bincount(marked, np.repeat(batch.column(1).to_numpy(), sizes)).astype(np.int64)
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return words.select("word", "c").where("c > 0").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _frequent_from(words: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, to an eighth of a power of two: from a histogram, so nothing is sorted."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, held = 1 << 62, 0
    for r in sorted(words.groupBy(step.alias("b")).agg(F.count("n").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["b"]):  # 8 rows a doubling
        held += r["k"]
        if held > most:
            break
        least = r["n"]
    return least


def training_windows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of CONTEXT + 1 leaves, in mixed order, and the number of leaves in each.

    A text's windows follow each other and share one leaf, so that each leaf after
    its begin is predicted in one window.
    """
    held, valid = [np.zeros((0, CONTEXT + 1), np.uint16)], [np.zeros(0, np.int64)]
    for leaves in sequences:
        starts = np.arange(0, len(leaves), CONTEXT)
        padded = np.zeros(len(starts) * CONTEXT + 1, np.uint16)
        padded[0] = LEAVES
        padded[1 : len(leaves) + 1] = leaves
        held.append(np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + 1)[::CONTEXT])
        valid.append(np.minimum(len(leaves) + 1 - starts, CONTEXT + 1))
    order = np.random.default_rng(0).permutation(sum(map(len, valid)))
    return np.concatenate(held)[order], np.concatenate(valid)[order]


def encoded(docs: DataFrame, vocabulary: Vocabulary, tokenizer: str, end: int, common: dict | None = None, texts: int = 0, below: float = 0.0) -> DataFrame:
    """All that scores need of each text but the weights. ``docs``: doc_id, text, held_out.

    ``leaves`` are those of its tokens, as 16-bit integers, and ``share`` is the sum of
    their shares; ``base`` and ``n_known`` are of its end and its words in ``common``, and
    ``rest`` counts its other words.  ``key`` is a hash of the row.
    """
    common = common or {}
    counts = np.fromiter(common.values(), np.int64, len(common))
    # the last number stands for all words that are not common
    per_word = np.append(np.log10(counts + 1) - below, 0), np.append(counts > 0, False)
    shared, call = docs.sparkSession.sparkContext.broadcast((vocabulary, list(common), *per_word)), uuid.uuid4().hex

    def encode(batches):
        vocabulary, common, base_of, is_known = shared.value
        own_tokens, others = tokens(tokenizer, call, common), len(common)

        def some(texts_here: list[bytes]) -> list:
            n = len(texts_here)
            n_words, n_leaves, n_rest = np.ones(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64)
            known, base, share = np.full(n, int(texts > 0)), np.full(n, math.log10(texts + 1) - below), np.full(n, float(vocabulary.share[end]))
            parts, rest_words, rest_n = [], [], []
            for places, blocks in block_groups(texts_here):
                ws, numbers, part, word_n, token_n = own_tokens.of(blocks)
                place = np.repeat(places, word_n)
                rare = np.flatnonzero(numbers >= others)
                _, first, times = np.unique(place[rare] << 32 | numbers[rare], return_index=True, return_counts=True)
                rare = rare[first]
                rest_words += [ws[i] for i in rare.tolist()]
                rest_n.append(times)
                np.minimum(numbers, others, out=numbers)
                for total, at, weights in ((n_words, places, word_n), (n_leaves, places, token_n), (n_rest, place[rare], None), (known, place, is_known[numbers]), (base, place, base_of[numbers]), (share, np.repeat(places, token_n), vocabulary.share[part])):
                    total += np.bincount(at, weights, n).astype(total.dtype)
                parts.append(vocabulary.leaf[part])
            ends = np.cumsum(n_leaves)
            leaves = np.full(ends[-1], vocabulary.leaf[end], "<u2")
            inner = np.ones(len(leaves), bool)
            inner[ends - 1] = False
            leaves[inner] = np.concatenate(parts)
            structs = pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(np.concatenate(rest_n))], names=["word", "n"])
            of_leaves = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(leaves)])
            return [*map(pa.array, (n_words, known, base, share)), of_leaves, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rest)), pa.int32()), structs)]

        for batch in batches:
            found = as_bytes(batch.column(0))
            group = np.cumsum([len(t) for t in found]) >> 20
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(found)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), *some(found[a:b])], names=["doc_id", "held_out", "key", "n_tokens", "n_known", "base", "share", "leaves", "rest"])

    kind = "doc_id long, held_out boolean, key long, n_tokens long, n_known long, base double, share double, leaves binary, rest array<struct<word:binary,n:long>>"
    return docs.select("text", F.col("doc_id").cast("long"), "held_out", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(encode, kind)


def fit(train: DataFrame, n_tokens: int, vocabulary: Vocabulary, tokenizer: str, end: int) -> np.ndarray:
    """Weights after rounds of side-by-side training and averaging, each over texts of its own. ``train``: texts, or what ``encoded`` gave of them."""
    spark = train.sparkSession
    flat = fresh(vocabulary)
    rounds, shards, rates = training_plan(n_tokens)
    if "leaves" not in train.columns:
        train = encoded(train.withColumn("held_out", F.lit(False)), vocabulary, tokenizer, end)
    dealt = train.select("leaves", "key", F.pmod(F.xxhash64("key"), F.lit(rounds * shards)).alias("shard"))
    for i, rate in enumerate(rates):
        own = dealt.where((F.col("shard") >= i * shards) & (F.col("shard") < (i + 1) * shards))
        own = own.repartition(shards, "shard").sortWithinPartitions("shard", "key").select("leaves", "shard")
        shared = spark.sparkContext.broadcast(flat)

        def learn(batches, shared=shared, rate=rate):
            trainer, n, now, held = None, 0, None, []

            def feed():
                nonlocal n
                windows, valid = training_windows(held)
                trainer.feed(windows, valid)
                n += len(windows)
                held.clear()

            def done():
                feed()
                return pa.RecordBatch.from_arrays([pa.array([(trainer.flat.astype(np.float64) * n).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])

            for batch in batches:
                for leaves, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if shard != now:
                        if trainer:
                            yield done()
                        trainer, n, now = Trainer(shared.value, rate), 0, shard
                    held.append(np.frombuffer(leaves, "<u2"))
                    if len(held) == FED_TEXTS:
                        feed()
            if trainer:
                yield done()

        def add(batches):
            total, n = 0.0, 0
            for batch in batches:
                for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total, n = total + np.frombuffer(w), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])

        sums, some = own.mapInArrow(learn, "w binary, n long"), shards
        while some > FAN_IN:
            some = -(-some // FAN_IN)
            sums = sums.repartition(some).mapInArrow(add, "w binary, n long")
        sums = sums.collect()  # FAN_IN rows at most
        shared.unpersist()
        if sums:
            flat = (sum(np.frombuffer(r["w"]) for r in sums) / sum(r["n"] for r in sums)).astype(np.float32)
    return flat


def lm_scores(docs: DataFrame, tokenizer: str | None = None, folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id").cast("long"), folds, fold).alias("held_out"))
    texts = docs.where("not held_out").count()
    words = materialise(word_counts(docs), "words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = n + texts, v + (texts > 0)
    # the id beyond the tokenizer's own marks a text's end
    from tokenizers import Tokenizer

    end = 2 * Tokenizer.from_file(tokenizer).get_vocab_size() + 1
    counts = np.zeros(end + 1, np.int64)
    for r in token_counts(words, tokenizer).collect():  # two rows per id of the vocabulary at most
        counts[r["id"]] = r["n"]
    counts[end] = texts
    vocabulary = Vocabulary.from_counts(counts)
    least = _frequent_from(words, FREQUENT)
    # FREQUENT rows at most; the most frequent first, so that lookups find them close together
    common = {bytes(r["word"]): r["c"] for r in sorted(words.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))}
    below = math.log10(n + v + 1)
    whole = materialise(encoded(docs, vocabulary, tokenizer, end, common, texts, below).withColumn("row", F.monotonically_increasing_id()), "sequences")
    flat = fit(whole.where("not held_out"), int(counts.sum()), vocabulary, tokenizer, end)
    shared = spark.sparkContext.broadcast((flat, vocabulary))

    def score(batches):
        scorer = Scorer(*shared.value)
        for batch in batches:
            scores, held, size = [np.zeros(0)], [], 0
            for leaves in batch.column(0).to_pylist():
                held.append(np.frombuffer(leaves, "<u2"))
                size += len(held[-1])
                if size > SCORED:
                    scores.append(scorer.leaf_sequences(held))
                    held, size = [], 0
            scores.append(scorer.leaf_sequences(held))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(scores) + batch.column(1).to_numpy())], names=[*names, "score"])

    names = ["share", "doc_id", "held_out", "n_tokens", "n_known", "base", "row"]
    kind = "share double, doc_id long, held_out boolean, n_tokens long, n_known long, base double, row long, score double"
    done = materialise(spread(whole.select("leaves", *names)).mapInArrow(score, kind), "scores")
    rest = whole.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    rest = rest.join(words.where(F.col("n") < least).select("word", "c"), "word")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * (F.log10(F.col("c") + 1) - F.lit(below))).alias("b"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("k"))
    zero = F.lit(0)
    return done.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        "score",
    )
