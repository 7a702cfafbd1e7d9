"""Toxicity: character n-gram linear classifier scaled by naive Bayes log-count ratios.

Features are character n-grams (lower case) hashed into 2**BITS slots; a
document has a feature or not.  Slot counts by class over the training rows are
summed on executors; the ``features`` slots that tell the classes apart best
(two-proportion z score) get a log-count ratio, and logistic regression is
fitted on the ratio-scaled features of the training rows.

At most about ``max_rows`` labelled rows train the model: ids are taken by hash
at the rate that gives so many.  Whole texts are scored, in blocks that overlap
by an n-gram.

Null and empty texts have no features: their score follows the intercept.
Repeated labels of an id are toxic if one is; null labels and null ids never
train.  Without labelled rows all scores are 0.  Repeated documents are scored
alike.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

BITS = 20
SIZES = (3, 4, 5)
BLOCK = 1 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def slots(text: str | None) -> list[np.ndarray]:
    """Hashed n-grams, with repeats, block by block."""
    if not text:
        return []
    out = []
    lower = f" {text.lower()} "
    for a in range(0, len(lower), BLOCK):
        chars = np.frombuffer(lower[a : a + BLOCK + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        h = chars.copy()
        for n in range(2, max(SIZES) + 1):
            if n > len(chars):
                break
            h = h[:-1] * np.uint32(0x01000193) + chars[n - 1 :] + np.uint32(n)
            if n in SIZES:
                own = h[: len(chars) - n + 1 - max(0, len(chars) - BLOCK - n + 1)]
                out.append(((own ^ own >> np.uint32(15)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return out


@dataclass
class Model:
    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Place of each slot among the features, or -1."""
        out = np.full(1 << BITS, -1, np.int16)
        out[self.slot] = np.arange(len(self.slot))
        return out


def present(text: str | None, table: np.ndarray) -> np.ndarray:
    """Places of the features that a text has."""
    found = [x[x >= 0] for x in (table[s] for s in slots(text))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int16)


def _training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id"), folds) != 0)
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", (F.col("toxic") == 1).cast("int").alias("toxic"))


def _slot_counts(rows: DataFrame) -> DataFrame:
    """(slot, pos, neg): training rows of each class that have a slot."""

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if got := slots(text):
                    total[toxic, np.unique(np.concatenate(got))] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, total[1, at], total[0, at])], names=["slot", "pos", "neg"])

    return rows.mapInArrow(count, "slot long, pos long, neg long").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean log loss."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    look_w, look_b, t = w.copy(), b, 1.0
    square = x[:: max(1, n // 2000)].astype(np.float64)
    v = np.ones(d) / np.sqrt(max(d, 1))
    for _ in range(20):  # the largest curvature
        v = square.T @ (square @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * (float(np.linalg.norm(square @ v) ** 2) / len(square) + 1) * 1.2 + penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look_w + look_b, -30, 30)))
        g = (p - y).astype(np.float32)
        new_w = look_w - step * (x.T @ g / n + penalty * look_w)
        new_b = look_b - step * float(g.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w, look_b = new_w + (t - 1) / t_new * (new_w - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new_w.astype(np.float32), new_b, t_new
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, features: int = 2048, folds: int = 5, min_count: int = 4) -> Model | None:
    """None without labelled rows. Rows of fold 0 never train."""
    rows = materialise(_training_rows(docs, labels, max_rows, folds), "labelled")
    n_pos, n_neg = (r := rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())[0] or 0, r[1] or 0
    if not n_pos + n_neg:
        return None
    p, q = (F.col("pos") + 1) / (n_pos + 2), (F.col("neg") + 1) / (n_neg + 2)
    mean = (F.col("pos") + F.col("neg") + 1) / (n_pos + n_neg + 2)
    z = F.abs(p - q) / F.sqrt(mean * (1 - mean) * (1 / (n_pos + 1) + 1 / (n_neg + 1)))
    best = _slot_counts(rows).where(F.col("pos") + F.col("neg") >= min_count).select("slot", F.log(p / q).alias("ratio"), z.alias("z")).orderBy(F.desc("z"), "slot").limit(features).collect()
    slot, ratio = np.array([r["slot"] for r in best], np.int64), np.array([r["ratio"] for r in best], np.float32)
    model = Model(slot, np.zeros(len(slot), np.float32), 0.0)
    table = model.table()

    def hits(batches):
        for batch in batches:
            got = [present(t, table).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int16())), batch.column(1)], names=["at", "toxic"])

    found = rows.mapInArrow(hits, "at array<short>, toxic int").collect()  # of about max_rows rows
    discard(rows)
    x, y = np.zeros((len(found), len(slot)), np.float32), np.array([r["toxic"] for r in found], np.float32)
    for i, r in enumerate(found):
        x[i, r["at"]] = 1
    w, bias = fit_logistic(x * ratio, y)
    model.weight, model.bias = w * ratio, bias
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score)."""
    table = model.table() if model else None

    def scores(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [1 / (1 + np.exp(-np.clip(model.bias + float(model.weight[present(t, table)].sum()), -700, 700))) for t in texts] if model else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scores, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without rows whose score reaches the threshold."""
    model = train(docs, labels)
    if model is None:
        return docs
    table, at = model.table(), docs.columns.index("text")
    limit = float(np.log(threshold / (1 - threshold)))

    def keep(batches):
        for batch in batches:
            mask = [model.bias + float(model.weight[present(t, table)].sum()) < limit for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
