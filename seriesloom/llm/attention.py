"""A small causal self-attention language model in numpy: forward, backward, training steps and scoring.

Tokens are subword ids marked with whether they end a white-space word, so a
sequence of tokens says where words end and its probability is that of the text.
One block of attention (with a learned bias by distance) and a two-layer
perceptron with root-mean-square norms.  The output is a tree of two levels:
GROUPS groups of MEMBERS leaves, both predicted from the context.  Frequent
tokens are leaves of their own; the others share the last leaves by frequency,
and have their smoothed share of the leaf's count.  So every token has a
probability and they sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, HIDDEN = 16, 32
CONTEXT, STRIDE = 24, 20
GROUPS, MEMBERS, SHARED = 48, 48, 48
LEAVES = GROUPS * MEMBERS
#: Windows in a step of training, and those scored together.
BATCH, SCORED_WINDOWS = 128, 256


@dataclass
class Vocabulary:
    """Per token: its leaf, and log10 of its share of the leaf. The begin of a text is input LEAVES."""

    leaf: np.ndarray
    share: np.ndarray
    leaf_count: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Vocabulary:
        n = len(counts)
        by_rank = np.lexsort((np.arange(n), -counts))
        single = min(LEAVES - SHARED, n)
        # shared leaves hold like sums of counts
        rest = counts[by_rank[single:]] + 1
        mass = np.cumsum(rest)
        own = np.minimum((mass - rest) * SHARED // max(1, int(mass[-1]) if len(mass) else 1), SHARED - 1)
        leaf = np.empty(n, np.uint16)
        leaf[by_rank] = np.concatenate([np.arange(single), single + own])
        total = np.bincount(leaf, counts + 1, LEAVES)
        return cls(leaf, np.log10((counts + 1) / total[leaf]), total)


SHAPES = {"e": (LEAVES + 1, WIDTH), "r": (CONTEXT,), "qkv": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH), "a": (WIDTH, HIDDEN), "ab": (HIDDEN,), "z": (HIDDEN, WIDTH), "u": (WIDTH + 1, GROUPS), "t": (GROUPS, WIDTH + 1, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Distance from a position back to another; beyond CONTEXT where it is not seen.
BACK = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)
SCALE = np.float32(WIDTH**-0.5)


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def fresh(vocabulary: Vocabulary, seed: int = 0) -> np.ndarray:
    """Random weights whose output is that of the token counts."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    w = split(flat)
    w["e"][...] = rng.standard_normal(SHAPES["e"]) * 0.1
    for name in ("qkv", "o", "a", "z"):
        w[name][...] = rng.standard_normal(SHAPES[name]) / np.sqrt(SHAPES[name][0])
    count = vocabulary.leaf_count.reshape(GROUPS, MEMBERS) + 1e-3
    w["u"][:-1] = rng.standard_normal((WIDTH, GROUPS)) * 0.1
    w["u"][-1] = np.log(count.sum(axis=1) / count.sum())
    w["t"][:, :-1] = rng.standard_normal((GROUPS, WIDTH, MEMBERS)) * 0.1
    w["t"][:, -1] = np.log(count / count.sum(axis=1, keepdims=True))
    return flat


def _keep_memory() -> None:
    """Takes and gives back a large array: the C library then keeps freed memory of up to twice its size, so that a step does not fault its pages in anew."""
    np.empty(31 << 20, np.uint8)


def _norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = 1 / np.sqrt(np.einsum("...i,...i->...", x, x)[..., None] / np.float32(WIDTH) + np.float32(1e-5))
    return x * r, r


def _norm_back(g: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = n * (np.einsum("...i,...i->...", g, n) * np.float32(1 / WIDTH))[..., None]
    np.subtract(g, out, out=out)
    out *= r
    return out


def _exp(x: np.ndarray) -> np.ndarray:
    """In place; a constant is taken off each row first where it could overflow."""
    if x.max(initial=0) > 60:
        x -= x.max(axis=-1, keepdims=True)
    return np.exp(x, out=x)


def _distance_weights(w: dict) -> np.ndarray:
    return np.where(BACK >= 0, np.exp(w["r"] - w["r"].max())[np.maximum(BACK, 0)], 0).astype(w["r"].dtype)


def _after_attention(w: dict, x2: np.ndarray) -> tuple:
    """``x2``: a row per position. All that follows attention, up to the rows that the output sees."""
    n2, r2 = _norm(x2)
    h = n2 @ w["a"]
    h += w["ab"]
    np.maximum(h, 0, out=h)
    n3 = h @ w["z"]
    n3 += x2
    n3, r3 = _norm(n3)
    return n2, r2, h, n3, r3


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts rows of a group beside each other, and (group, from, to) of each one there."""
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return np.argsort(group.astype(np.uint8), kind="stable"), [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def _softmax_parts(w: dict, own: np.ndarray, spans: list) -> tuple:
    """Of rows in order of their groups: exponentials of groups and of members of the own group, and their sums."""
    p, q = own @ w["u"], np.empty((len(own), MEMBERS), own.dtype)
    for g, a, b in spans:
        np.matmul(own[a:b], w["t"][g], out=q[a:b])
    p, q = _exp(p), _exp(q)
    least = np.asarray(1e-30, own.dtype)
    return p, p @ np.ones(GROUPS, own.dtype) + least, q, q @ np.ones(MEMBERS, own.dtype) + least


def forward_training(w: dict, places: np.ndarray) -> dict:
    """Arrays have a row per position; those of attention, a matrix per window."""
    shape = (*places.shape, WIDTH)
    x = w["e"][places.reshape(-1)]
    n1, r1 = _norm(x)
    qkv = (n1 @ w["qkv"]).reshape(*places.shape, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    s = _exp((q * SCALE) @ k.transpose(0, 2, 1))
    s *= _distance_weights(w)
    total = (s.reshape(-1, CONTEXT) @ np.ones(CONTEXT, s.dtype))[:, None] + np.asarray(1e-30, s.dtype)
    mixed = np.empty(shape, s.dtype)
    np.matmul(s, v, out=mixed)
    mixed = mixed.reshape(-1, WIDTH)
    mixed /= total
    x += mixed @ w["o"]
    n2, r2, h, n3, r3 = _after_attention(w, x)
    return dict(n1=n1, r1=r1, q=q, k=k, v=v, s=s, total=total, mixed=mixed, n2=n2, r2=r2, h=h, n3=n3, r3=r3)


def gradient(w: dict, places: np.ndarray, leaf: np.ndarray, weight: np.ndarray, out: dict) -> float:
    """Adds to ``out`` the gradient of the mean loss; returns that loss. Rows with weight 0 are padding."""
    f = forward_training(w, places)
    n3, kind = f["n3"], f["n3"].dtype
    (b, t), d = places.shape, WIDTH
    n = b * t
    group, member = np.divmod(leaf.reshape(-1), MEMBERS)
    order, spans = _by_group(group)
    own = np.ones((n, d + 1), kind)
    own[:, :d] = n3[order]
    wt = (weight.reshape(-1) / max(1.0, float(weight.sum()))).astype(kind)[order]
    group, member, each = group[order], member[order], np.arange(n)
    p, pz, q, qz = _softmax_parts(w, own, spans)
    least = np.asarray(1e-30, kind)
    loss = float((np.log(p[each, group] / pz + least) + np.log(q[each, member] / qz + least)) @ wt)
    p *= (wt / pz)[:, None]
    p[each, group] -= wt
    q *= (wt / qz)[:, None]
    q[each, member] -= wt
    out["u"] += own.T @ p
    ordered, part = p @ w["u"][:d].T, np.empty((n, d), kind)
    for i, a, z in spans:
        out["t"][i] += own[a:z].T @ q[a:z]
        np.matmul(q[a:z], w["t"][i, :d].T, out=part[a:z])
    ordered += part
    g = np.empty((n, d), kind)
    g[order] = ordered
    # the rest
    g3, h = _norm_back(g, n3, f["r3"]), f["h"]
    out["z"] += h.T @ g3
    gh = g3 @ w["z"].T
    gh *= h > 0
    out["a"] += f["n2"].T @ gh
    out["ab"] += np.ones(n, kind) @ gh
    g2 = _norm_back(gh @ w["a"].T, f["n2"], f["r2"])
    g2 += g3
    out["o"] += f["mixed"].T @ g2
    gm = g2 @ w["o"].T
    gm /= f["total"]
    s, q, k, v = f["s"], f["q"], f["k"], f["v"]
    dot, gm = np.einsum("ni,ni->n", gm, f["mixed"]).reshape(b, t, 1), gm.reshape(b, t, d)
    gs = gm @ v.transpose(0, 2, 1)
    gs -= dot
    gs *= s
    by_pair = gs.sum(axis=0)
    out["r"] += np.bincount(BACK[BACK >= 0], by_pair[BACK >= 0], CONTEXT).astype(kind)
    gqkv = np.empty((b, t, 3 * d), kind)
    np.matmul(gs, k, out=gqkv[..., :d])
    np.matmul(gs.transpose(0, 2, 1), q, out=gqkv[..., d : 2 * d])
    gqkv[..., : 2 * d] *= SCALE
    np.matmul(s.transpose(0, 2, 1), gm, out=gqkv[..., 2 * d :])
    gqkv = gqkv.reshape(n, 3 * d)
    out["qkv"] += f["n1"].T @ gqkv
    gx = _norm_back(gqkv @ w["qkv"].T, f["n1"], f["r1"])
    gx += g2
    at = places.reshape(-1, 1) * d + np.arange(d)
    out["e"] += np.bincount(at.reshape(-1), gx.reshape(-1), (LEAVES + 1) * d).reshape(LEAVES + 1, d)
    return -loss


class Trainer:
    """Adam over windows of CONTEXT + 1 inputs, fed batch by batch."""

    def __init__(self, flat: np.ndarray, rate: float, batch: int = BATCH):
        _keep_memory()
        self.flat, self.rate, self.batch = flat.copy(), rate, batch
        self.m, self.v, self.grad, self.change = (np.zeros(SIZE, np.float32) for _ in range(4))
        self.steps, self.loss = 0, 0.0

    def feed(self, windows: np.ndarray, valid: np.ndarray) -> None:
        """``windows``: leaves, or LEAVES for a begin. ``valid``: how many of each window count; those beyond are padding."""
        w, out = split(self.flat), split(self.grad)
        for i in range(0, len(windows), self.batch):
            own = windows[i : i + self.batch].astype(np.int64)
            weight = (np.arange(1, CONTEXT + 1) < valid[i : i + self.batch, None]).astype(np.float32)
            self.grad[:] = 0
            self.loss += gradient(w, own[:, :-1], np.minimum(own[:, 1:], LEAVES - 1), weight, out)
            self.steps += 1
            g, c = self.grad, self.change
            np.subtract(g, self.m, out=c)
            c *= np.float32(0.1)
            self.m += c
            np.multiply(g, g, out=c)
            c -= self.v
            c *= np.float32(0.01)
            self.v += c
            np.sqrt(self.v, out=c)
            c *= np.float32((1 - 0.99**self.steps) ** -0.5)
            c += np.float32(1e-8)
            np.divide(self.m, c, out=c)
            c *= np.float32(self.rate / (1 - 0.9**self.steps))
            self.flat -= c


class Scorer:
    """Scores sequences; what depends on one input alone is tabled once."""

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary):
        _keep_memory()
        self.w, self.vocabulary = split(flat), vocabulary
        x = self.w["e"]
        qkv = _norm(x)[0] @ self.w["qkv"]
        qkv[:, :WIDTH] *= SCALE
        qkv[:, 2 * WIDTH :] = qkv[:, 2 * WIDTH :] @ self.w["o"]
        self.table = np.concatenate([qkv, x], axis=1)
        self.back = _distance_weights(self.w)

    def hidden(self, places: np.ndarray, first: int) -> np.ndarray:
        """Final rows, and a one, of the positions from ``first`` on."""
        d, rows = WIDTH, self.table[places]
        s = _exp(rows[:, first:, :d] @ rows[..., d : 2 * d].transpose(0, 2, 1))
        s *= self.back[first:]
        total = (s.reshape(-1, CONTEXT) @ np.ones(CONTEXT, np.float32)).reshape(*s.shape[:2], 1) + np.float32(1e-30)
        x2 = s @ rows[..., 2 * d : 3 * d]
        x2 /= total
        x2 += rows[:, first:, 3 * d :]
        out = np.ones((*x2.shape[:2], d + 1), np.float32)
        out[..., :d] = _after_attention(self.w, x2.reshape(-1, d))[3].reshape(x2.shape)
        return out

    def log_probabilities(self, rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log of the probability of a leaf for each row that ``hidden`` gives."""
        group, member = np.divmod(leaf.astype(np.int64), MEMBERS)
        order, spans = _by_group(group)
        p, pz, q, qz = _softmax_parts(self.w, rows[order], spans)
        each = np.arange(len(rows))
        found = p[each, group[order]] / pz
        found *= q[each, member[order]] / qz
        out = np.empty(len(rows), np.float32)
        out[order] = np.log(found + np.float32(1e-30))
        return out

    def sequences(self, tokens: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of tokens, after a text's begin."""
        return self.leaf_sequences([self.vocabulary.leaf[t] for t in tokens]) + np.array([self.vocabulary.share[t].sum() for t in tokens])

    def leaf_sequences(self, leaves: list[np.ndarray]) -> np.ndarray:
        """The same of the tokens' leaves, without their shares; windows overlap and each leaf is scored once."""
        if not leaves:
            return np.zeros(0)
        sizes = np.array([len(t) for t in leaves], np.int64) + 1
        ends = np.cumsum(sizes)
        begin = ends - sizes
        real = np.ones(int(ends[-1]), bool)
        real[begin] = False
        places = np.full(int(ends[-1]) + CONTEXT + 1, LEAVES, np.uint16)
        places[: len(real)][real] = np.concatenate(leaves)
        out = np.zeros(len(places), np.float64)
        more = np.maximum(0, -(-(sizes - 1 - CONTEXT) // STRIDE))
        doc = np.arange(len(leaves))
        later = np.repeat(doc, more)
        step = np.arange(len(later)) - np.repeat(np.cumsum(more) - more, more) + 1
        for starts, docs, first in ((begin, doc, 0), (begin[later] + step * STRIDE, later, CONTEXT - STRIDE)):
            for a in range(0, len(starts), SCORED_WINDOWS):
                at, own = starts[a : a + SCORED_WINDOWS], docs[a : a + SCORED_WINDOWS]
                hidden = self.hidden(places[at[:, None] + np.arange(CONTEXT)], first)
                targets = at[:, None] + np.arange(first + 1, CONTEXT + 1)
                scored = targets < ends[own][:, None]
                picked = targets[scored]
                out[picked] = self.log_probabilities(hidden[scored], places[picked]) * (1 / np.log(10))
        return np.add.reduceat(out[: len(real)], begin)
