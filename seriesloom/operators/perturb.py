"""Distractors made from a series itself: shuffled, reversed, with two quarters swapped; each valid and unlike the others.

A candidate is valid if at least ``MOVED`` of its points differ from the series,
and if it is close to none of the distractors chosen before it.  Shuffles and
swaps have up to ``TRIES`` candidates in an order by key, and the first valid one
is taken; later ones are not made.  Where none is valid the distractor is null.
A swap needs eight points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequence import let
from .candidates import keyed_order

KINDS = ("shuffle", "reverse", "segment_swap")
MOVED, TRIES = 0.25, 20
QUARTER_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def moved(z: Column, s: Column) -> Column:
    """Share of points that differ by more than 1e-9."""
    return F.size(F.filter(F.zip_with(z, s, lambda a, b: F.abs(a - b) > 1e-9), lambda d: d)) / F.size(s)


def close(z: Column, other: Column) -> Column:
    """Whether all points agree within 1e-8 and a 1e-5 share."""
    return F.forall(F.zip_with(z, other, lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)), lambda x: x)


def valid(z: Column, s: Column, before: list[Column]) -> Column:
    ok = moved(z, s) >= MOVED
    for other in before:
        ok = ok & ~F.coalesce(close(z, other), F.lit(False))
    return ok


def shuffled(s: Column, key: Column, attempt: Column) -> Column:
    order = F.array_sort(F.transform(s, lambda x, i: F.struct(keyed_order(key, attempt, i).alias("h"), i.alias("i"), x.alias("x"))))
    return F.transform(order, lambda p: p["x"])


def swapped(s: Column, pair: Column) -> Column:
    """``s`` in four blocks, the two of ``pair`` (a place in QUARTER_PAIRS) exchanged."""
    edge = lambda q: F.floor(F.size(s) * q / 4).cast("int")
    block = lambda q: F.slice(s, edge(q) + 1, edge(q + 1) - edge(q))
    out = F.lit(None).cast("array<double>")
    for n, (i, j) in enumerate(QUARTER_PAIRS):
        order = [j if q == i else i if q == j else q for q in range(4)]
        out = F.when(pair == n, F.concat(*map(block, order))).otherwise(out)
    return F.when(F.size(s) >= 8, out)


def first_valid(candidates: Column, make: Callable[[Column], Column], s: Column, before: list[Column]) -> Column:
    """The first of the candidates, made one by one, that is valid."""
    none = F.lit(None).cast("array<double>")
    return F.aggregate(candidates, none, lambda got, t: F.when(got.isNotNull(), got).otherwise(let(make(t), lambda z: F.when(valid(z, s, before), z))))


def perturbed(s: Column, key: Column) -> Column:
    """struct<shuffle, reverse, segment_swap> of arrays."""
    shuffle = first_valid(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: shuffled(s, key, t), s, [])
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(len(QUARTER_PAIRS) - 1)), lambda p: F.struct(keyed_order(key, F.lit("pair"), p).alias("h"), p.alias("p"))))
    pairs = F.transform(pairs, lambda x: x["p"])

    def reverse_and_swap(shuffle: Column) -> Column:
        reverse = first_valid(F.array(F.lit(0)), lambda t: F.reverse(s), s, [shuffle])
        return let(reverse, lambda reverse: F.struct(shuffle.alias("shuffle"), reverse.alias("reverse"), first_valid(pairs, lambda p: swapped(s, p), s, [shuffle, reverse]).alias("segment_swap")))

    return let(shuffle, reverse_and_swap)
