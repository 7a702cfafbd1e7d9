"""Expressions over one ``array<double>`` series: all stay in whole-stage code on the JVM.

Deviations are population ones.  Positions count from 0.  An empty or null series
gives null.  Ties go to the first place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once: inside a lambda nothing else is shared."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x)


def mean(s: Column) -> Column:
    return F.when(F.size(s) > 0, total(s) / F.size(s))


def pop_std(s: Column) -> Column:
    return let(s, lambda s: let(mean(s), lambda m: F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(s), F.lit(0)))))


def is_finite(s: Column) -> Column:
    """No null, NaN or infinity among the values."""
    return F.forall(s, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def legible(s: Column, low: int = 8, high: int = 60, distinct: int = 3) -> Column:
    """Few enough points to read, and more than ``distinct`` values."""
    return F.size(s).between(low, high) & (F.size(F.array_distinct(s)) > distinct)


def tail(s: Column) -> Column:
    return F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))


def body(s: Column) -> Column:
    return F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))


def diffs(s: Column) -> Column:
    return F.zip_with(tail(s), body(s), lambda b, a: b - a)


def index(s: Column) -> Column:
    """0 .. n-1 as doubles."""
    return F.transform(s, lambda x, i: i.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def centred(s: Column) -> Column:
    return let(s, lambda s: let(mean(s), lambda m: F.transform(s, lambda x: x - m)))


def slope(s: Column) -> Column:
    """Least-squares slope against the position."""
    return let(centred(index(s)), lambda i: dot(i, s) / F.nullif(dot(i, i), F.lit(0.0)))


def intercept(s: Column) -> Column:
    return mean(s) - slope(s) * (F.size(s) - 1) / 2


def correlation(a: Column, b: Column) -> Column:
    """Pearson; null where either side is constant."""
    return let(centred(a), lambda x: let(centred(b), lambda y: dot(x, y) / F.nullif(F.sqrt(dot(x, x) * dot(y, y)), F.lit(0.0))))


def lag1_autocorrelation(s: Column) -> Column:
    return correlation(body(s), tail(s))


def mean_abs_diff(s: Column) -> Column:
    return mean(F.transform(diffs(s), lambda d: F.abs(d)))


def turning_points(s: Column) -> Column:
    """Neighbouring steps of opposite sign."""
    return let(diffs(s), lambda d: F.size(F.filter(F.zip_with(body(d), tail(d), lambda a, b: a * b), lambda p: p < 0)).cast("long"))


def argmax(s: Column) -> Column:
    return F.array_position(s, F.array_max(s)) - 1


def argmin(s: Column) -> Column:
    return F.array_position(s, F.array_min(s)) - 1


def scope_window(s: Column, scope: Column) -> Column:
    """The part of a series that a scope names: whole, after_peak, before_peak, after_trough, before_trough (half open)."""
    n, peak, trough = F.size(s), argmax(s).cast("int"), argmin(s).cast("int")
    return (
        F.when(scope == "after_peak", F.slice(s, peak + 1, n - peak))
        .when(scope == "before_peak", F.slice(s, F.lit(1), peak))
        .when(scope == "after_trough", F.slice(s, trough + 1, n - trough))
        .when(scope == "before_trough", F.slice(s, F.lit(1), trough))
        .otherwise(s)
    )


def fraction_index(s: Column, fraction: Column) -> Column:
    """Nearest position to a fraction of the length, halves to even, inside the series."""
    return F.least(F.greatest(F.bround(fraction * (F.size(s) - 1)), F.lit(0.0)), (F.size(s) - 1).cast("double")).cast("int")


def part(s: Column, first: Column, last: Column) -> Column:
    """Positions first to last, both included."""
    return F.slice(s, first + 1, last - first + 1)


def region_score(s: Column, metric: Column) -> Column:
    """Score of a region for a metric: higher wins."""

    def one(s: Column, d: Column) -> Column:
        return (
            F.when(metric == "max", F.array_max(s))
            .when(metric == "min", -F.array_min(s))
            .when(metric == "mean_high", mean(s))
            .when(metric == "mean_low", -mean(s))
            .when(metric == "steepest_rise", F.array_max(d))
            .when(metric == "steepest_fall", -F.array_min(d))
            .when(metric == "net_rise", F.element_at(s, -1) - F.element_at(s, 1))
            .when(metric == "net_fall", F.element_at(s, 1) - F.element_at(s, -1))
            .when(metric == "most_volatile", pop_std(d))
            .when(metric == "least_volatile", -pop_std(d))
        )

    return let(s, lambda s: let(diffs(s), lambda d: one(s, d)))


def detrended(s: Column) -> Column:
    return let(slope(s), lambda b: let(intercept(s), lambda a: F.transform(s, lambda x, i: x - (a + b * i))))


def roughness(s: Column) -> Column:
    """Deviation around the least-squares line, as a share of the range."""
    return pop_std(detrended(s)) / F.nullif(F.array_max(s) - F.array_min(s), F.lit(0.0))


def shape(s: Column) -> Column:
    """One of seven shapes, from range, net change, residual spread and where the extremes lie."""
    spread = F.array_max(s) - F.array_min(s)
    last = F.greatest(F.size(s) - 1, F.lit(1))
    facts = F.struct(
        (spread <= 1e-9 * (F.abs(mean(s)) + 1)).alias("still"),
        ((F.element_at(s, -1) - F.element_at(s, 1)) / F.nullif(spread, F.lit(0.0))).alias("net"),
        roughness(s).alias("rough"),
        (argmax(s) / last).between(0.25, 0.75).alias("top"),
        (argmin(s) / last).between(0.25, 0.75).alias("low"),
    )
    return let(
        facts,
        lambda f: F.when(f["still"], "flat")
        .when((f["net"] >= 0.6) & (f["rough"] < 0.2), "rising")
        .when((f["net"] <= -0.6) & (f["rough"] < 0.2), "falling")
        .when(f["top"] & (F.abs(f["net"]) < 0.4) & ~f["low"], "peak")
        .when(f["low"] & (F.abs(f["net"]) < 0.4) & ~f["top"], "valley")
        .when(f["rough"] >= 0.25, "volatile")
        .otherwise("mixed"),
    )


def local_features(s: Column, kind: str, prominence: float = 0.12) -> Column:
    """Inner points above (peak) or below (dip) both neighbours by a share of the range; a constant series has none."""
    need = (F.array_max(s) - F.array_min(s) + 1e-9) * prominence
    sign = 1.0 if kind == "peak" else -1.0
    inner = F.filter(F.sequence(F.lit(1), F.greatest(F.size(s) - 2, F.lit(1))), lambda i: (i >= 1) & (i <= F.size(s) - 2))
    at = lambda i: F.element_at(s, (i + 1).cast("int")) * sign
    return let(need, lambda need: F.size(F.filter(inner, lambda i: (at(i) - at(i - 1) >= need) & (at(i) - at(i + 1) >= need))).cast("long"))


def flat_run(s: Column, tolerance: float = 0.02) -> Column:
    """Longest run of points whose steps stay within a share of the range: struct(start, length), the first on ties."""
    none = F.struct(F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit(0).alias("best_start"), F.lit(1).alias("best"))
    steps = F.transform(diffs(s), lambda d, i: F.struct(F.abs(d).alias("d"), (i + 1).alias("i")))

    def go(a: Column, x: Column, limit: Column) -> Column:
        start = F.when(x["d"] <= limit, a["start"]).otherwise(x["i"])
        length = x["i"] - start + 1
        better = length > a["best"]
        return F.struct(start.alias("start"), length.alias("length"), F.when(better, start).otherwise(a["best_start"]).alias("best_start"), F.when(better, length).otherwise(a["best"]).alias("best"))

    limit = (F.array_max(s) - F.array_min(s)) * tolerance
    done = let(limit, lambda limit: F.aggregate(steps, none, lambda a, x: go(a, x, limit)))
    return let(done, lambda d: F.struct(d["best_start"].cast("long").alias("start"), d["best"].cast("long").alias("length")))


def value_at(s: Column, i: Column) -> Column:
    """The value at a position, which is moved inside the series if need be."""
    return F.element_at(s, (F.least(F.greatest(i, F.lit(0)), F.size(s) - 1) + 1).cast("int"))


def trend_word(s: Column, limit: float = 0.5) -> Column:
    move = slope(s) * F.size(s) / F.nullif(pop_std(s), F.lit(0.0))
    return F.when(move > limit, "upward").when(move < -limit, "downward").otherwise("flat")


def autocorrelation(x: Column, lag: Column) -> Column:
    """Of a series that is centred already."""
    n = F.greatest(F.size(x) - lag, F.lit(0))
    return dot(F.slice(x, F.lit(1), n), F.slice(x, lag + 1, n)) / F.nullif(dot(x, x), F.lit(0.0))


def season(s: Column, floor: float = 0.3) -> Column:
    """The lag from 2 to half the length with the highest autocorrelation, if above ``floor``; else null."""
    lags = F.sequence(F.lit(2), F.greatest(F.floor(F.size(s) / 2).cast("int"), F.lit(2)))
    best = let(centred(s), lambda x: F.array_max(F.transform(lags, lambda k: F.struct(F.round(autocorrelation(x, k), 9).alias("r"), (-k).alias("lag")))))
    return let(best, lambda b: F.when(b["r"] > floor, -b["lag"]).cast("long"))


def seasonal_naive(s: Column, horizon: int, period: Column) -> Column:
    """The last ``period`` values again and again."""
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.element_at(s, (F.size(s) - period + 1 + F.pmod(i, period)).cast("int")))


def z_normalised(s: Column) -> Column:
    return let(F.coalesce(F.nullif(pop_std(s), F.lit(0.0)), F.lit(1.0)), lambda d: F.transform(centred(s), lambda x: x / d))


def resampled(s: Column, points: int) -> Column:
    """Linear interpolation at evenly spaced places."""

    def one(s: Column, i: Column) -> Column:
        place = i * (F.size(s) - 1) / (points - 1)
        low = F.floor(place)
        weight = place - low
        return F.element_at(s, (low + 1).cast("int")) * (1 - weight) + F.element_at(s, F.least(low + 2, F.size(s)).cast("int")) * weight

    return let(s, lambda s: F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: one(s, i)))


def block_means(s: Column, blocks: int = 4) -> Column:
    """Means of neighbouring blocks; the first n mod ``blocks`` are one longer."""
    base, more = F.floor(F.size(s) / blocks), F.size(s) % blocks

    def one(b: Column) -> Column:
        start = b * base + F.least(b, more)
        return mean(F.slice(s, (start + 1).cast("int"), (base + F.when(b < more, 1).otherwise(0)).cast("int")))

    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), one)


def sample_points(s: Column, points: int) -> Column:
    """Distinct evenly spaced positions, halves to even."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.bround(i * (F.size(s) - 1) / F.lit(float(points - 1))).cast("int")))


def shared_values(a: Column, b: Column, digits: int = 6) -> Column:
    """How many of b's values occur anywhere in a."""
    return let(F.transform(a, lambda x: F.round(x, digits)), lambda own: F.size(F.filter(b, lambda x: F.array_contains(own, F.round(x, digits)))).cast("long"))


def nearest_gap(s: Column, value: Column) -> Column:
    """Distance of a value to the closest point, in deviations of the series."""
    return F.array_min(F.transform(s, lambda x: F.abs(value - x))) / F.nullif(pop_std(s), F.lit(0.0))


def entropy_bits(counts: Column) -> Column:
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(n, lambda n: -F.aggregate(F.filter(F.transform(counts, lambda c: c / n), lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def axis_bins(positions: Column, n: Column, bins: int = 10) -> Column:
    """Distinct bins of the axis that positions fall in."""
    return F.array_distinct(F.transform(positions, lambda a: F.least(F.lit(bins - 1), F.floor(a / n * bins).cast("int"))))


def quantised(s: Column, bins: int = 10_000) -> Column:
    """Min-max scaled values as centres of right-closed bins."""
    facts = F.struct(F.array_min(s).alias("low"), F.nullif(F.array_max(s) - F.array_min(s), F.lit(0.0)).alias("spread"))
    return let(facts, lambda f: F.transform(s, lambda x: (F.greatest(F.ceil(F.coalesce((x - f["low"]) / f["spread"], F.lit(0.5)) * bins), F.lit(1)) - 0.5) / bins))


def position_word(fraction: Column) -> Column:
    return F.when(fraction < 1 / 3, "early").when(fraction < 2 / 3, "mid").otherwise("late")


def reversed_segments(s: Column, cut: Column) -> Column:
    """The part after ``cut`` values, then the part before: a swap of two segments."""
    return F.concat(F.slice(s, cut + 1, F.size(s) - cut), F.slice(s, F.lit(1), cut))


def serialised(s: Column, mark: str = "###") -> Column:
    """Values between marks; NaN is written Nan."""
    return F.array_join(F.transform(s, lambda x: F.concat(F.lit(mark), F.when(F.isnan(x), "Nan").otherwise(x.cast("string")), F.lit(mark))), " ")


def fixed(s: Column, decimals: int) -> Column:
    """``[1.00, 2.00]``: values with so many decimals, halves up."""
    return F.concat(F.lit("["), F.array_join(F.transform(s, lambda x: F.format_string(f"%.{decimals}f", x)), ", "), F.lit("]"))


def decimals_for(s: Column) -> Column:
    """Decimals by magnitude, 0 to 3; 2 where all values are zero."""
    top = F.array_max(F.transform(s, lambda x: F.abs(x)))
    return F.when(top == 0, 2).otherwise(F.least(F.lit(3), F.greatest(F.lit(0), 3 - F.floor(F.log10(top))))).cast("int")
