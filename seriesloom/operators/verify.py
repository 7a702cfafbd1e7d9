"""Adjudication of questions about a series: which option wins, and whether the question stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


def region_winners(rows: DataFrame, key: list[str], tie: float = 1e-6, overlap: int = 2) -> DataFrame:
    """Per key the best region: (letter, best, margin).

    ``rows``: key, letter, first, last, score.  Scores within a tie tolerance of the best count as tied and the narrowest wins; rivals that share ``overlap`` points or more with the winner are no rivals.  The margin is relative to the best score.
    """
    w = Window.partitionBy(*key)
    tied = F.col("score") >= F.max("score").over(w) - tie * (F.abs(F.max("score").over(w)) + 1)
    ranked = rows.withColumn("__t", tied).withColumn("__r", F.row_number().over(w.orderBy(F.desc("__t"), F.col("last") - F.col("first"), "letter")))
    best = ranked.where("__r = 1").select(*key, F.col("letter").alias("win"), F.col("score").alias("best"), F.col("first").alias("wf"), F.col("last").alias("wl"))
    both = rows.join(best, key).where("letter <> win")
    shared = F.least("last", "wl") - F.greatest("first", "wf") + 1
    rivals = both.where(shared < overlap).groupBy(*key).agg(F.max("score").alias("rival"))
    margin = (F.col("best") - F.col("rival")) / F.nullif(F.abs(F.col("best")), F.lit(0.0))
    return best.join(rivals, key, "left").select(*key, F.col("win").alias("letter"), "best", margin.alias("margin"))


def decide(kind: Column, stated: Column, computed: Column, margin: Column, least: float, stem_ok: Column, compares: Column, unique_ok: Column) -> Column:
    """KEEP, CORRECT or DROP with the truth and a reason; the first rule that applies decides."""

    def out(decision: str, truth: Column, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), truth.alias("truth"), F.lit(reason).alias("reason"))

    none = F.lit(None).cast("string")
    return (
        F.when(kind.isNull() | (kind == "none"), out("DROP", none, "no checkable claim"))
        .when(computed.isNull(), out("DROP", none, "no option wins"))
        .when(~stem_ok, out("DROP", none, "stem does not name the measure"))
        .when(compares, out("DROP", none, "options compare with each other"))
        .when((kind == "region") & (F.coalesce(margin, F.lit(1.0)) < least), out("DROP", none, "margin too small"))
        .when(~unique_ok, out("DROP", none, "claims to be the only one"))
        .when(stated == computed, out("KEEP", computed, "agrees"))
        .otherwise(out("CORRECT", computed, "another option wins"))
    )


def sole_match(shapes: Column, wanted: Column) -> Column:
    """Letter of the only option with the wanted shape, else null. ``shapes``: array<struct<letter,shape>>."""
    hits = F.filter(shapes, lambda o: o["shape"] == wanted)
    return F.when(F.size(hits) == 1, hits[0]["letter"])


def segment_statistics(s: Column, first: Column, last: Column, digits: int = 4) -> Column:
    """What a tool call returns about positions first to last."""
    own = S.part(s, first, last)
    d = S.diffs(own)
    r = lambda c: F.round(c, digits)
    return F.struct(
        r(S.mean(own)).alias("mean"),
        r(F.array_min(own)).alias("min"),
        r(F.array_max(own)).alias("max"),
        (S.argmax(own) + first).cast("long").alias("argmax"),
        (S.argmin(own) + first).cast("long").alias("argmin"),
        r(F.element_at(own, -1) - F.element_at(own, 1)).alias("net"),
        r(F.array_max(d)).alias("rise"),
        r(F.array_min(d)).alias("fall"),
    )


def prominences(frame_rows: DataFrame) -> DataFrame:
    """(id, pos, kind, prominence) of every peak and trough, against the nearest higher (lower) point on each side. ``frame_rows``: id, s.

    Scans with a stack inside a series, which no expression has; Arrow batches of whole series.
    """

    def scan(batches):
        import pandas as pd

        def side(x: list[float]) -> list[float]:
            """Lowest value between each place and the nearest higher one before it."""
            stack: list[tuple[float, float]] = []
            out = []
            for v in x:
                low = v
                while stack and stack[-1][0] <= v:
                    low = min(low, stack.pop()[1])
                out.append(low)
                stack.append((v, low))
            return out

        for frame in batches:
            rows = []
            for i, s in zip(frame["id"].tolist(), frame["s"].tolist(), strict=True):
                for kind, sign in (("peak", 1.0), ("trough", -1.0)):
                    x = [sign * v for v in s]
                    left, right = side(x), side(x[::-1])[::-1]
                    rows += [(i, p, kind, x[p] - max(left[p], right[p])) for p in range(1, len(x) - 1) if x[p - 1] < x[p] >= x[p + 1]]
            yield pd.DataFrame(rows, columns=["id", "pos", "kind", "prominence"])

    return frame_rows.select(F.col("id").cast("long"), "s").mapInPandas(scan, "id long, pos long, kind string, prominence double")
