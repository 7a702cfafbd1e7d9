"""Number masking by reply lines, time anchors in prose, and line charts as PNG: what needs state along a text or bytes."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: A number that is not the rest of a longer one (fixed value).
NUMBER = re.compile(r"(?<![\d.])-?\d+(?:\.\d+)?")
MASKED = StructType([StructField("text", StringType()), StructField("unnamed", IntegerType())])


def mask_flags(reply: Column) -> Column:
    """Reply lines ``number flag`` or ``a to b flag``, the flag 0 or 1, as array<struct<num,flag>>; a range names both its ends, other lines nothing."""
    bare = lambda x: F.regexp_replace(x, r"^\s*[-*]*\s*|\s*[-*]*\s*$", "")
    lines = F.transform(F.split(reply, r"\r\n|\r|\n"), bare)
    # the forms of a reply's line (fixed values)
    number, lead, end = r"(-?\d+(?:\.\d+)?)", r"(?i)^\s*(?:\d+[.)]\s+)?", r"[\s:,]+([01])\s*$"
    one, two = lead + number + end, lead + number + r"\s*(?:-|–|to|and)\s*" + number + end
    named = lambda x, form, group, flag: F.struct(F.regexp_extract(x, form, group).cast("double").alias("num"), F.regexp_extract(x, form, flag).cast("int").alias("flag"))
    none = F.array().cast("array<struct<num:double,flag:int>>")
    return F.flatten(F.transform(lines, lambda x: F.when(x.rlike(one), F.array(named(x, one, 1, 2))).when(x.rlike(two), F.array(named(x, two, 1, 3), named(x, two, 2, 3))).otherwise(none)))


def apply_mask(text: str, flags: list, mark: str = "<val>") -> tuple[str, int]:
    """Each number takes the next flag of its value, or else of its negated value; 1 masks it. Numbers without a flag are kept and counted."""
    queues: dict[float, list[int]] = {}
    for f in flags:
        queues.setdefault(float(f["num"]), []).append(f["flag"])
    unnamed = 0

    def one(m: re.Match) -> str:
        nonlocal unnamed
        x = float(m.group())
        for key in (x, -x):
            if queues.get(key):
                return mark if queues[key].pop(0) else m.group()
        unnamed += 1
        return m.group()

    return NUMBER.sub(one, text), unnamed


@pandas_udf(MASKED)
def masked(text: pd.Series, flags: pd.Series) -> pd.DataFrame:
    """struct<text, unnamed> from a text and its flags."""
    rows = [apply_mask(t or "", [] if f is None else list(f)) for t, f in zip(text, flags, strict=True)]
    return pd.DataFrame(rows, columns=["text", "unnamed"])


@pandas_udf(ArrayType(DoubleType()))
def time_anchors(text: pd.Series) -> pd.Series:
    """Places on the time axis that a text names: numbers after a time word, ranges at both ends; list markers and percents do not count."""
    lead = re.compile(r"\b(?:time|step|index|point|t)s?\s*(?:=|of|at|about|around|from)?\s*(-?\d+(?:\.\d+)?)(?!\d*\s*%)(?:\s*(?:to|-|and)\s*(\d+(?:\.\d+)?)(?!\d*\s*%))?", re.IGNORECASE)

    def one(t: str | None) -> list[float]:
        clean = re.sub(r"(?m)^\s*\d+[.)]\s+", "", t or "")
        return [float(x) for m in lead.finditer(clean) for x in m.groups() if x]

    return text.map(one)


@pandas_udf(StringType())
def compact_number(x: pd.Series) -> pd.Series:
    """Six significant digits without trailing zeros."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:g}")


def panel(series: list[float], width: int, height: int, pad: float = 0.08, points: int | None = None):
    """A line on white as pixels; the value axis has a margin, the time axis room for ``points`` points. Empty or non-finite series are refused."""
    import numpy as np

    y = np.asarray(series, float)
    if not len(y) or not np.isfinite(y).all():
        raise ValueError("a chart needs finite values")
    low, high = y.min(), y.max()
    room = (high - low) * pad or 1.0
    pixels = np.full((height, width), 255, np.uint8)
    at = np.arange(width) * max((points or len(y)) - 1, 0) / (width - 1)
    drawn = int((at <= len(y) - 1 + 1e-9).sum())
    line = np.interp(at[:drawn], np.arange(len(y)), y)
    row = np.clip(np.round((high + room - line) / (high - low + 2 * room) * (height - 1)), 0, height - 1).astype(int)
    for i in range(drawn):
        a, b = sorted((row[i - 1] if i else row[i], row[i]))
        pixels[a : b + 1, i] = 0
    return pixels


def png_bytes(pixels) -> bytes:
    height, width = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + line.tobytes() for line in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png(series: list[float], width: int = 600, height: int = 300, pad: float = 0.08) -> bytes:
    """A line chart."""
    return png_bytes(panel(series, width, height, pad))


#: Channels that one chart shows.
MOST_CHANNELS = 8
FRAME = 128


def multi_png(channels: list[list[float]], width: int = 600, height: int = 300) -> tuple[bytes, bool]:
    """The first eight channels as panels under each other, each with its own value axis and all with one time axis; and whether some were left out."""
    import numpy as np

    if not len(channels):
        raise ValueError("a chart needs a channel")
    shown = [list(c) for c in channels[:MOST_CHANNELS]]
    edges = np.linspace(0, height, len(shown) + 1).astype(int)
    points = max(map(len, shown))
    panels = []
    for c, a, b in zip(shown, edges, edges[1:]):
        pixels = panel(c, width, int(b - a), points=points)
        pixels[-1] = np.minimum(pixels[-1], FRAME)
        panels.append(pixels)
    return png_bytes(np.concatenate(panels)), len(channels) > MOST_CHANNELS


@pandas_udf(StructType([StructField("image", BinaryType()), StructField("truncated", BooleanType())]))
def multi_chart(channels: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([multi_png(list(c)) for c in channels], columns=["image", "truncated"])


@pandas_udf(BinaryType())
def chart(series: pd.Series) -> pd.Series:
    return series.map(lambda s: png(list(s)))


def rendered(items: DataFrame, key: str, series: str) -> DataFrame:
    """``items`` with ``image``: each distinct key is drawn once and joined back."""
    once = items.groupBy(key).agg(F.first(series).alias("__s")).select(key, chart("__s").alias("image"))
    return items.join(once, key)
