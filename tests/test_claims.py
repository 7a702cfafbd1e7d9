"""Question blocks, places and values in captions, positions, audits, perturbations and charts on hand cases and against plain code."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import captions as Q
from seriesloom.operators import masking as K
from seriesloom.operators import perturb as U

from test_library import arr, value


def plain_blocks(text):
    """Questions and answers, block by block."""
    out = []
    for block in re.split("------", text or ""):
        lines = re.split(r"\r\n|\r|\n", block.strip(" \t\n\r\x0b\x0c"))
        if len(lines) < 2:
            continue
        named = [i for i, line in enumerate(lines) if "answer" in line.lower() and ")" in line]
        at = named[0] if named else len(lines) - 1
        body = re.sub(r"^\s*#+\s*\d+\.\s*", "", "\n".join(lines[:at]).strip()).replace("**", "").strip()
        hit = re.search(r"Answer:\**\s*([A-F])", lines[at], re.I) or re.search(r"\b([A-F])\b", lines[at])
        if hit and re.search(r"-\s*[A-F]\)", body):
            out.append((body, hit[1].upper()))
    return out


def test_qa_blocks_against_plain_code(spark):
    rnd = random.Random(11)
    pieces = ["## 1. Why?", "  ### 22. **When** is it low", "- A) left", "-B) right", "- G) none", "Answer: B) right", "**answer:** d", "the answer (see above)", "E it is", "------", "-----", "", "  ", "C", "no letter", "\r", "1. x"]
    texts = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randrange(14))) for _ in range(600)] + [None, "", "------", "----------------"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r["i"]: [(x["question"], x["answer"]) for x in r["q"]] for r in rows.select("i", Q.qa_blocks(F.col("t")).alias("q")).collect()}
    want = {i: plain_blocks(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 50


@pytest.mark.parametrize(
    "text,anchors,values",
    [
        ("2. At time step 7 it holds 1.5, then from index 9 to 12 and 15 only -3", [7, 9, 12, 15], [1.5, -3.0]),
        ("the 21st of 40, t = 3, tick marks at the 5 mark", [21, 3, 5], [40.0]),
        ("up 12% or 7.25 %, a low of 4", [], [4.0]),
        ("between steps 3 – 5 until 9", [3, 5, 9], []),
        ("positions: 1", [1], []),
        (None, [], []),
    ],
)
def test_places_and_values(spark, text, anchors, values):
    t = F.lit(text).cast("string")
    assert value(spark, Q.places(t)["anchors"]) == anchors
    assert value(spark, Q.claimed_values(t)) == values


def test_caption_measures_of_odd_captions(spark):
    m = value(spark, Q.caption_measures(F.lit("nothing said"), arr(1.0, 1.0, 1.0)))
    assert (m["anchors"], m["coverage"], m["entropy"], m["claims"], m["gap"], m["outside"]) == (0, 0.0, 0.0, 0, None, None)
    m = value(spark, Q.caption_measures(F.lit("steps 0, step 1, step 9 and step 99 at 5 and 100"), arr(*map(float, range(10)))))
    assert m["anchors"] == 4 and m["coverage"] == 0.3 and m["entropy"] == pytest.approx(np.log2(3))
    assert m["claims"] == 2 and m["outside"] == 0.5


def test_audit_flags(spark):
    def flags(text, gold):
        return {k for k, c in Q.audit_flags(F.lit(text), F.lit(gold)).items() if value(spark, c)}

    assert flags("It falls.", "In 1999 it fell") == set()
    assert flags("It was 1,200 in 1999, all-time low", "1200 since 1999") == {"year", "external_statistic"}
    assert flags("the third point, 12 points", "third 12") == {"point_numbering"}
    assert flags("12 points to a rise", "12") == set()
    assert flags("by 1999", "19990 of 1999.5") == {"number_not_in_gold"}
    assert flags("a two-week dip of $3 in March", "3") == {"time_unit_count", "month_or_date", "unit_or_currency", "frequency_word"}
    assert flags("monthly", "") == {"frequency_word"}


def plain_close(a, b):
    return all(abs(x - y) <= 1e-8 + 1e-5 * abs(y) for x, y in zip(a, b))


@pytest.mark.parametrize("s", [[float(i * i % 17) for i in range(30)], [1.0] * 20, [1.0, 2.0, 3.0, 2.0, 1.0], [0.0] * 19 + [5.0], [1.0, 2.0] * 8])
def test_perturbed(spark, s):
    p = value(spark, U.perturbed(arr(*s), F.lit("k"))).asDict()
    made = {k: v for k, v in p.items() if v is not None}
    for z in made.values():
        assert sorted(z) == sorted(s) and np.mean(np.abs(np.array(z) - s) > 1e-9) >= U.MOVED
    kinds = list(made)
    assert not any(plain_close(made[a], made[b]) for i, a in enumerate(kinds) for b in kinds[:i])
    assert (p["reverse"] is None) == (np.mean(np.abs(np.array(s[::-1]) - s) > 1e-9) < U.MOVED or "shuffle" in made and plain_close(s[::-1], made["shuffle"]))
    if len(set(s)) == 1:
        assert not made
    if len(s) < 8:
        assert p["segment_swap"] is None


def pixels_of(image):
    width, height = struct.unpack(">II", image[16:24])
    at = image.index(b"IDAT")
    raw = zlib.decompress(image[at + 4 :])
    return np.frombuffer(raw, np.uint8).reshape(height, width + 1)[:, 1:]


def test_panels():
    """Each channel has its own panel and axis, all share the time axis, and the ninth is left out with a flag."""
    image, cut = K.multi_png([[0.0, 1.0], [1000.0, 0.0, 500.0, 500.0], [7.0, 7.0, 7.0, 7.0]])
    pixels = pixels_of(image)
    assert pixels.shape == (300, 600) and not cut
    top, middle, low = pixels[:100], pixels[100:200], pixels[200:]
    assert (top[:50, 190] == 0).any() and (top[50:, 5] == 0).any() and not (top[:-1, 210:] == 0).any()  # two of four points: a third of the time axis
    assert (middle[:20, 0] == 0).any() and (middle[80:, 200] == 0).any() and (middle[40:60, 595] == 0).any()
    assert ((low[:-1] == 0).sum(0) == 1).all()  # a constant channel is one straight line
    for panel in (top, middle, low):
        assert (panel[-1] <= K.FRAME).all()
    image, cut = K.multi_png([[float(i), 0.0] for i in range(9)])
    assert cut and pixels_of(image).shape == (300, 600)
    with pytest.raises(ValueError):
        K.multi_png([])
    with pytest.raises(ValueError):
        K.multi_png([[1.0], []])
