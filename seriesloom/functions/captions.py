"""What model texts and captions claim: question blocks, places on the axis, positions and dates, audits against a gold text.

Expressions over strings; null texts are empty.  White space is ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import let, pop_std

#: Month names in order (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = "|".join(MONTHS)


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, null where there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(1))


# --- question blocks ---------------------------------------------------------------------------------------------------

#: What parts a model's text into blocks, marks a question's number, names an answer and an option (fixed values).
BLOCK_RULE, MARKER = "------", r"^\s*#+\s*\d+\.\s*"
NAMED_LETTER, ANY_LETTER, OPTION = r"(?i)Answer:\**\s*([A-F])", r"\b([A-F])\b", r"-\s*[A-F]\)"


def qa_blocks(text: Column) -> Column:
    """array<struct<question,answer>> of a model's text.

    A block has two lines or more; its answer line is the first one that holds "answer" and a closing
    bracket, else the last; what stands before is the question, without its number and bold marks.
    A block without a letter A to F or without an option line gives nothing.
    """
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BLOCK_RULE), stripped), lambda b: b != "")

    def read(lines: Column) -> Column:
        named = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.contains(F.lower(F.element_at(lines, i)), F.lit("answer")) & F.contains(F.element_at(lines, i), F.lit(")")))
        at = F.coalesce(F.try_element_at(named, F.lit(1)), F.size(lines))
        return let(at, lambda at: F.struct(_question(F.array_join(F.slice(lines, F.lit(1), at - 1), "\n")).alias("question"), _letter(stripped(F.element_at(lines, at))).alias("answer")))

    def _question(body: Column) -> Column:
        return stripped(F.replace(F.regexp_replace(stripped(body), MARKER, ""), F.lit("**"), F.lit("")))

    def _letter(line: Column) -> Column:
        return F.upper(F.coalesce(first(line, NAMED_LETTER, 1), first(line, ANY_LETTER, 1)))

    lines = F.filter(F.transform(blocks, lambda b: F.split(b, r"\r\n|\r|\n")), lambda ls: F.size(ls) >= 2)
    return F.filter(F.transform(lines, read), lambda q: q["answer"].isNotNull() & q["question"].rlike(OPTION))


# --- places on the axis and claimed values -----------------------------------------------------------------------------

#: Forms that name a place on the time axis, what goes on to a second place, and list numbers (fixed values).
PLACE_FORMS = (
    r"(?:time\s*(?:steps?|points?|index|indices|stamps?)?|timesteps?|steps?|index|indices|positions?|points?|x)\s*(?:=|:|#)?\s*(?:\d+)\b",
    r"\bt\s*=\s*(?:\d+)\b",
    r"\b(?:\d+)\s*(?:st|nd|rd|th)\b",
    r"\b(?:\d+)\s*(?:mark|tick)\b",
)
PLACE = "(?i)" + "|".join(PLACE_FORMS)
GOES_ON = r"(?i)<T>\s*(?:-|–|—|to|and|through|until)\s*(\d+)\b"
LIST_NUMBER = r"(?m)^\s{0,6}\d+\.\s"
#: Talk about axes, and words for positions (fixed values).
AXIS_TALK = r"(?i)(?:the\s+)?[xy]-axis\b[^,.;]{0,40}?\branges?\b[^,.;]*|\bincrements?\s+of\s+-?\d+(?:\.\d+)?"
PROSE_PLACE = r"(?i)\b(?:at|near|toward[s]?|in|by|around|from)\s+the\s+(?:very\s+)?(?:beginning|start|end|middle|midpoint|outset|close|first|last|early|late)\b|\b(?:first|second|last|final|middle)\s+(?:half|third|quarter|portion|segment|part)\b|\bmid[- ]?(?:way|point|series)\b"


def places(text: Column) -> Column:
    """struct<anchors array<long>, rest string>: the places on the time axis that a text names, ranges by both ends, and the text without them."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), LIST_NUMBER, " ")

    def read(clean: Column) -> Column:
        named = F.transform(F.regexp_extract_all(clean, F.lit(PLACE), 0), lambda m: F.regexp_extract(m, r"(\d+)", 1))
        rest = F.regexp_replace(clean, PLACE, " <T> ")
        start = F.struct(named.alias("anchors"), rest.alias("rest"))
        # a range's further ends: each is next to a mark, so there are no more of them than numbers left
        rounds = F.sequence(F.lit(1), F.greatest(F.size(F.regexp_extract_all(rest, F.lit(r"\d+"), 0)), F.lit(1)))

        def go(a: Column, _: Column) -> Column:
            end = first(a["rest"], GOES_ON, 1)
            taken = F.struct(F.concat(a["anchors"], F.array(end)).alias("anchors"), F.regexp_replace(a["rest"], f"(?s)^(.*?){GOES_ON}", "$1 <T> ").alias("rest"))
            return F.when(end.isNotNull(), taken).otherwise(a)

        return F.aggregate(rounds, start, go, lambda a: F.struct(F.transform(a["anchors"], lambda x: x.try_cast("long")).alias("anchors"), a["rest"].alias("rest")))

    return let(clean, read)


def claimed_values(text: Column) -> Column:
    """Numbers that a text states as values: no places on the axis, no percents, no list numbers."""
    rest = F.regexp_replace(places(text)["rest"], r"-?\d+(?:\.\d+)?\s*%", " ")
    return F.transform(F.regexp_extract_all(rest, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def without_axis_talk(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), AXIS_TALK, " ")


def median(values: Column) -> Column:
    """Of an array; null for an empty one."""
    return let(F.array_sort(values), lambda v: F.when(F.size(v) > 0, (F.element_at(v, F.floor((F.size(v) + 1) / 2).cast("int")) + F.element_at(v, F.floor(F.size(v) / 2 + 1).cast("int"))) / 2))


def bin_entropy(bins: Column, n_bins: int = 10) -> Column:
    """Bits of the histogram of bin numbers; 0 for none."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.size(F.filter(bins, lambda x: x == b)).cast("double"))
    share = lambda c: c / F.size(bins)
    return F.when(F.size(bins) > 0, F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def caption_measures(text: Column, s: Column, n_bins: int = 10) -> Column:
    """What a caption says of its series, in one pass.

    ``anchors`` places on the axis, ``prose`` positions in words; ``coverage`` and ``entropy`` of the bins of the axis that the
    anchors inside it fall in; ``gap`` the median distance of claimed values to the closest point in deviations, and ``outside``
    the share of them a tenth of the range beyond it; the same two without talk about axes.
    """
    low, high = F.array_min(s), F.array_max(s)
    spread = F.when(high > low, high - low).otherwise(1.0)
    deviation = F.coalesce(F.nullif(pop_std(s), F.lit(0.0)), F.lit(1.0))

    def fit(values: Column, facts: Column) -> tuple[Column, Column]:
        gap = median(F.transform(values, lambda v: F.array_min(F.transform(s, lambda x: F.abs(v - x))) / facts["sd"]))
        far = lambda v: (v < facts["low"] - 0.1 * facts["spread"]) | (v > facts["high"] + 0.1 * facts["spread"])
        return gap, F.when(F.size(values) > 0, F.size(F.filter(values, far)) / F.size(values))

    def all_of(f: Column) -> Column:
        inside = F.filter(f["anchors"], lambda a: a < F.size(s))
        bins = F.transform(inside, lambda a: F.least(F.lit(n_bins - 1), F.floor(a / F.size(s) * n_bins).cast("int")))
        gap, outside = fit(f["values"], f)
        gap_bare, outside_bare = fit(f["bare"], f)
        return F.struct(
            F.size(f["anchors"]).cast("long").alias("anchors"),
            F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROSE_PLACE), 0)).cast("long").alias("prose"),
            (F.size(F.array_distinct(bins)) / n_bins).alias("coverage"),
            bin_entropy(bins, n_bins).alias("entropy"),
            F.size(f["values"]).cast("long").alias("claims"),
            gap.alias("gap"),
            outside.alias("outside"),
            gap_bare.alias("gap_bare"),
            outside_bare.alias("outside_bare"),
        )

    facts = F.struct(places(text)["anchors"].alias("anchors"), claimed_values(text).alias("values"), claimed_values(without_axis_talk(text)).alias("bare"), low.alias("low"), high.alias("high"), spread.alias("spread"), deviation.alias("sd"))
    return let(facts, all_of)


# --- positions and dates ------------------------------------------------------------------------------------------------

#: Words for early, middle and late positions, and for the share that lies before them (fixed values).
EARLY = r"(?i)(at the start|early on|initially|at the beginning|near the beginning|first (?:third|quarter))"
MIDDLE = r"(?i)(midway|midpoint|halfway|about half|middle of the series|middle)"
LATE = r"(?i)(near the end|at the end|toward the end|towards the end|late in the series|final)"
THROUGH = r"(?i)(\w+)[- ](?:way|quarter)s?\s+(?:of the way\s+)?through"
SHARES = {"two-thirds": "late", "three-quarter": "late", "quarter": "early", "one-third": "early", "third": "early", "half": "mid"}
#: A span of dates, and a date after an anchor word (fixed values).
SPAN = rf"(?i)(?:from|between)\s+(?:({MONTH})\s+)?(\d{{4}})(?:,)?\s*(?:to|and|through|-)\s+(?:({MONTH})\s+)?(\d{{4}})"
DATED = rf"[^.]{{0,80}}?(?:in|on|by|around|at)\s+(?:({MONTH})\s+)?(?:\d{{1,2}},\s*)?((?:19|20)\d\d)"


def month_number(month: Column, year: Column) -> Column:
    """Months since the year 0; the first month of the year where none is named."""
    return year.cast("long") * 12 + F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)), F.lit(1))


def date_fraction(text: Column, anchor: str) -> Column:
    """Where the date that follows an anchor word lies in the span of dates that a text names, 0 to 1; null without either, or outside."""
    text = F.coalesce(text, F.lit(""))
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    at = rf"(?i)(?:{anchor}){DATED}"
    spans, dated = text.rlike(SPAN), text.rlike(at)
    ends = F.struct(month_number(part(SPAN, 1), part(SPAN, 2)).alias("a"), month_number(part(SPAN, 3), part(SPAN, 4)).alias("b"), month_number(part(at, 1), part(at, 2)).alias("p"))
    return F.when(spans & dated, let(ends, lambda e: F.when((e["b"] > e["a"]) & e["p"].between(e["a"], e["b"]), (e["p"] - e["a"]) / (e["b"] - e["a"]))))


def phrase_position(text: Column, anchor: str, most: int = 70) -> Column:
    """early, mid or late: the first position named in the clause after an anchor word; else null."""
    text = F.coalesce(text, F.lit(""))
    clause = F.substr(F.regexp_extract(text, rf"(?is)(?:{anchor})([^,.;]*)", 1), F.lit(1), F.lit(most))
    share = F.create_map(*(F.lit(x) for pair in SHARES.items() for x in pair))
    named = lambda c: F.when(c.rlike(EARLY), "early").when(c.rlike(MIDDLE), "mid").when(c.rlike(LATE), "late").otherwise(F.try_element_at(share, F.lower(F.regexp_extract(c, THROUGH, 1))))
    return let(clause, named)


def position_bucket(fraction: Column) -> Column:
    """early under a third, late over two thirds, else mid."""
    return F.when(fraction < 1 / 3, "early").when(fraction > 2 / 3, "late").when(fraction.isNotNull(), "mid")


# --- audit against a gold text ---------------------------------------------------------------------------------------------

#: What a caption without context must not hold (fixed values).
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|twentieth|thirtieth|fortieth|fiftieth"
MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"
AUDIT_NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
AUDIT_YEAR = r"\b((?:18|19|20)\d\d)\b"
CHECKS = {
    "point_numbering": rf"(?i)\bindex\s+\d+|\b\d+(?:st|nd|rd|th)\s+point|\b\d+\s+points\b(?!\s+(?:to|toward|towards)\b)|\b({ORDINALS})\s+point\b",
    "time_unit_count": r"(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten|\d+)[-\s](?:week|month|year|day|hour)\b",
    "month_or_date": rf"\b({MONTH_NAMES})\b|\d{{4}}-\d{{2}}-\d{{2}}",
    "unit_or_currency": r"[$£€]|\bGBP\b|\bUSD\b|million metric tons|mmHg|\bppm\b|\bcases\b|\btons\b|\bvehicles\b",
    "external_statistic": r"(?i)historical|all-time|all time|longer-term|broader mean|reference period",
    "frequency_word": r"(?i)\b(hourly|daily|weekly|monthly|quarterly|annual|annually|yearly|years?|weeks?|months?)\b",
}
#: A year counts only where the gold text has it as a date (fixed value).
GOLD_YEAR = r"(?:in|from|to|by|since|during|of|,)\s+((?:18|19|20)\d\d)(?![\d.])"


def audit_flags(text: Column, gold: Column) -> dict[str, Column]:
    """Eight flags: a number that the gold text does not hold, a year that it has as a date, and six patterns."""
    text, gold = F.coalesce(text, F.lit("")), F.coalesce(gold, F.lit(""))
    plain = lambda t: F.transform(F.regexp_extract_all(t, F.lit(AUDIT_NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
    flags = {name: text.rlike(pattern) for name, pattern in CHECKS.items()}
    flags["number_not_in_gold"] = F.size(F.array_except(plain(text), plain(gold))) > 0
    flags["year"] = F.coalesce(F.array_contains(F.regexp_extract_all(gold, F.lit(GOLD_YEAR), 1), first(text, AUDIT_YEAR, 1)), F.lit(False))
    return flags
