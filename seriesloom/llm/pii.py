"""Personal data: format-preserving Feistel pseudonyms.

Found: card numbers (13 to 19 digits with a valid check digit), phone numbers in
international form, IPv4 addresses (each part 0 to 255), US social security
numbers, calendar dates (ISO, or day and month with a 4-digit year) and e-mail
addresses.  Each value is permuted within its own format by a keyed Feistel
network that walks on until the result is valid again: a card gets a card number
of as many digits, a date a date, and so on.  Separators stay.  As it is a
permutation, equal values get equal pseudonyms in all documents and different
ones different pseudonyms, whatever way they are written: a date is permuted as a
day (days above 12 among themselves, as only they show which part is the month)
and written in the style found, a phone number as its country code and the digits
after it, an e-mail address without regard to case, which stays where it was.

Left alone: numbers that fail validation, phone numbers without ``+``, and
secrets such as access tokens.

The key is a secret of the caller (``key_of`` reads it from the session); whoever
has it can undo the pseudonyms.

Null texts stay null, empty ones empty; texts without personal data are
unchanged.  Repeated rows are changed alike.  Extra columns are kept; the counts
are in ``pii``, with underscores before it where the table has that column.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

KINDS = ("email", "ip", "phone", "ssn", "date", "card")
ROUNDS = 10
FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,63})"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?![\d]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))"
    r"|(?P<date>(?<![\w\-/.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w\-/]))"
    r"|(?P<card>(?<!\w)\d(?:[ \-]?\d){12,18}(?!\w))"
)
#: Country calling codes of one or two digits; all others have three.
SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Session setting that holds the key.
KEY_SETTING = "spark.seriesloom.pseudonymKey"
#: A text without these has nothing to find.
HINT = re.compile(r"[0-9@]")
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def key_of(spark: SparkSession) -> bytes:
    """The session's key; where it has none, a random one for this call: pseudonyms are linked within its result only, and nobody can undo them."""
    key = spark.conf.get(KEY_SETTING, None)
    return key.encode() if key else secrets.token_bytes(32)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str | None] = {}

    def permute(self, value: int, size: int, tweak: str, valid=lambda x: True) -> int:
        """A keyed permutation of the valid numbers below ``size``."""
        a = max(2, math.isqrt(size - 1) + 1)
        while True:
            left, right = divmod(value, a)  # both below a
            for i in range(ROUNDS):
                digest = hashlib.blake2b(f"{tweak}|{size}|{i}|{right}".encode(), key=self.key, digest_size=16).digest()
                left, right = right, (left + int.from_bytes(digest, "big")) % a
            value = left * a + right
            if value < size and valid(value):
                return value

    def digits(self, text: str, kind: str, change) -> str:
        """``text`` with its digits in their places changed."""
        own = re.sub(r"\D", "", text)
        new = iter(change(own))
        return re.sub(r"\d", lambda m: next(new), text)

    def _number(self, own: str, kind: str) -> str:
        return str(self.permute(int(own), 10 ** len(own), f"{kind}{len(own)}")).zfill(len(own))

    def email(self, text: str) -> str:
        local, at, host = text.partition("@")
        small = local.lower()
        value, size = 0, 1
        for c in small:
            if c.isalnum():
                base, first = (10, "0") if c.isdigit() else (26, "a")
                value, size = value * base + ord(c) - ord(first), size * base
        if size < 2:
            return text
        # the form says which places are digits and which letters
        form = re.sub("[0-9]", "9", re.sub("[a-z]", "a", small))
        value, out = self.permute(value, size, f"email|{form}|{host.lower()}"), []
        for c, old in zip(reversed(small), reversed(local), strict=True):
            if c.isalnum():
                base, first = (10, "0") if c.isdigit() else (26, "a")
                value, digit = divmod(value, base)
                c = chr(ord(first) + digit)
            out.append(c.upper() if old.isupper() else c)
        return "".join(reversed(out)) + at + host

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        value = self.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        own = re.sub(r"\D", "", text)
        code = next((own[:n] for n in (1, 2) if own[:n] in SHORT_CODES), own[:3])
        # a trunk zero in brackets is no digit of the number
        parts = re.split(r"(\(0\))", text)
        number = re.sub(r"\D", "", "".join(parts[::2]))[len(code) :]
        if not 6 <= len(number) <= 14:
            return None
        new = iter(code + self._number(number, f"phone{code}"))
        return "".join(x if i % 2 else re.sub(r"\d", lambda m: next(new), x) for i, x in enumerate(parts))

    def ssn(self, text: str) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        if not valid(value):
            return None
        return self.digits(text, "ssn", lambda d: f"{self.permute(value, 10**9, 'ssn', valid):09d}")

    def date(self, text: str) -> str | None:
        iso = text[4] == "-"
        parts = [int(p) for p in re.split(r"[-./]", text)]
        year, month, day = parts if iso else (parts[2], parts[1], parts[0])
        swapped = not iso and month > 12 >= day
        if swapped:
            month, day = day, month
        try:
            value = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST <= value <= LAST:
            return None
        wide = iso or all(len(x) == 2 for x in re.split(r"[./]", text)[:2])
        # days above 12 stay above 12: only these show that the month comes first
        late = day > 12
        new = datetime.date.fromordinal(FIRST + self.permute(value - FIRST, LAST - FIRST + 1, "date", lambda x: (datetime.date.fromordinal(FIRST + x).day > 12) == late))
        sep = text[4] if iso else text[-5]
        if iso:
            return f"{new.year:04d}-{new.month:02d}-{new.day:02d}"
        pair = (new.month, new.day) if swapped else (new.day, new.month)
        return sep.join([*(f"{x:02d}" if wide else str(x) for x in pair), f"{new.year:04d}"])

    def card(self, text: str) -> str | None:
        own = re.sub(r"\D", "", text)
        if check_digit(own[:-1]) != own[-1] or len(set(own)) == 1:
            return None

        def change(d: str) -> str:
            body = self._number(d[:-1], "card")
            return body + check_digit(body)

        return self.digits(text, "card", change)

    def replace(self, kind: str, text: str) -> str | None:
        """None if the value is not valid."""
        if (kind, text) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, text] = getattr(self, kind)(text)
        return self.known[kind, text]

    def mask(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)

        def one(m: re.Match) -> str:
            new = self.replace(m.lastgroup, m.group())
            if new is None:
                return m.group()
            counts[m.lastgroup] += 1
            return new

        return FIND.sub(one, text), counts


def check_digit(body: str) -> str:
    """Luhn: every second digit from the right counts double, digits summed."""
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def pseudonymise(docs: DataFrame, key: bytes, counts: bool = True) -> DataFrame:
    """``docs`` with changed texts (n_chars, where present, is set anew) and, if wanted, ``pii``: values changed by kind."""
    columns, at = docs.columns, docs.columns.index("text")
    length_at = columns.index("n_chars") if "n_chars" in columns else -1
    kind = T.StructType([T.StructField(k, T.IntegerType()) for k in KINDS])
    counts_name = free_name(columns, "pii")
    schema = T.StructType([*docs.schema.fields, *([T.StructField(counts_name, kind)] if counts else [])])

    def change(batches):
        own = Pseudonyms(key)
        none = dict.fromkeys(KINDS, 0)
        for batch in batches:
            old = batch.column(at).to_pylist()
            got = [own.mask(t) if t and HINT.search(t) else (t, none) for t in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t for t, _ in got], batch.column(at).type)
            if length_at >= 0:
                sizes = [len(t) if t is not None and t != o else n for (t, _), o, n in zip(got, old, arrays[length_at].to_pylist(), strict=True)]
                arrays[length_at] = pa.array(sizes, arrays[length_at].type)
            names = list(columns)
            if counts:
                arrays.append(pa.array([c for _, c in got], pa.struct([(k, pa.int32()) for k in KINDS])))
                names.append(counts_name)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(change, schema)
