"""Personal data replaced by format-preserving Feistel pseudonyms.

A found value that passes its kind's check is mapped to a number below the count of values
of its format, permuted by a keyed Feistel network (walking the cycle until the result is
below that count), and written back in the same format: separators, case, lengths, check
digits and calendar stay valid. The permutation depends on key, kind and format alone, so
equal values stay equal in all documents, and different ones of a format stay different.

| kind | check | permuted |
| --- | --- | --- |
| email | shape | letters and digits of the local part |
| ip | four octets | the 32 bits |
| iban | country, length, mod 97; any case, spaces or hyphens | letters and digits after the check digits |
| card | 13 to 19 digits, Luhn | all digits but the last, which is computed |
| date | calendar, four-digit year | days of its two centuries |
| ssn | issued areas | digits, walking past areas never issued |
| phone | 8 to 15 digits, `+` or area code | all digits after the assigned country code |

The key comes from the caller, else from `spark.tabshift.pseudonym.key`; without one the
operator refuses. Values are equal by their digits or letters, whatever separates them. Left as
they are, because too many other numbers look like them: national phone numbers without
brackets or hyphens (030 12345678), dates with two-digit years, without separators or with
names of months (31.12.99, 20240131, Jan 5, 2024). Defined cases: null texts stay null, empty
ones empty; values that fail their check stay; repeated rows and all other columns are kept; a
value may, by chance of one in the count of its format, map to itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.llm.common import column, fresh, map_arrow, slices

KEY_SETTING = "spark.tabshift.pseudonym.key"
ROUNDS = 10


class Cipher:
    """Keyed permutations of range(n)."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.permute = lru_cache(1 << 16)(self._permute)

    def _permute(self, kind: str, value: int, n: int) -> int:
        if n <= 1:
            return value
        half = ((n - 1).bit_length() + 1) // 2
        mask, tweak = (1 << half) - 1, f"{kind}|{n}|".encode()
        size = (half + 7) // 8
        while True:
            left, right = value >> half, value & mask
            for k in range(ROUNDS):
                said = tweak + bytes([k]) + right.to_bytes(size, "big")
                h = hashlib.blake2b(said, key=self.key, digest_size=max(8, size)).digest()
                left, right = right, left ^ int.from_bytes(h, "big") & mask
            value = left << half | right
            if value < n:
                return value

    def characters(self, kind: str, text: str) -> str:
        """Permutes a text's ASCII letters and digits, each within its class; the rest and
        the case of each letter stay."""
        value, n = 0, 1
        for c in text:
            if (r := _radix(c)) > 1:
                value, n = value * r + _digit(c), n * r
        value = self.permute(kind, value, n)
        out = []
        for c in reversed(text):
            if (r := _radix(c)) > 1:
                value, d = divmod(value, r)
                c = str(d) if r == 10 else chr((65 if c.isupper() else 97) + d)
            out.append(c)
        return "".join(reversed(out))


def _radix(c: str) -> int:
    return 1 if not c.isascii() else 10 if c.isdigit() else 26 if c.isalpha() else 1


def _digit(c: str) -> int:
    return int(c) if c.isdigit() else ord(c.lower()) - 97


def _refill(shape: str, symbols: str) -> str:
    """The shape's letters and digits replaced in order."""
    symbol = iter(symbols)
    return "".join(next(symbol) if _radix(c) > 1 else c for c in shape)


# ---------------------------------------------------------------- kinds


def luhn_total(digits: str) -> int:
    """Sum over digits from the right, each second one doubled and folded."""
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))


def card(value: str, cipher: Cipher) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn_total(digits) % 10 or len(set(digits)) == 1:
        return None
    body = cipher.characters("card", digits[:-1])
    return _refill(value, body + str(-luhn_total(body + "0") % 10))


# Length of an account number by country, of all in the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def _iban_pattern() -> str:
    """A country, check digits and just as many further characters as the country has."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    forms = (f"(?:{'|'.join(c)})\\d{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, c in by_length.items())
    return rf"(?<!\w)(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join(forms)})(?!\w)"


def _cased(shape: str, value: str) -> str:
    """`value` with the case of the letters of `shape`, letter by letter in a lower-case one."""
    return value.lower() if shape == shape.lower() else value


def _mod97(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def iban(value: str, cipher: Cipher) -> str | None:
    plain = re.sub(r"[\s-]", "", value).upper()
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if IBAN_LENGTHS.get(country) != len(plain) or _mod97(country, check, body) != 1:
        return None
    body = cipher.characters(f"iban {country}", body)
    return _refill(value, _cased(value, f"{country}{98 - _mod97(country, '00', body):02d}{body}"))


# Country codes of two digits; those of one are 1 and 7, all others have three.
TWO_DIGIT_CODES = """20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66
81 82 84 86 90 91 92 93 94 95 98""".split()


def country_code(digits: str) -> str:
    """The country code that an international number begins with."""
    if digits[0] in "17":
        return digits[0]
    return digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def phone(value: str, cipher: Cipher) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 8 <= len(digits) <= 15:
        return None
    kept = len(country_code(digits)) if value.startswith("+") else 0
    return _refill(value, digits[:kept] + cipher.characters(f"phone {digits[:kept]}", digits[kept:]))


def ip(value: str, cipher: Cipher) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    number = cipher.permute("ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(map(str, number.to_bytes(4, "big")))


def email(value: str, cipher: Cipher) -> str:
    local, _, domain = value.partition("@")
    return f"{cipher.characters(f'email {domain.lower()}', local)}@{domain}"


def ssn(value: str, cipher: Cipher) -> str | None:
    issued = lambda v: not re.match(r"000|666|9", v) and "00" != v[-6:-4] and "0000" != v[-4:]
    digits = value.replace("-", "")
    if not issued(digits):
        return None
    while True:
        digits = cipher.characters("ssn", digits)
        if issued(digits):
            return _refill(value, digits)


def calendar(value: str, cipher: Cipher) -> str | None:
    parts = re.split(r"\D", value)
    places = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in places:  # day first; month first only where the day-first reading is no date
        try:
            found = date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        first = max(1, (found.year - 100) // 200 * 200 + 100)
        low, high = date(first, 1, 1).toordinal(), date(min(first + 199, 9999), 12, 31).toordinal()
        new = date.fromordinal(low + cipher.permute("date", found.toordinal() - low, high - low + 1))
        width = 2 if len(parts[m]) == len(parts[d]) == 2 else 1
        out = [""] * 3
        out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:0{width}d}", f"{new.day:0{width}d}"
        mark = iter(re.findall(r"\D", value))
        return out[0] + next(mark) + out[1] + next(mark) + out[2]
    return None


#: In the order of search; what one kind has taken is no part of a later one.
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", re.A), email),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", re.A), ip),
    ("iban", re.compile(_iban_pattern(), re.A | re.I), iban),
    ("card", re.compile(r"(?<!\w)\d{13,19}(?!\w)", re.A), card),
    ("card", re.compile(r"(?<!\w)(?:(?:\d{4}[ -]){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)", re.A), card),
    ("date", re.compile(r"(?<![\w.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?![\w-])|(?=T\d))", re.A), calendar),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), ssn),
    ("phone", re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)", re.A), phone),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?(?:\(\d{1,5}\)|\d{2,5})){1,4}(?!\w)", re.A), phone),
    ("phone", re.compile(r"(?<![\w+])\+\d{8,15}(?!\w)", re.A), phone),
    ("phone", re.compile(r"(?<![\w+-])(?:\(\d{3}\) ?\d{3}|\d{3}-\d{3})[.-]\d{4}(?![\w-])", re.A), phone),
]


def _valid(pattern: re.Pattern, change: Callable, text: str, cipher: Cipher) -> Iterator[tuple[int, int, str]]:
    """start, end and pseudonym of a pattern's values. What fails its check hides none that
    begins inside it."""
    at = 0
    while m := pattern.search(text, at):
        new = change(m[0], cipher)
        if new is not None:
            yield m.start(), m.end(), new
        at = m.start() + 1 if new is None else m.end()


def find(text: str, cipher: Cipher) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all values, in order, without overlaps."""
    found, open_ = [], text
    for kind, pattern, change in KINDS:
        new = [(a, b, kind, p) for a, b, p in _valid(pattern, change, open_, cipher)]
        if new:
            found += new
            open_ = replace(open_, [(a, b, kind, "\0" * (b - a)) for a, b, *_ in new])
    return sorted(found)


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- operator


def key_of(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one, or set {KEY_SETTING}")
    return key


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None, found: str = "private") -> DataFrame:
    """`docs` with values replaced in `text`, and under a free name an array of
    (kind, start, end, pseudonym) with character positions in the old text."""
    secret = key or key_of(docs.sparkSession)
    new, spans = fresh(docs.columns, "new_text", found)
    span = T.StructType.fromDDL("kind string, start int, end int, pseudonym string")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches):
        cipher = Cipher(secret)
        for part in slices(batches, text):
            texts = column(part, text)
            # every kind has a digit or an @; RE2 passes over the other texts
            maybe = np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").fill_null(False).to_numpy(zero_copy_only=False))
            hits = {}
            for k in maybe.tolist():
                value = texts[k].as_py()
                if got := find(value, cipher):
                    hits[k] = (replace(value, got), [{"kind": n, "start": a, "end": b, "pseudonym": p} for a, b, n, p in got])
            if hits:
                values = texts.to_pylist()
                for k, (value, _) in hits.items():
                    values[k] = value
                texts = pa.array(values, texts.type)
            rows = pa.array([hits[k][1] if k in hits else [] for k in range(part.num_rows)], arrow)
            yield pa.RecordBatch.from_arrays([*part.columns, texts, rows], [*part.schema.names, new, spans])

    schema = T.StructType([*docs.schema.fields, T.StructField(new, T.StringType()), T.StructField(spans, T.ArrayType(span))])
    out = map_arrow(docs, run, schema)
    kept = [F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, spans)
