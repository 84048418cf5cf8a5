"""Date formats written with the tokens YYYY, YY, MM and DD.

Java letters and `strptime` directives differ in two ways that matter here:
one-digit days and months are accepted when parsing separated dates, and
two-digit years pivot at 69 (69-99 are 19xx).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile("YYYY|YY|MM|DD")
# letters per token: (when rendering or next to another token, when separated)
_LETTERS = {
    "YYYY": ("yyyy", "yyyy"),
    "YY": ("yy", "yy"),
    "MM": ("MM", "M"),
    "DD": ("dd", "d"),
}
_PLAIN = re.compile(r"^[ .,:/_-]*$")


def _literal(text: str) -> str:
    if _PLAIN.match(text):
        return text
    return "'" + text.replace("'", "''") + "'"


def date_pattern(fmt: str, *, parsing: bool) -> str:
    """Translate a token format into a datetime pattern of Spark."""
    found = list(_TOKEN.finditer(fmt))
    parts, end = [], 0
    for i, match in enumerate(found):
        if match.start() > end:
            parts.append(_literal(fmt[end : match.start()]))
        touches = (i > 0 and found[i - 1].end() == match.start()) or (
            i + 1 < len(found) and found[i + 1].start() == match.end()
        )
        padded, short = _LETTERS[match.group()]
        parts.append(short if parsing and not touches else padded)
        end = match.end()
    if end < len(fmt):
        parts.append(_literal(fmt[end:]))
    return "".join(parts)


def parse_date(text: Column, fmt: str) -> Column:
    """Date of a text cell; null for null and for text not in the format."""
    parsed = F.try_to_timestamp(text, F.lit(date_pattern(fmt, parsing=True))).cast("date")
    if "YY" in fmt.replace("YYYY", ""):
        parsed = F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
    return parsed


def render_date(date: Column, fmt: str) -> Column:
    return F.date_format(date, date_pattern(fmt, parsing=False))
