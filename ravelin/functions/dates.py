"""Sortable dates from the usual spellings, as text: ``YYYY-MM-DD`` or ``YYYY-MM-DDTHH:MM:SS``. Offsets are disregarded.

This is the index's notion of a date, whose order is that of the text. For instants, with zones, see
``ravelin.operators.timestamps``.

The spellings are a table: the order of year, month and day, what stands between them, what leads over to a time, and
what may follow it. Patterns are made from it, and the same ones serve Python (ingest) and columns (queries).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Seconds have 9 digits at least, milliseconds 13.
_UNIX = re.compile(r"[0-9]{9,13}")
_MILLIS = 13
#: Two-digit years from here on are of the last century.
CENTURY = 70


@dataclass(frozen=True)
class Spelling:
    """``order``: Y is a year of four digits, y one of four or two. ``tail`` has one group: the half of the day."""

    order: str
    between: str
    lead: str
    tail: str

    @property
    def pattern(self) -> str:
        digits = {"Y": r"(\d{4})", "y": r"(\d{4}|\d{2})", "M": r"(\d{1,2})", "D": r"(\d{1,2})"}
        clock = rf"(?:{self.lead}(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?{self.tail})?"
        return f"^{self.between.join(digits[x] for x in self.order)}{clock}$"


#: The spellings that are read, in this order.
SPELLINGS = (
    Spelling("YMD", "[-/]", "[T ]", r"(?:[.,]\d+)?\s*(?:Z|[+-]\d{2}:?\d{2}|UTC)?()"),
    Spelling("MDy", "/", "[ T,]+", r"\s*([AaPp][Mm])?"),
)


def format_unix(seconds: int) -> str:
    return (_EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_unix(text: str) -> int | None:
    """Seconds of ``YYYY-MM-DD[THH:MM[:SS]][Z]``, None for anything else. Days and clocks beyond their end run on."""
    day, _, clock = text.strip().removesuffix("Z").replace(" ", "T", 1).partition("T")
    try:
        y, mo, d = (int(x) for x in (day[:4], day[5:7], day[8:]))
        parts = [int(x) for x in clock.split(":")] if clock else [0, 0]
        start = datetime(y, mo, 1, tzinfo=timezone.utc)
    except ValueError:
        return None
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", day) or len(parts) not in (2, 3) or any(len(x) != 2 for x in clock.split(":") if clock):
        return None
    h, mi, s = (*parts, 0)[:3]
    return int((start + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s) - _EPOCH).total_seconds())


def _sortable(part: dict[str, str]) -> str | None:
    year = int(part["Y"])
    if len(part["Y"]) == 2:
        year += 2000 if year < CENTURY else 1900
    month, day = int(part["M"]), int(part["D"])
    if year < 1000 or month not in range(1, 13) or day not in range(1, 32):
        return None
    out = f"{year}-{month:02}-{day:02}"
    if not part["h"]:
        return out
    hour, minute, second = int(part["h"]), int(part["m"]), min(int(part["s"] or 0), 59)
    if part["half"]:
        hour = hour % 12 + 12 * (part["half"].lower() == "pm")
    return out if hour > 23 or minute > 59 else f"{out}T{hour:02}:{minute:02}:{second:02}"


_COMPILED = [(re.compile(x.pattern), [*x.order.upper(), "h", "m", "s", "half"]) for x in SPELLINGS]


def normalize_date(raw: str) -> str | None:
    text = raw.strip()
    if _UNIX.fullmatch(text):
        return format_unix(int(text) // (1000 if len(text) == _MILLIS else 1))[:-1]
    for pattern, names in _COMPILED:
        m = pattern.match(text)
        if m:
            return _sortable(dict(zip(names, (x or "" for x in m.groups()), strict=True)))
    return None


def normalize_bound(raw: str) -> str | None:
    """A bound of a range of dates: a year, a month, or any date."""
    text = raw.strip()
    if re.fullmatch(r"[0-9]{4}(-(0[1-9]|1[0-2]))?", text):
        return text
    return normalize_date(text)


def display_date(text: str) -> str:
    """Without seconds of zero and midnight."""
    text = text[:-3] if len(text) == 19 and text.endswith(":00") else text
    return text.removesuffix("T00:00").replace("T", " ", 1)


def shown_date(c: Column) -> Column:
    """``display_date`` of a column."""
    short = F.when(F.length(c) == 19, F.regexp_replace(c, ":00$", "")).otherwise(c)
    return F.regexp_replace(F.regexp_replace(short, "T00:00$", ""), "^([^T]*)T", "$1 ")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def date_column(c: Column) -> Column:
    """``normalize_date`` of a column, null where it isn't recognised.

    The parts are brought into one order, ``year|month|day|hour|minute|second|half``, and put right one after the other.
    """
    t = F.trim(c)
    parts = F.lit(None).cast("string")
    for x in reversed(SPELLINGS):
        place = {k: i + 1 for i, k in enumerate(x.order.upper())}
        parts = F.when(t.rlike(x.pattern), F.upper(F.regexp_replace(t, x.pattern, "|".join(f"${place[k]}" for k in "YMD") + "|$4|$5|$6|$7"))).otherwise(parts)
    for pattern, new in (
        (rf"^([0-{CENTURY // 10 - 1}]\d)\|", "20$1|"), (r"^(\d\d)\|", "19$1|"),  # short years
        (r"\|(?=\d(?:\||$))", "|0"),  # single digits
        (r"\|(\d\d)\|(\d\d)\|[6-9]\d\|", "|$1|$2|59|"), (r"\|(\d\d)\|(\d\d)\|\|", "|$1|$2|00|"),  # seconds beyond the minute, and none
    ):
        parts = F.regexp_replace(parts, pattern, new)

    def clock(p: Column) -> Column:
        hour = F.substring(p, 12, 2).try_cast("int") % 12 + F.when(p.endswith("PM"), 12).otherwise(0)
        return F.when(p.rlike("[AP]M$"), F.concat(F.substring(p, 1, 11), F.lpad(hour.cast("string"), 2, "0"), F.substring(p, 14, 7))).otherwise(p)

    def text(p: Column) -> Column:
        day = r"^[1-9]\d{3}\|(?:0[1-9]|1[0-2])\|(?:0[1-9]|[12]\d|3[01])\|"
        whole = F.regexp_replace(p, r"^(\d+)\|(\d+)\|(\d+)\|(\d+)\|(\d+)\|(\d+)\|.*", "$1-$2-$3T$4:$5:$6")
        return F.when(p.rlike(day + r"(?:[01]\d|2[0-3])\|[0-5]\d\|"), whole).when(p.rlike(day), F.translate(F.substring(p, 1, 10), "|", "-"))

    number = t.try_cast("bigint")
    seconds = F.when(F.length(t) == _MILLIS, F.floor(number / 1000)).otherwise(number)
    unix = F.replace(F.substring(F.timestamp_seconds(seconds).cast("timestamp_ntz").cast("string"), 1, 19), F.lit(" "), F.lit("T"))
    return F.when(t.rlike(f"^{_UNIX.pattern}$"), unix).otherwise(_once(_once(parts, clock), text))


def successor(bound: str) -> str:
    """Least text above every text that starts with ``bound``."""
    return bound + "￿"


def in_range(date: Column, since: str | None, until: str | None) -> Column:
    """Dates within both bounds; ``until`` includes everything of its own precision. Null dates are outside.

    Written as plain comparisons of the column, so that file statistics can prune by them.
    """
    ok = F.lit(True)
    if since is not None:
        ok = ok & (date >= since)
    if until is not None:
        ok = ok & (date <= successor(until)) & (F.substring(date, 1, len(until)) <= until)
    return ok
