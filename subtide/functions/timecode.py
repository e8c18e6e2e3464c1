"""Time codes: strict and lenient SRT times, formatting, and the time values of range lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subtide.functions.text import strip

STRICT = r"^(\d{2,}):([0-5]\d):([0-5]\d),(\d{3})$"
LENIENT = r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})"


def _seconds(text: Column, pattern: str) -> Column:
    """Seconds as a double, in the order of additions that the thresholds were made for; null if it doesn't match."""
    part = [F.regexp_extract(text, pattern, n).try_cast("double") for n in range(1, 5)]
    return F.when(text.rlike(pattern), part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000)


def strict_time(text: Column) -> Column:
    """Of stripped text."""
    return _seconds(text, STRICT)


def lenient_time(text: Column) -> Column:
    """Of stripped text; takes minutes and seconds up to 99 and anything after the milliseconds."""
    return _seconds(text, LENIENT)


def format_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded half to even; negative times are 0."""
    ms = F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    at = lambda div, mod: (F.floor(ms / div) % mod if mod else F.floor(ms / div)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", at(3_600_000, 0), at(60_000, 60), at(1000, 60), at(1, 1000))


def range_time(raw: Column) -> Column:
    """A range list's time value in seconds; null if it is none.

    Plain seconds (finite, not negative), mm:ss, hh:mm:ss with up to three decimals, or hh:mm:ss:mmm. A comma counts
    as a point. Non-finite numbers and digit separators are refused.
    """
    v = F.regexp_replace(strip(raw), ",", ".")
    n = F.size(F.split(v, ":"))
    part = lambda k: F.element_at(F.split(v, ":"), k).try_cast("double")
    sec = r"\d+(?:\.\d{1,3})?"
    plain = F.when(v.rlike(r"^[+]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double"))
    two = F.when(v.rlike(rf"^\d+:{sec}$") & (part(2) < 60), part(1) * 60 + part(2))
    three = F.when(v.rlike(rf"^\d+:\d+:{sec}$") & (part(2) < 60) & (part(3) < 60), part(1) * 3600 + part(2) * 60 + part(3))
    four = F.when(v.rlike(r"^\d+:\d+:\d+:\d{1,3}$") & (part(2) < 60) & (part(3) < 60), part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000)
    return F.when(n == 1, plain).when(n == 2, two).when(n == 3, three).when(n == 4, four)
