"""Column helpers: identities, wire decimals, event times, text cleanup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, SIZE = "decimal(12,10)", "decimal(28,10)"


def prefixed(*values: Column) -> Column:
    """Values joined so that no two lists of values give the same text: ``length:value`` each, ``-``
    for null."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)) for v in values]
    return F.concat_ws("|", *parts)


def digest(*values: Column) -> Column:
    return F.sha2(prefixed(*[v.cast("string") for v in values]), 256)


def stable_id(prefix: str, *values: Column) -> Column:
    """An identity of its parts: prefix, dash, 32 hex digits."""
    return F.concat(F.lit(prefix + "-"), F.substring(digest(F.lit("v1"), *values), 1, 32))


def wire_decimal(text: Column, kind: str) -> Column:
    """A decimal from wire text, exact or null: more digits than ``kind`` holds are not rounded away."""
    plain = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$")
    wide = F.when(plain, text.try_cast("decimal(38,18)"))
    held = wide.try_cast(kind)
    digits = F.regexp_replace(F.regexp_replace(text, r"[eE].*$", ""), r"^[+-]?0*|\.", "")
    return F.when(plain & (held == wide) & (F.length(digits) <= 34) & _fits(text), held)


def _fits(text: Column) -> Column:
    """No digit beyond the eighteenth place, which the wide cast would round."""
    places = F.length(F.regexp_extract(F.regexp_replace(text, r"0+($|[eE])", "$1"), r"\.(\d*)", 1))
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    return places - power <= 18


def canonical_decimal(value: Column) -> Column:
    """Text without trailing zeros or a bare point; zero is 0."""
    text = value.cast("string")
    trimmed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(trimmed.isin("-0", ""), "0").otherwise(trimmed)


def event_time(raw: Column) -> Column:
    """struct(event_time, event_time_status): milliseconds since the epoch as a digit string. Missing
    (null or empty) and unparseable stay apart."""
    millis = F.when(raw.rlike(r"^-?\d{1,15}$"), raw.try_cast("long"))
    at = F.when(F.abs(millis) < F.lit(250_000_000_000_000), F.timestamp_millis(millis))
    status = F.when(raw.isNull() | (raw == ""), "missing").when(at.isNull(), "unparseable").otherwise("present")
    return F.struct(at.alias("event_time"), status.alias("event_time_status"))


#: Fixed characters: controls but tab and newline, C1, bidi marks and overrides, interlinear
#: annotation, zero-width space, byte order mark, tags.
DISPLAY_CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F-\x9F؜​‎‏ -‮⁦-⁩﻿￹-￻\x{E0000}-\x{E007F}]"


def neutralized(text: Column, identifier: bool = False, limit: int = 2000) -> Column:
    """Display controls become U+FFFD (in identifiers tab and newline too); a longer text is cut and
    ends in its length and 16 digits of its SHA-256."""
    clean = F.regexp_replace(text, DISPLAY_CONTROLS, "�")
    if identifier:
        clean = F.regexp_replace(clean, r"[\t\n]", "�")
    tail = F.concat(F.lit("...["), F.length(clean).cast("string"), F.lit(" chars sha256="), F.substring(F.sha2(clean, 256), 1, 16), F.lit("]"))
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), tail)).otherwise(clean)


def without_leading_zeros(text: Column) -> Column:
    """Digit strings that differ in leading zeros only are one identity."""
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"^0+(?=\d)", "")).otherwise(text)


def reasons(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for c, name in reversed(checks):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def unix_micros(at: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (read as the session's)."""
    return F.unix_micros(at.cast("timestamp"))


def micros(late: Column, early: Column) -> Column:
    return unix_micros(late) - unix_micros(early)
