"""Column functions for text: trimming, cutting, redaction, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters to strip (tab, line feed and carriage return stay), and Unicode white space to trim.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_SPACES = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
OUTER_SPACE = rf"^{_SPACES}|{_SPACES}$"
MAX_BYTES = 500

#: What is hidden in log messages, and what stands there instead, in this order.
REDACTIONS = (
    (r"(?i)\b([a-z][a-z0-9+.-]*://)[^\s/@:]+:[^\s/@]+@", "$1***:***@"),
    (r"(?i)\bauthorization\s*[:=]\s*(?:bearer\s+)?[^\s,;]+", "authorization: ***"),
    (r"(?i)\bbearer\s+[^\s,;]+", "Bearer ***"),
    (r"(?i)\b(password|pwd|token|access_token|api_key|client_secret|secret)\s*([:=])\s*(?:\"[^\"]*\"|'[^']*'|[^\s,;]+)", "$1$2***"),
)


def trim_all(c: Column) -> Column:
    """Without outer white space of any kind; the built-in trim only takes spaces."""
    return F.regexp_replace(c, OUTER_SPACE, "")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def cut_bytes(c: Column, size: int = MAX_BYTES) -> Column:
    """At most ``size`` bytes, cut at a character boundary."""
    # up to three trailing bytes of a character that was cut through decode to replacement characters
    cut = F.regexp_replace(F.substring(c.cast("binary"), 1, size).cast("string"), "\ufffd+$", "")
    return F.when(F.octet_length(c) > size, cut).otherwise(c)


def normalized(c: Column, size: int = MAX_BYTES) -> Column:
    """Trimmed, without control characters, cut to bytes, and null where nothing is left."""
    return blank_to_null(cut_bytes(strip_control(trim_all(c)), size))


def redacted(c: Column) -> Column:
    for pattern, put in REDACTIONS:
        c = F.regexp_replace(c, pattern, put)
    return c


def amount(c: Column, kind: str = "decimal(18,4)") -> Column:
    """A number with thousands separators; unreadable or null is 0."""
    return F.coalesce(F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast(kind), F.lit(0).cast(kind))


def whole_seconds(c: Column) -> Column:
    """A zone-less time to the second; null where it is none."""
    return F.date_trunc("second", c.cast("string").try_cast("timestamp_ntz")).cast("timestamp_ntz")


def date_only(c: Column) -> Column:
    """A time's day, as a time; what is no time stays null."""
    return F.date_trunc("day", c.cast("string").try_cast("timestamp_ntz")).cast("timestamp_ntz")


def parsed_instant(c: Column, zone: str = "Asia/Shanghai") -> Column:
    """RFC 3339, else a zone-less time in ``zone``; in UTC, zone-less."""
    marked = c.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(marked, F.to_timestamp_ntz(F.date_format(F.try_to_timestamp(F.when(marked, c)), "yyyy-MM-dd HH:mm:ss"))).otherwise(
        F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.when(~marked, c).try_cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss"))
    )


def plain_stamp(c: Column) -> Column:
    """A printed time without T, fraction, Z or offset."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("T"), F.lit(" ")), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), r"\.[0-9]+$", "")


def text_list(c: Column) -> Column:
    """A JSON array of strings, or bare text as a list of one."""
    return F.when(c.rlike(r"^\s*\["), F.coalesce(F.from_json(c, "array<string>"), F.array(c))).when(F.trim(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def before_slash(c: Column) -> Column:
    return F.trim(F.substring_index(c, "/", 1))
