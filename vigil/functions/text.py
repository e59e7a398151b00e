"""Text and time expressions. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the log format's line trimming (as characters and
# as a pattern class), the colour code pattern, the event header, the suspect keywords.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = (
    r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{feff}"
)
ANSI = r"\x{1b}\[[0-9;]*m"
HEADER = (
    rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[^{SPACE}]+)[{SPACE}]+([^{SPACE}]+)[{SPACE}]"
    r"([^\n\r\x{2028}\x{2029}]*)\z"
)
SUSPECT_KEYWORDS = (
    "error", "exception", "timeout", "failed", "panic", "oom", "deadlock", "throttle",
)
SUSPECT_STATUS = "5[0-9]{2}"
SUSPECT = rf"(?i)({'|'.join(SUSPECT_KEYWORDS)}|{SUSPECT_STATUS})"
# Optional stricter form: whole words and whole status codes only.
SUSPECT_WORDS = rf"(?i)\b({'|'.join(SUSPECT_KEYWORDS)}|{SUSPECT_STATUS})\b"
EMBED_CAP = 4000

# Words in a failure text and the class they stand for, first hit wins.
FAILURE_CLASSES = (
    (("Connection refused",), "Service not running"),
    (("timeout", "timed out"), "Request timeout"),
    (("404",), "Endpoint not found"),
    (("500",), "Server error"),
    (("Could not resolve host",), "Host unreachable"),
)
FAILURE_OTHER = "Connection failed"

# Variable parts of a message: a cheap pattern that must occur, the mask, the placeholder.
# Applied in this order.
TEMPLATE_MASKS = (
    (
        r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-",
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        "<uuid>",
    ),
    (None, r"0x[0-9a-fA-F]+", "<hex>"),
    (None, r"[0-9]+", "<n>"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ansi(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), ANSI, "")


def trim_end(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(SPACE_CHARS))


def trim_space(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(SPACE_CHARS))


def not_blank(c: Column | str) -> Column:
    return _col(c).rlike(f"[^{SPACE}]")


def embed_text(c: Column | str, cap: int = EMBED_CAP) -> Column:
    """The text given to an embedder: no colour codes, at most `cap` characters."""
    return F.substring(strip_ansi(c), 1, cap)


def truncate(c: Column | str, n: int) -> Column:
    c = _col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def preview(c: Column | str, n: int) -> Column:
    c = _col(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def utc_wall_clock(ms: Column | str) -> Column:
    """Epoch milliseconds as a zone-less timestamp in UTC, whatever the session zone."""
    return F.timestamp_add("MILLISECOND", _col(ms), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def wall_clock_ms(ts_ntz: Column | str) -> Column:
    """Epoch milliseconds (floor) of a zone-less timestamp that holds UTC."""
    micros = F.timestamp_diff(
        "MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), _col(ts_ntz)
    )
    return F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000))


def iso_time(ms: Column | str) -> Column:
    return F.date_format(utc_wall_clock(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_hour(ms: Column | str) -> Column:
    return F.date_format(utc_wall_clock(ms), "yyyy-MM-dd'T'HH")


def iso_to_ms(c: Column | str) -> Column:
    """ISO text to epoch milliseconds; null where it is no time."""
    return F.unix_millis(F.try_to_timestamp(_col(c)))


def in_timezone(ms: Column | str, zone: str) -> Column:
    """US style local date and time of an instant in a named zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall_clock(ms))
    return F.date_format(local, "M/d/yyyy, h:mm:ss a")


def sha1_prefix(c: Column | str, n: int = 16) -> Column:
    return F.substring(F.sha1(_col(c)), 1, n)


def is_suspect(c: Column | str, pattern: str = SUSPECT) -> Column:
    """Does the message match the pattern anywhere?

    For the default pattern, plain substring searches rule out most messages, which is
    several times faster on long texts than the pattern; a hit is confirmed by it.
    """
    c = _col(c)
    if pattern != SUSPECT:
        return c.rlike(pattern)

    def has_keyword(low: Column) -> Column:
        hit = F.contains(low, F.lit(SUSPECT_KEYWORDS[0]))
        for word in SUSPECT_KEYWORDS[1:]:
            hit = hit | F.contains(low, F.lit(word))
        return hit

    # The one-element array binds the lower-cased text: a filter would compute it per keyword.
    maybe = F.exists(F.array(F.lower(c)), has_keyword)
    status = F.contains(c, F.lit("5")) & c.rlike(SUSPECT_STATUS)
    return status | (maybe & c.rlike(SUSPECT))


def failure_class(c: Column | str) -> Column:
    c = _col(c)
    out = None
    for words, label in FAILURE_CLASSES:
        hit = F.contains(c, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(c, F.lit(word))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(FAILURE_OTHER)


def message_template(c: Column | str) -> Column:
    out = _col(c)
    for occurs, pattern, placeholder in TEMPLATE_MASKS:
        masked = F.regexp_replace(out, pattern, placeholder)
        out = masked if occurs is None else F.when(out.rlike(occurs), masked).otherwise(out)
    return out


def like_any(text: str, *columns: str) -> Column:
    """Substring filter over several columns. `%` and `_` in the text stay wildcards."""
    pattern = "%" + text.strip().replace("\\", "\\\\") + "%"
    hit = F.col(columns[0]).like(pattern)
    for name in columns[1:]:
        hit = hit | F.col(name).like(pattern)
    return hit
