"""Relative and absolute start times, parsed once on the driver to a literal."""

from __future__ import annotations

import re
from datetime import datetime, timezone

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# The three accepted spellings and the length of each unit.
DIALECTS = {
    "a": re.compile(r"([0-9]+)\s*(m|h|d)", re.IGNORECASE),
    "b": re.compile(r"([0-9]+)([smhd])"),
    "c": re.compile(
        r"([0-9]+)\s*(minutes|minute|min|m|hours|hour|h|days|day|d)", re.IGNORECASE
    ),
}
UNIT_MS = {"s": 1000, "m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS}


def since_ms(text: str | None, as_of_ms: int, dialect: str = "a", strict: bool = True) -> int | None:
    """Cutoff in epoch milliseconds, or None for "no filter".

    A text that is no time raises; with `strict=False` it means no filter.
    """
    if text is None or text == "":
        return None
    candidate = text.strip() if dialect == "a" else text
    match = DIALECTS[dialect].fullmatch(candidate)
    if match:
        return as_of_ms - int(match[1]) * UNIT_MS[match[2][0].lower()]
    if dialect == "c":
        try:
            moment = datetime.fromisoformat(text)
        except ValueError:
            moment = None
        if moment is not None:
            if moment.tzinfo is None:
                moment = moment.replace(tzinfo=timezone.utc)
            return int(moment.timestamp() * 1000)
    if strict:
        raise ValueError(f"not a time expression: {text!r}")
    return None
