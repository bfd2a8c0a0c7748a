"""Interval and time literals of the operators' arguments."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from flowspark.plans.errors import Err, FlowError

UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "": 1}


def micros(text: str | int) -> int:
    """"10us", "100ms", "1s", "1m", "2h" (a leading + is allowed) as microseconds; a bare number is microseconds."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\+?(\d+(?:\.\d+)?)(us|ms|s|m|h)?", text.strip())
    if not m:
        raise FlowError(Err.INVALID_ARGUMENT, f"no interval: {text!r}")
    return round(float(m[1]) * UNITS[m[2] or ""])


def absolute(text: str) -> int:
    """"2024-01-31 12:00:00" (UTC) as microseconds since the epoch."""
    try:
        return int(datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=UTC).timestamp()) * 1_000_000
    except ValueError:
        raise FlowError(Err.INVALID_ARGUMENT, f"no time: {text!r}") from None
