"""Time helpers: one numeric order key for every window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_S = 1_000_000
US_PER_DAY = 86_400 * US_PER_S


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(date: str | Column) -> Column:
    """Microseconds since epoch; works for timestamp and timestamp_ntz (session TZ is UTC)."""
    return F.unix_micros(col_of(date).cast("timestamp"))


def parse_window(w: str | int) -> int:
    """'10m', '1h', '24h', '7d', '10min' or seconds -> seconds."""
    if isinstance(w, (int, float)):
        return int(w)
    s = w.strip().lower()
    units = [("min", 60), ("d", 86400), ("h", 3600), ("m", 60), ("s", 1)]
    for suffix, mult in units:
        if s.endswith(suffix):
            return int(float(s[: -len(suffix)]) * mult)
    return int(s)
