"""Sessions and weekdays (UTC) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session hours [start, end) in UTC in order of precedence, and timing points.
SESSIONS = (
    ("overlap", 12, 16, 3),
    ("london", 7, 16, 2),
    ("asia", 0, 8, 1),
    ("new_york", 12, 21, 2),
)
NO_SESSION = "dead_zone"
ALLOWED_SESSIONS = ("london", "new_york", "overlap")


def session_of(ts: Column) -> Column:
    hour = F.hour(ts)
    out = None
    for name, start, end, _ in SESSIONS:
        inside = (hour >= start) & (hour < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(NO_SESSION)


def session_points(session: Column) -> Column:
    out = F.lit(0)
    for name, _, _, points in SESSIONS:
        out = F.when(session == name, F.lit(points)).otherwise(out)
    return out


def session_allowed(ts: Column, allowed: tuple[str, ...] = ALLOWED_SESSIONS) -> Column:
    """On a weekday and inside an allowed session."""
    return (F.weekday(ts) < 5) & session_of(ts).isin(*allowed)


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def day_filter(ts: Column, best: Column, avoid: Column) -> Column:
    """``avoid`` wins over ``best``; every other day is ``neutral``."""
    day = day_name(ts)
    return (
        F.when(F.array_contains(avoid, day), "avoid")
        .when(F.array_contains(best, day), "best")
        .otherwise("neutral")
    )
