"""Candle patterns as column expressions over an ordered window of bars."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def engulfs(w: WindowSpec, side: int, bigger_body: bool) -> Column:
    """The body covers the previous body of the other colour (``side`` 1 up, -1 down).

    With ``bigger_body`` the previous colour is free but the body must be larger.
    """
    o, c = F.col("open"), F.col("close")
    po, pc = F.lag("open", 1).over(w), F.lag("close", 1).over(w)
    if side > 0:
        core = (c > o) & (o < pc) & (c > po)
        opposite = pc < po
    else:
        core = (c < o) & (o > pc) & (c < po)
        opposite = pc > po
    extra = (F.abs(c - o) > F.abs(pc - po)) if bigger_body else opposite
    return F.coalesce(core & extra, F.lit(False))


def rejects(side: int) -> Column:
    """Wick against the direction at least twice the body; a bar without a body never counts."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body = F.abs(c - o)
    wick = F.least(c, o) - l if side > 0 else h - F.greatest(c, o)
    return (body > 0) & (wick >= body * 2)


def confirmation(w: WindowSpec, side: int) -> Column:
    """``engulfing``, else ``rejection``, else ``none``; the first two bars of a series have none."""
    return (
        F.when(F.col("ix") < 2, "none")
        .when(engulfs(w, side, bigger_body=True), "engulfing")
        .when(rejects(side), "rejection")
        .otherwise("none")
    )
