"""Number helpers shared by operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fix(c: Column, digits: int = 6) -> Column:
    """Round half up with plain double arithmetic, so that any SQL engine gives the same bits.

    For prices, ratios and percentages; ``fix_any`` takes numbers of any size.
    """
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def fix_any(c: Column, digits: int = 6) -> Column:
    """``fix`` that leaves numbers too large to have such digits as they are; for plain columns."""
    return F.when(F.abs(c) * float(10**digits) < 9e15, fix(c, digits)).otherwise(c)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient or null when the divisor is 0 or null."""
    return F.try_divide(top, bottom)


def format_price(price: Column, symbol: Column) -> Column:
    """Text with 2 decimals for gold, 3 for yen pairs and 5 for the rest."""
    return (
        F.when(symbol == "XAUUSD", F.format_string("%.2f", price))
        .when(symbol.isin("USDJPY", "GBPJPY"), F.format_string("%.3f", price))
        .otherwise(F.format_string("%.5f", price))
    )
