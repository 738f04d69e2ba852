"""Streams that need only watermarks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.functions.numbers import ratio
from tickweave.operators.rules import entry_text, signal_id
from tickweave.sources.bars import WINDOW_TEXT


def bars(ticks: DataFrame, tf: str, delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Bars of a tick stream, each emitted once when the watermark passes its end; later ticks are dropped."""
    order = F.struct("ts", tie)
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", WINDOW_TEXT[tf]).alias("_w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def weekdays_only(ticks: DataFrame) -> DataFrame:
    """Markets are closed at the weekend, so its ticks are stale."""
    return ticks.filter(F.weekday("ts") < 5)


def dedupe(signals: DataFrame, within: str = "1 hour") -> DataFrame:
    """One signal per id; an id holds the hour, so state older than an hour can go."""
    sig = signal_id(F.col("symbol"), F.col("direction"), entry_text(F.col("entry")), F.col("ts"))
    return signals.withColumn("sig_id", sig).withWatermark("ts", within).dropDuplicatesWithinWatermark(["sig_id"])


def rolling_performance(closed: DataFrame, span: str = "30 days", step: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Trades, wins and win rate over sliding windows of the opening time."""
    win = F.col("result") == "win"
    return (
        closed.withWatermark("opened_at", delay).groupBy(F.window("opened_at", span, step).alias("_w"))
        .agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(win, 1)).alias("wins"))
        .select(F.col("_w.start").alias("from_ts"), F.col("_w.end").alias("to_ts"), "trades", "wins", (ratio(F.col("wins"), F.col("trades")) * 100).alias("win_rate"))
    )
