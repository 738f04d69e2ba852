"""Character of a market: return distribution, sessions, hours, trending share, RSI, trend-following."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.frames import KEYS, dense_index, in_frames


def returns(bars: DataFrame) -> DataFrame:
    """Count, time range, mean, deviation, share of gains, skew and excess kurtosis (sample-corrected)."""
    r = F.col("return_1h")
    n, g1, g2 = F.count(r), F.skewness(r), F.kurtosis(r)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / F.try_subtract(n, F.lit(2)))
    kurt = F.when(n > 3, F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2.0) * (n - 3.0)))
    return bars.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("candles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        (F.avg(r) * 100).alias("avg_return"), (F.stddev_samp(r) * 100).alias("std_return"),
        (F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))) * 100).alias("positive_pct"),
        F.when(n > 2, skew).alias("skew"), kurt.alias("kurtosis"),
    )


def sessions(bars: DataFrame, slice_expr: Column) -> DataFrame:
    """Per session: bars, mean, deviation, volatility and how often the next bar of the session goes the candle's way.

    "Next" counts within the session, so its bars are numbered per (series, session) first.
    """
    keys = [*KEYS, "session"]
    own = dense_index(bars.filter(F.col("session") != "dead_zone"), keys, ["ts"], slice_expr, out="_no")
    framed = in_frames(own, lambda df, w: df.withColumn("_next", F.lead("close", 1).over(w)), after=1, keys=keys, ix="_no")
    fwd = F.try_divide(F.col("_next"), F.col("close")) - 1
    up = F.col("close") > F.col("open")
    hit = F.coalesce(F.when(up, fwd > 0).otherwise(fwd < 0), F.lit(False))
    r = F.col("return_1h")
    return framed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candles"), (F.avg(r) * 100).alias("avg_return"), (F.stddev_samp(r) * 100).alias("std_return"),
        F.avg("volatility").alias("volatility"), (F.avg(hit.cast("double")) * 100).alias("directional_win_rate"),
    )


def hourly(bars: DataFrame) -> DataFrame:
    """Mean, deviation, count and ratio per hour, with the ranks of the three best and three worst hours."""
    r = F.col("return_1h")
    out = bars.groupBy(*KEYS, "hour").agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.count(r).alias("count"))
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("mean").desc_nulls_last(), "hour"))
    worst = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("mean").asc_nulls_last(), "hour"))
    out = out.withColumns({"sharpe": F.try_divide(F.col("mean"), F.col("std")), "_b": best, "_w": worst})
    return out.withColumns({
        "best_rank": F.when(F.col("_b") <= 3, F.col("_b")), "worst_rank": F.when(F.col("_w") <= 3, F.col("_w")),
    }).drop("_b", "_w")


def regime_distribution(framed: DataFrame) -> DataFrame:
    """Share of bars whose 50-bar move is over 1.5, under 0.5 or between, in ATRs (column ``strength``)."""
    s = F.col("strength")
    share = lambda c: F.avg(F.when(s.isNotNull(), c.cast("double"))) * 100
    out = framed.groupBy(*KEYS).agg(share(s > 1.5).alias("trending"), share(s < 0.5).alias("ranging"))
    return out.withColumn("transitioning", 100 - F.col("trending") - F.col("ranging"))


def rsi_distribution(bars: DataFrame) -> DataFrame:
    n, rsi = F.count(F.lit(1)), F.col("rsi")
    return bars.groupBy(*KEYS).agg(
        F.avg(rsi).alias("mean"), F.stddev_samp(rsi).alias("std"),
        (F.count(F.when(rsi < 30, 1)) / n * 100).alias("oversold_pct"), (F.count(F.when(rsi > 70, 1)) / n * 100).alias("overbought_pct"),
    )


def ma_performance(framed: DataFrame, pairs: Sequence[tuple[int, int]] = ((9, 21), (21, 50), (50, 200))) -> DataFrame:
    """Return of following each pair of EMAs bar by bar (needs the EMAs and ``fwd_return``)."""
    items = F.array(*[
        F.struct(
            F.lit(f"ma_{f}_{s}").alias("pair"),
            (F.signum(F.col(f"ema_{f}") - F.col(f"ema_{s}")) * F.col("fwd_return")).alias("r"),
        ) for f, s in pairs
    ])
    long = framed.select(*KEYS, F.inline(items)).filter(F.col("r").isNotNull())
    std = F.stddev_samp("r")
    return long.groupBy(*KEYS, "pair").agg(
        (F.sum("r") * 100).alias("total_return_pct"), (F.avg((F.col("r") > 0).cast("double")) * 100).alias("win_rate"),
        F.when(std > 0, F.try_divide(F.avg("r"), std)).otherwise(0.0).alias("sharpe"), F.count(F.lit(1)).alias("trades"),
    )
