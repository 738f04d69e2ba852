"""Market regimes per bar and their attachment to trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators import indicators as ind
from tickweave.operators.frames import KEYS


def add_live_regime(df: DataFrame, w: WindowSpec) -> DataFrame:
    """VOLATILE/QUIET from 14-bar against 50-bar mean true range, else TRENDING/RANGING from the 20-bar change.

    Short series average what they have. Margin: 50 rows back.
    """
    df = df.withColumn("_tr", ind.true_range(w, first=False))
    df = df.withColumns({
        "_a14": F.avg("_tr").over(w.rowsBetween(-13, 0)), "_a50": F.avg("_tr").over(w.rowsBetween(-49, 0)),
        "_old": F.lag("close", 19).over(w),
    })
    change = F.coalesce(F.abs(F.try_divide(F.col("close") - F.col("_old"), F.col("_old"))) * 100, F.lit(0.0))
    regime = (
        F.when(F.col("_a14").isNull(), "UNKNOWN")
        .when(F.col("_a14") > F.col("_a50") * 1.5, "VOLATILE")
        .when(F.col("_a14") < F.col("_a50") * 0.7, "QUIET")
        .when(change > 3, "TRENDING").otherwise("RANGING")
    )
    return df.withColumn("regime", regime).drop("_tr", "_a14", "_a50", "_old")


def add_research_regime(df: DataFrame, w: WindowSpec, lookback: int = 20) -> DataFrame:
    """Trend strength (20-bar change per ATR share), overridden by the ATR's rank in the 3 x lookback bars before.

    Needs ``atr``. Margin: 3 x lookback rows back.
    """
    span = lookback * 3
    close, atr = F.col("close"), F.col("atr")
    old = F.lag("close", lookback).over(w)
    roc = F.try_divide(close - old, old)
    strength = F.coalesce(F.when(atr > 0, F.try_divide(F.abs(roc), F.try_divide(atr, close))), F.lit(0.0))
    df = df.withColumn("_ts", strength).withColumn("_past", F.collect_list("atr").over(w.rowsBetween(-span, -1)))
    lower = F.size(F.filter("_past", lambda x: x < F.col("atr")))
    rank = F.when((F.size("_past") > 10) & atr.isNotNull(), F.try_divide(lower, F.size("_past")))
    df = df.withColumn("_rank", F.coalesce(rank, F.lit(0.5)))
    regime = (
        F.when(F.col("ix") < span, "UNCLASSIFIED")
        .when(F.col("_rank") > 0.75, "HIGH_VOL").when(F.col("_rank") < 0.25, "LOW_VOL")
        .when(F.col("_ts") > 1.5, "TRENDING").when(F.col("_ts") < 0.5, "RANGING").otherwise("MIXED")
    )
    return df.withColumn("regime", regime).drop("_ts", "_past", "_rank")


def add_adx_like(df: DataFrame, w: WindowSpec, lookback: int = 50) -> DataFrame:
    """20-bar move in ATRs: trending, ranging or transitioning; unknown for short series. Margin: 20 rows back."""
    strength = F.coalesce(F.try_divide(F.abs(F.col("close") - F.lag("close", 20).over(w)), F.col("atr")), F.lit(0.0))
    label = (
        F.when(F.col("ix") < lookback - 1, "unknown").when(strength > 1.5, "trending")
        .when(strength < 0.5, "ranging").otherwise("transitioning")
    )
    return df.withColumn("regime", label)


def as_of(
    trades: DataFrame, bars: DataFrame, value: str = "regime", ts: str = "ts", at: Column | None = None,
    keys=KEYS, bucket_seconds: int = 6 * 3600, missing: str | None = "UNKNOWN",
) -> DataFrame:
    """Give each trade the value of the last bar at or before its time, without a range join.

    Trades and bars of one (series, time bucket) are ordered together and the last value is carried
    forward; a bucket without an earlier bar takes the last value of earlier buckets from a table with
    one row per bucket. A hot series is spread over its buckets; shorten them for very dense trades.
    """
    moment = F.col(ts) if at is None else at
    tid = [c for c in trades.columns]
    left = trades.select(*keys, moment.alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("string").alias("_val"), F.struct(*tid).alias("_row"))
    right = bars.select(*keys, F.col("ts").alias("_at"), F.lit(0).alias("_k"), F.col(value).cast("string").alias("_val"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    mixed = left.unionByName(right).withColumn("_b", F.floor(F.unix_timestamp("_at") / bucket_seconds))
    last_in = mixed.groupBy(*keys, "_b").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.unix_micros("_at"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    local = Window.partitionBy(*keys, "_b").orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    joined = mixed.withColumn("_here", F.last("_val", ignorenulls=True).over(local)).filter(F.col("_k") == 1)
    out = joined.join(carry, [*keys, "_b"], "left")
    found = F.coalesce("_here", "_carry") if missing is None else F.coalesce(F.col("_here"), F.col("_carry"), F.lit(missing))
    return out.select("_row.*", found.alias(value))


def as_of_slots(
    trades: DataFrame, bars: DataFrame, slot_seconds: int, value: str = "regime", ts: str = "ts", at: Column | None = None,
    keys=KEYS, missing: str | None = "UNKNOWN",
) -> DataFrame:
    """As ``as_of`` for moments whose answer is that of their slot's start: no bar starts later in a moment's slot than its
    start (bars as long as the slots), or each moment is a start.

    Only the distinct slots are ordered with the bars; trades are joined with the slots' answers by equality, so they
    need no window, and no shuffle while the slots are few enough for Spark to broadcast.
    """
    seconds = F.unix_timestamp(F.col(ts) if at is None else at)
    marked = trades.withColumn("_slot", F.timestamp_seconds(F.floor(seconds / slot_seconds) * slot_seconds))
    known = as_of(marked.select(*keys, "_slot").distinct(), bars, value, ts="_slot", keys=keys, bucket_seconds=64 * slot_seconds, missing=missing)
    found = marked.join(known, [*keys, "_slot"], "left")
    return found.select(*trades.columns, F.col(value) if missing is None else F.coalesce(value, F.lit(missing)).alias(value))


def composition(trades: DataFrame, by=("regime",)) -> DataFrame:
    """Trades per regime."""
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"))
