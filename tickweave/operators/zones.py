"""Entry zones at the last bar of each series: order blocks, gaps, retracements and the setup built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions.candles import confirmation
from tickweave.functions.numbers import fix
from tickweave.operators.frames import BLOCK_ROWS, KEYS, block_of, in_frames, running, tail_rows

# Retracement ratios and stop / target distances.
FIB_RATIOS = (0.5, 0.618, 0.786)
SL_ATR = 1.5
TP_RISK = (1.5, 2.5, 3.5)
MIN_RR = 1.5


def price_in_zone(price: Column, top: Column, bottom: Column, buffer: float = 0.001) -> Column:
    """Inside the zone widened by ``buffer`` of its height plus a ten-thousandth of its top."""
    margin = (top - bottom) * buffer + top * 0.0001
    return price.between(bottom - margin, top + margin)


def order_blocks(bars: DataFrame, lookback: int = 20, impulse_bars: int = 5) -> DataFrame:
    """Opposing candles of the last bars that were followed by a move of at least 2 ATR of the last bar.

    Only the last ``lookback`` bars of a series take part, so the windows here see at most that many rows.
    """
    tail = tail_rows(bars, lookback, F.col("ix").desc())
    w = Window.partitionBy(*KEYS).orderBy("ix")
    near = w.rowsBetween(1, impulse_bars)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = tail.withColumns({
        "_atr": F.last("atr").over(whole), "_n": F.last("ix").over(whole),
        "_up": F.max("high").over(near), "_down": F.min("low").over(near),
        "_min": F.min("close").over(later), "_max": F.max("close").over(later),
    })
    o, h, l, c, atr = (F.col(x) for x in ("open", "high", "low", "close", "_atr"))
    bull, bear = o > c, c > o
    impulse = F.when(bull, F.col("_up") - l).when(bear, h - F.col("_down"))
    df = df.filter((F.col("ix") < F.col("_n")) & (F.col("ix") >= 3) & (F.abs(c - o) >= atr * 0.1))
    df = df.withColumn("_impulse", impulse).filter(F.col("_impulse") >= atr * 2)
    return df.select(
        *KEYS, "ts", "ix",
        F.when(bull, "bullish").otherwise("bearish").alias("kind"),
        F.when(bull, o).otherwise(h).alias("top"),
        F.when(bull, l).otherwise(o).alias("bottom"),
        F.when(bull, F.col("_min") < l).otherwise(F.col("_max") > h).alias("mitigated"),
        fix(F.least(F.lit(3.0), F.try_divide(F.col("_impulse"), atr)), 2).alias("strength"),
    )


def fair_value_gaps(bars: DataFrame, last: DataFrame, min_atr: float = 0.3, keep: int | None = 20, rows: int = BLOCK_ROWS) -> DataFrame:
    """Three-candle gaps of at least ``min_atr`` ATR of the last bar; filled once a later bar trades through.

    ``last`` holds the last bar's atr per series. "Later" has no bound: the lowest low and highest high
    after each bar come from a reverse running extreme.
    """
    after = running(
        bars, {"_low_after": ("min", F.col("low")), "_high_after": ("max", F.col("high"))},
        ["ix"], block_of(rows=rows), reverse=True, exclusive=True,
    )

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)})

    df = in_frames(after, build, before=2, rows=rows)
    bull, bear = F.col("_h2") < F.col("low"), F.col("_l2") > F.col("high")
    df = df.filter(bull | bear).drop("atr").join(last.select(*KEYS, "atr"), [*KEYS])
    top = F.when(bull, F.col("low")).otherwise(F.col("_l2"))
    bottom = F.when(bull, F.col("_h2")).otherwise(F.col("high"))
    gaps = df.filter(top - bottom >= F.col("atr") * min_atr).select(
        *KEYS, "ts", "ix",
        F.when(bull, "bullish").otherwise("bearish").alias("kind"), top.alias("top"), bottom.alias("bottom"),
        F.coalesce(F.when(bull, F.col("_low_after") <= F.col("_h2")).otherwise(F.col("_high_after") >= F.col("_l2")), F.lit(False)).alias("filled"),
    )
    return gaps if keep is None else tail_rows(gaps, keep, F.col("ix").desc())


def fib_levels(high: Column, low: Column) -> Column:
    """Retracement levels of a range as an array of (ratio, level, kind)."""
    return F.array(*[
        F.struct(F.lit(r).alias("ratio"), fix(high - (high - low) * r, 5).alias("level"), F.lit("support").alias("kind"))
        for r in FIB_RATIOS
    ])


def fib_confluence(price: Column, levels: Column, within: float = 0.002) -> Column:
    """Some level lies closer to the price than ``within`` of it."""
    return F.coalesce(F.exists(levels, lambda z: F.try_divide(F.abs(price - z["level"]), price) < within), F.lit(False))


def swing_fib(highs: Column, lows: Column) -> Column:
    """Levels between the newest swing high and low of two arrays; empty without both."""
    return F.when(
        (F.size(highs) > 0) & (F.size(lows) > 0),
        fib_levels(F.get(highs, F.lit(0))["price"], F.get(lows, F.lit(0))["price"]),
    ).otherwise(F.array().cast("array<struct<ratio:double,level:double,kind:string>>"))


def both_directions(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", F.explode(F.array(F.lit("buy"), F.lit("sell"))))


def kind_of(direction: Column) -> Column:
    return F.when(direction == "buy", "bullish").otherwise("bearish")


def candle_check(bars: DataFrame) -> DataFrame:
    """Candle confirmation of the last bar of each series for both directions."""
    tail = tail_rows(bars.select(*KEYS, "ix", "open", "high", "low", "close"), 3, F.col("ix").desc())
    w = Window.partitionBy(*KEYS).orderBy("ix")
    df = tail.withColumns({
        "confirm_buy": confirmation(w, 1), "confirm_sell": confirmation(w, -1),
        "_last": F.lead("ix", 1).over(w).isNull(),
    })
    return df.filter("_last").select(*KEYS, "confirm_buy", "confirm_sell")


def match_zones(setups: DataFrame, blocks: DataFrame, gaps: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``ob`` (strongest open block holding the price, newest on ties) and ``fvg`` (newest such gap).

    With ``compat`` a block's kind is compared with the direction itself, so none ever matches.
    """
    want = F.col("direction") if compat else kind_of(F.col("direction"))
    base = setups.select(*KEYS, "direction", F.col("close").alias("_px"), want.alias("_okind"), kind_of(F.col("direction")).alias("_gkind"))
    ob = (
        base.join(blocks.filter(~F.col("mitigated")), [*KEYS])
        .filter((F.col("kind") == F.col("_okind")) & price_in_zone(F.col("_px"), F.col("top"), F.col("bottom"), 0.002))
        .groupBy(*KEYS, "direction").agg(F.max_by(F.struct("top", "bottom", "strength", "ix"), F.struct("strength", "ix")).alias("ob"))
    )
    fvg = (
        base.join(gaps.filter(~F.col("filled")), [*KEYS])
        .filter((F.col("kind") == F.col("_gkind")) & price_in_zone(F.col("_px"), F.col("top"), F.col("bottom"), 0.002))
        .groupBy(*KEYS, "direction").agg(F.max_by(F.struct("top", "bottom", "ix"), F.col("ix")).alias("fvg"))
    )
    return setups.join(ob, [*KEYS, "direction"], "left").join(fvg, [*KEYS, "direction"], "left")


def build_entry(df: DataFrame) -> DataFrame:
    """Prices, ratios and reason of each possible setup; rows without a valid setup are dropped.

    Needs direction, close, atr, price_zone, ob, fvg, fib_confluence, confirmation, bos_direction and
    choch_direction.
    """
    buy = F.col("direction") == "buy"
    sign = F.when(buy, 1.0).otherwise(-1.0)
    ob, fvg, zone, price, atr = (F.col(c) for c in ("ob", "fvg", "price_zone", "close", "atr"))
    wrong = (buy & (zone == "premium")) | (~buy & (zone == "discount"))
    good = (buy & (zone == "discount")) | (~buy & (zone == "premium"))
    bare = ob.isNull() & fvg.isNull()
    df = df.filter(~wrong & (~bare | good)).withColumn("atr_fallback", bare)
    stop = F.when(ob.isNotNull(), F.when(buy, ob["bottom"] - atr * 0.3).otherwise(ob["top"] + atr * 0.3)).otherwise(price - sign * atr * SL_ATR)
    df = df.withColumn("_sl", stop).withColumn("_risk", sign * (price - F.col("_sl"))).filter(F.col("_risk") > 0)
    df = df.withColumns({f"_tp{k}": price + sign * F.col("_risk") * m for k, m in enumerate(TP_RISK, 1)})
    df = df.withColumns({f"rr_tp{k}": fix(F.try_divide(F.abs(F.col(f"_tp{k}") - price), F.col("_risk")), 2) for k in (1, 2, 3)})
    df = df.filter(F.col("rr_tp1") >= MIN_RR)
    kind = kind_of(F.col("direction"))
    two = "%.2f"
    reason = F.concat_ws(
        ", ",
        F.when(ob.isNotNull(), F.concat(F.initcap("direction"), F.lit(" OB (strength "), F.format_string(two, ob["strength"]), F.lit("×)"))),
        F.when(fvg.isNotNull(), F.concat(F.initcap(kind), F.lit(" FVG at "), F.format_string(two, fvg["bottom"]), F.lit("–"), F.format_string(two, fvg["top"]))),
        F.when(F.col("atr_fallback"), F.concat(F.lit("ATR-based entry ("), zone, F.lit(" zone)"))),
        F.when(F.col("fib_confluence"), "Fib confluence"),
        F.when(F.col("confirmation") != "none", F.concat(F.initcap("confirmation"), F.lit(" candle confirm"))),
        F.when(F.col("bos_direction") == kind, "BOS confirmed"),
        F.when(F.col("choch_direction") == kind, "CHoCH confirmed"),
    )
    return df.withColumns({
        "entry": fix(price, 5), "stop_loss": fix(F.col("_sl"), 5),
        **{f"tp{k}": fix(F.col(f"_tp{k}"), 5) for k in (1, 2, 3)},
        "reason": F.when(reason == "", "Entry zone").otherwise(reason),
    }).drop("_sl", "_risk", "_tp1", "_tp2", "_tp3")
