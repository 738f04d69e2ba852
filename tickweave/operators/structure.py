"""Market structure: swings, trend, breaks, liquidity and premium/discount.

Two views are offered: a snapshot at the last bar of each series, and point-in-time columns that at
every bar use only swings confirmed by then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions.candles import engulfs
from tickweave.operators import indicators as ind
from tickweave.operators.crossing import first_cross
from tickweave.operators.frames import BLOCK_ROWS, KEYS, block_of, dense_index, in_frames, running, tail_rows
from tickweave.session import cut

LOOKBACK = 5
SIDES = ("high", "low")


def swing_flags(df: DataFrame, w: WindowSpec, lookback: int = LOOKBACK) -> DataFrame:
    """``is_high``/``is_low``: extreme of the full window around the bar, ties included. Margin: lookback both ways."""
    around = w.rowsBetween(-lookback, lookback)
    full = F.count(F.lit(1)).over(around) == 2 * lookback + 1
    return df.withColumns({
        "is_high": full & (F.col("high") == F.max("high").over(around)),
        "is_low": full & (F.col("low") == F.min("low").over(around)),
    })


def swings(bars: DataFrame, lookback: int = LOOKBACK, rows: int = BLOCK_ROWS) -> DataFrame:
    """Swing points as rows (symbol, tf, side, ts, ix, price, confirmed_ix)."""
    flagged = in_frames(bars, lambda df, w: swing_flags(df, w, lookback), lookback, lookback, rows=rows)
    point = [
        F.when(F.col(f"is_{s}"), F.struct(F.lit(s).alias("side"), F.col(s).alias("price"))) for s in SIDES
    ]
    return (
        flagged.withColumn("_p", F.explode(F.array_compact(F.array(*point))))
        .select(*KEYS, "_p.side", "ts", "ix", "_p.price", (F.col("ix") + lookback).alias("confirmed_ix"))
    )


def last_bars(bars: DataFrame, *columns: str) -> DataFrame:
    """Last bar of each series with the given columns; combined before the shuffle."""
    picked = F.max_by(F.struct(*[F.col(c) for c in columns]), F.col("ix"))
    return bars.groupBy(*KEYS).agg(picked.alias("_b")).select(*KEYS, "_b.*")


def recent(points: DataFrame, k: int) -> DataFrame:
    """Last ``k`` swings per series and side as arrays ``highs`` and ``lows``, newest first."""
    tail = tail_rows(points, k, F.col("ix").desc(), keys=(*KEYS, "side"))
    item = F.struct(*[F.col(c) for c in tail.columns if c not in (*KEYS, "side", "ts", "confirmed_ix")])

    def side(name: str) -> Column:
        found = F.collect_list(F.when(F.col("side") == name, item))
        return F.reverse(F.array_sort(found))

    return tail.select(*KEYS, "side", *[c for c in tail.columns if c not in (*KEYS, "side")]).groupBy(*KEYS).agg(
        side("high").alias("highs"), side("low").alias("lows")
    )


def trend_of(highs: Column, lows: Column) -> Column:
    """Trend from the last two swings per side (arrays, newest first)."""
    h1, h2 = F.get(highs, F.lit(0))["price"], F.get(highs, F.lit(1))["price"]
    l1, l2 = F.get(lows, F.lit(0))["price"], F.get(lows, F.lit(1))["price"]
    return (
        F.when((h1 > h2) & (l1 > l2), "bullish").when((h1 < h2) & (l1 < l2), "bearish").otherwise("ranging")
    )


def equilibrium_parts(highs: Column, lows: Column, price: Column, n: int = 3) -> dict[str, Column]:
    """Range of the last ``n`` swings per side, its middle and the half the price is in."""
    top = F.array_max(F.transform(F.slice(highs, 1, n), lambda s: s["price"]))
    bottom = F.array_min(F.transform(F.slice(lows, 1, n), lambda s: s["price"]))
    both = (F.size(highs) > 0) & (F.size(lows) > 0)
    equil = F.when(both, (top + bottom) / 2).otherwise(price)
    return {
        "range_high": F.when(both, top).otherwise(price),
        "range_low": F.when(both, bottom).otherwise(price),
        "equilibrium": equil,
        "price_zone": F.when(~both, "equilibrium").when(price >= equil, "premium").otherwise("discount"),
    }


def with_breaks(points: DataFrame, bars: DataFrame) -> DataFrame:
    """Add ``break_ix``: first later close beyond the swing."""
    marked = points.withColumns({
        "up": F.when(F.col("side") == "high", F.col("price")),
        "down": F.when(F.col("side") == "low", F.col("price")),
    })
    return first_cross(marked, bars.select(*KEYS, "ix", "close"), out="break_ix").drop("up", "down")


def with_recent_breaks(tail: DataFrame, bars: DataFrame) -> DataFrame:
    """``break_ix`` for a few swings per series, in one pass over the bars.

    Crossings are reduced to the first per swing before any shuffle, so the pass costs no more than a
    filter with as many conditions as there are swings.
    """
    swing = tail.select(*KEYS, "side", F.col("ix").alias("_six"), F.col("price").alias("_level"))
    beyond = F.when(F.col("side") == "high", F.col("close") > F.col("_level")).otherwise(F.col("close") < F.col("_level"))
    hits = bars.select(*KEYS, "ix", "close").join(swing, [*KEYS]).filter((F.col("ix") > F.col("_six")) & beyond)
    first = hits.groupBy(*KEYS, "side", F.col("_six").alias("ix")).agg(F.min("ix").alias("break_ix"))
    return tail.join(first, [*KEYS, "side", "ix"], "left")


def breaks(points: DataFrame, bars: DataFrame, k: int = 5) -> DataFrame:
    """Breaks of the last ``k`` swings per side, labelled by the current trend, with recency rank.

    Breaks with the trend are BOS, all others CHoCH. Equal bars rank bullish before bearish, then by swing.
    """
    tail = tail_rows(points, k, F.col("ix").desc(), keys=(*KEYS, "side"))
    trend = recent(points, 2).select(*KEYS, trend_of(F.col("highs"), F.col("lows")).alias("trend"))
    found = with_recent_breaks(tail, bars).filter(F.col("break_ix").isNotNull()).join(trend, [*KEYS])
    up = F.col("side") == "high"
    with_trend = (up & (F.col("trend") == "bullish")) | (~up & (F.col("trend") == "bearish"))
    return found.select(
        *KEYS, "trend",
        F.when(with_trend, "BOS").otherwise("CHoCH").alias("kind"),
        F.when(up, "bullish").otherwise("bearish").alias("direction"),
        F.col("price").alias("level"), F.col("ix").alias("swing_ix"), "break_ix",
    )


def _latest(swing_list: Column, upto: Column | None = None) -> Column:
    """Latest break among the swings of an array, optionally only breaks up to a bar."""
    known = F.transform(swing_list, lambda s: s["break_ix"] if upto is None else F.when(s["break_ix"] <= upto, s["break_ix"]))
    return F.array_max(known)


def last_break_parts(trend: Column, bull: Column, bear: Column) -> dict[str, Column]:
    """Last BOS and CHoCH from the latest bullish and bearish break and the trend."""
    bos_ix = F.when(trend == "bullish", bull).when(trend == "bearish", bear)
    bos_dir = F.when(bos_ix.isNotNull(), trend)
    bull_wins = bull.isNotNull() & (bear.isNull() | (bull >= bear))
    choch_ix = F.when(trend == "bullish", bear).when(trend == "bearish", bull).otherwise(F.greatest(bull, bear))
    choch_dir = F.when(choch_ix.isNotNull(), F.when(
        trend == "bullish", "bearish").when(trend == "bearish", "bullish").when(bull_wins, "bullish").otherwise("bearish"))
    return {"bos_direction": bos_dir, "bos_ix": bos_ix, "choch_direction": choch_dir, "choch_ix": choch_ix}


def snapshot(bars: DataFrame, points: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Structure at the last bar of each series: one row with swing arrays (newest first, 10 per side).

    ``bars`` is read several times, so pass a written table rather than a long plan.
    """
    points = swings(bars) if points is None else points
    tail = tail_rows(points, 10, F.col("ix").desc(), keys=(*KEYS, "side"))
    arrays = recent(with_recent_breaks(tail, bars), 10)
    last = last_bars(bars, "ts", "ix", "close", *extra)
    out = last.join(arrays, [*KEYS], "left")
    none = F.array().cast(arrays.schema["highs"].dataType)
    out = out.withColumns({"highs": F.coalesce("highs", none), "lows": F.coalesce("lows", none)})
    out = out.withColumn("trend", trend_of(F.col("highs"), F.col("lows")))
    out = out.withColumns(equilibrium_parts(F.col("highs"), F.col("lows"), F.col("close")))
    out = out.withColumns({
        "_bull": _latest(F.slice("highs", 1, 5)), "_bear": _latest(F.slice("lows", 1, 5)),
    })
    return out.withColumns(last_break_parts(F.col("trend"), F.col("_bull"), F.col("_bear"))).drop("_bull", "_bear")


def point_in_time(bars: DataFrame, lookback: int = LOOKBACK, k: int = 5, rows: int = BLOCK_ROWS) -> DataFrame:
    """Structure columns at every bar, from swings confirmed by then and breaks that happened by then.

    Swings are numbered per side; in that numbering the last ``k`` are a bounded window. A bar finds its
    list by the number of swings confirmed so far, an equality join. ``bars`` is read once per search
    level, so pass a written table rather than a long plan.
    """
    flagged = in_frames(
        bars,
        lambda df, w: swing_flags(df, w, lookback).withColumns({
            f"_c{s}": F.lag(F.col(f"is_{s}").cast("int"), lookback, 0).over(w) for s in SIDES
        }),
        before=2 * lookback, after=lookback, rows=rows,
    )
    points = with_breaks(cut(swings(bars, lookback, rows)), bars)
    counted = running(
        flagged, {f"_n_{s}": ("sum", F.col(f"_c{s}")) for s in SIDES}, ["ix"], block_of(rows=rows)
    )
    out = counted
    side_keys = (*KEYS, "side")
    numbered = dense_index(points, side_keys, ["ix"], F.floor(F.col("ix") / rows), out="_no")
    item = F.struct("ix", "price", "break_ix")
    lists = in_frames(
        numbered, lambda df, w: df.withColumn("_list", F.reverse(F.collect_list(item).over(w.rowsBetween(-(k - 1), 0)))),
        before=k - 1, keys=side_keys, ix="_no", rows=rows,
    )
    for s, name in (("high", "highs"), ("low", "lows")):
        side = lists.filter(F.col("side") == s).select(*KEYS, (F.col("_no") + 1).alias(f"_n_{s}"), F.col("_list").alias(name))
        out = out.join(side, [*KEYS, f"_n_{s}"], "left")
        empty = F.array().cast(side.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(name, empty))
    out = out.withColumn("trend", trend_of(F.col("highs"), F.col("lows")))
    out = out.withColumns(equilibrium_parts(F.col("highs"), F.col("lows"), F.col("close")))
    out = out.withColumns({
        "_bull": _latest(F.col("highs"), F.col("ix")), "_bear": _latest(F.col("lows"), F.col("ix")),
    })
    parts = last_break_parts(F.col("trend"), F.col("_bull"), F.col("_bear"))
    drop = ["_bull", "_bear", "is_high", "is_low", *[f"_c{s}" for s in SIDES], *[f"_n_{s}" for s in SIDES]]
    return out.withColumns(parts).drop(*drop)


# --- liquidity -------------------------------------------------------------------------------

def liquidity_zones(points: DataFrame, last: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Swings of one side within ``tolerance`` of the current price of each other form one level.

    ``last`` holds close and atr per series. Equal prices are merged first. The cluster of each price is
    the difference of two running sums over the sorted prices, read at price - tol and price + tol, so
    no pair of swings is ever formed. The sums are decimals of 12 places, so their differences are exact however
    long they are; sorted prices are cut into pieces of equal size, however narrow the range they lie in.
    Levels equal to 3 decimals keep the first, highs before lows.
    """
    side_keys = (*KEYS, "side")
    merged = points.groupBy(*side_keys, "price").agg(F.count(F.lit(1)).alias("n"), F.min("ix").alias("first_ix"))
    levels = merged.join(last.select(*KEYS, F.col("close").alias("_now"), F.col("atr").alias("_atr")), [*KEYS])
    levels = levels.withColumn("_tol", F.abs(F.col("_now")) * tolerance)
    mark = F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("price") - F.col("_tol")).alias("at")),
        F.struct(F.lit(1).alias("kind"), F.col("price").alias("at")),
        F.struct(F.lit(2).alias("kind"), (F.col("price") + F.col("_tol")).alias("at")),
    )
    marks = levels.withColumn("_m", F.explode(mark)).select("*", "_m.kind", "_m.at").drop("_m")
    own, order = F.col("kind") == 1, ["at", "kind", "price"]
    marks = cut(marks.repartitionByRange(*side_keys, *order).withColumn("_piece", F.spark_partition_id()))
    weighted = F.col("n").cast("decimal(10,0)") * F.col("price").cast("decimal(26,12)")
    sums = running(
        marks,
        {"_cn": ("sum", F.when(own, F.col("n")).otherwise(0)), "_cs": ("sum", F.when(own, weighted).otherwise(F.lit(0).cast("decimal(37,12)")))},
        order, F.col("_piece"), keys=side_keys,
    )

    def read(kind: int, c: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(c)))

    clusters = sums.groupBy(*side_keys, "price").agg(
        F.first("n").alias("n"), F.first("first_ix").alias("first_ix"), F.first("_now").alias("_now"), F.first("_atr").alias("_atr"),
        (read(2, "_cn") - read(0, "_cn")).alias("strength"), (read(2, "_cs") - read(0, "_cs")).cast("double").alias("_total"),
    )
    high = F.col("side") == "high"
    many = F.col("strength") >= 2
    level = F.when(many, F.floor(F.col("_total") / F.col("strength") * 1e5 + 0.5) / 1e5).otherwise(F.col("price"))
    raw = F.when(many, F.col("_total") / F.col("strength")).otherwise(F.col("price"))
    zones = clusters.withColumns({
        "level": level,
        "kind": F.concat(F.when(many, "equal_").otherwise("swing_"), F.col("side"), F.when(many, "s").otherwise("")),
        "swept": F.when(high, F.col("_now") > raw + F.col("_atr") * 0.5).otherwise(F.col("_now") < raw - F.col("_atr") * 0.5),
        "_key": F.floor(level * 1000 + 0.5),
    })
    kept = tail_rows(zones, 1, [F.when(high, 0).otherwise(1), F.col("first_ix")], keys=(*KEYS, "_key"))
    return kept.select(*KEYS, "level", "kind", "strength", "swept")


# --- vector flags ----------------------------------------------------------------------------

def add_vector_flags(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Structure flags per bar from EMAs and centred extremes (these look 9 bars ahead).

    Needs research columns. Margin: 11 back, 9 ahead.
    """
    df = ind.add_centered_extrema(df, w, 20)
    c = F.col("close")
    no = F.lit(False)
    bull = F.coalesce((F.col("ema_21") > F.col("ema_50")) & (c > F.col("ema_200")), no)
    bear = F.coalesce((F.col("ema_21") < F.col("ema_50")) & (c < F.col("ema_200")), no)
    mid = (F.col("swing_high") + F.col("swing_low")) / 2
    df = df.withColumns({"trend_bull": bull, "trend_bear": bear})
    return df.withColumns({
        "premium": F.coalesce(c > mid, no),
        "discount": F.coalesce(c < mid, no),
        "bos_bull": F.coalesce(c > F.lag("swing_high", 1).over(w), no),
        "bos_bear": F.coalesce(c < F.lag("swing_low", 1).over(w), no),
        "choch_bull": F.col("trend_bull") & ~F.coalesce(F.lag("trend_bull", 1).over(w), no),
        "choch_bear": F.col("trend_bear") & ~F.coalesce(F.lag("trend_bear", 1).over(w), no),
        "entry_bull": F.coalesce(c <= F.col("swing_low") + F.col("atr") * 0.5, no),
        "entry_bear": F.coalesce(c >= F.col("swing_high") - F.col("atr") * 0.5, no),
        "bull_engulf": engulfs(w, 1, bigger_body=False),
        "bear_engulf": engulfs(w, -1, bigger_body=False),
    })
