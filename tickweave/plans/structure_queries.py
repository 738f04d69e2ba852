"""Queries on market structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators import indicators as ind
from tickweave.operators import structure
from tickweave.operators.frames import in_frames
from tickweave.plans import sql
from tickweave.plans.catalogue import present, query
from tickweave.session import cut
from tickweave.sources import tables

_AROUND = f"OVER ({sql.W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
SWINGS = f"""sw0 AS (SELECT *, count(*) {_AROUND} = 11 AND high = max(high) {_AROUND} AS is_high,
  count(*) {_AROUND} = 11 AND low = min(low) {_AROUND} AS is_low FROM bars),
swing AS (SELECT symbol, tf, 'high' AS side, ts, ix, high AS price, ix + 5 AS confirmed_ix FROM sw0 WHERE is_high
  UNION ALL SELECT symbol, tf, 'low', ts, ix, low, ix + 5 FROM sw0 WHERE is_low)"""
BROKEN = """broken AS (SELECT s.*, (SELECT min(b.ix) FROM bars b WHERE b.symbol = s.symbol AND b.ix > s.ix
  AND CASE WHEN s.side = 'high' THEN b.close > s.price ELSE b.close < s.price END) AS break_ix FROM swing s)"""


def as_of(points: str = "broken", at: str = "bars", name: str = "pit") -> str:
    """CTEs with the structure columns at every bar of ``at`` from swings confirmed by then."""
    def nth(side: str, k: int) -> str:
        return f"max(CASE WHEN side = '{side}' AND r = {k} THEN price END)"
    return f"""{name}_r AS (SELECT b.symbol, b.tf, b.ts, b.ix, b.close, s.side, s.price, s.break_ix,
    row_number() OVER (PARTITION BY b.symbol, b.ix, s.side ORDER BY s.ix DESC) AS r
  FROM {at} b LEFT JOIN {points} s ON s.symbol = b.symbol AND s.confirmed_ix <= b.ix QUALIFY r <= 5),
{name}_a AS (SELECT symbol, tf, ts, ix, close, {nth('high', 1)} AS h1, {nth('high', 2)} AS h2, {nth('low', 1)} AS l1, {nth('low', 2)} AS l2,
    max(CASE WHEN side = 'high' AND r <= 3 THEN price END) AS top, min(CASE WHEN side = 'low' AND r <= 3 THEN price END) AS bottom,
    max(CASE WHEN side = 'high' AND break_ix <= ix THEN break_ix END) AS bull,
    max(CASE WHEN side = 'low' AND break_ix <= ix THEN break_ix END) AS bear FROM {name}_r GROUP BY symbol, tf, ts, ix, close),
{name}_t AS (SELECT *, CASE WHEN h1 > h2 AND l1 > l2 THEN 'bullish' WHEN h1 < h2 AND l1 < l2 THEN 'bearish' ELSE 'ranging' END AS trend,
    CASE WHEN top IS NOT NULL AND bottom IS NOT NULL THEN (top + bottom)/2 ELSE close END AS equilibrium,
    top IS NOT NULL AND bottom IS NOT NULL AS has_both FROM {name}_a),
{name} AS (SELECT *, CASE WHEN has_both THEN top ELSE close END AS range_high, CASE WHEN has_both THEN bottom ELSE close END AS range_low,
    CASE WHEN NOT has_both THEN 'equilibrium' WHEN close >= equilibrium THEN 'premium' ELSE 'discount' END AS price_zone,
    CASE trend WHEN 'bullish' THEN bull WHEN 'bearish' THEN bear END AS bos_ix,
    CASE WHEN trend = 'bullish' AND bull IS NOT NULL THEN 'bullish' WHEN trend = 'bearish' AND bear IS NOT NULL THEN 'bearish' END AS bos_direction,
    CASE trend WHEN 'bullish' THEN bear WHEN 'bearish' THEN bull ELSE greatest(bull, bear) END AS choch_ix,
    CASE WHEN trend = 'bullish' THEN CASE WHEN bear IS NOT NULL THEN 'bearish' END
         WHEN trend = 'bearish' THEN CASE WHEN bull IS NOT NULL THEN 'bullish' END
         WHEN bull IS NOT NULL AND (bear IS NULL OR bull >= bear) THEN 'bullish' WHEN bear IS NOT NULL THEN 'bearish' END AS choch_direction
  FROM {name}_t)"""


LAST = "last_bar AS (SELECT * FROM bars QUALIFY ix = max(ix) OVER (PARTITION BY symbol))"
SNAPSHOT = f"{SWINGS}, {BROKEN}, {LAST}, {as_of(at='last_bar')}"
STRUCTURE_OUT = ("trend", "~range_high", "~range_low", "~equilibrium", "price_zone", "bos_direction", "bos_ix", "choch_direction", "choch_ix")
_NAMES = [c.lstrip("~") for c in STRUCTURE_OUT]


@query("st_swings", f"WITH {sql.event_bars('1h')}, {SWINGS} SELECT symbol, side, {sql.tx('ts')} AS ts, ix, price, confirmed_ix FROM swing")
def st_swings(spark: SparkSession, sf: str) -> DataFrame:
    return present(structure.swings(tables.indexed(spark, sf)), "symbol", "side", "ts", "ix", "price", "confirmed_ix")


@query("st_trend", f"WITH {sql.event_bars('1h')}, {SNAPSHOT} SELECT symbol, trend FROM pit")
def st_trend(spark: SparkSession, sf: str) -> DataFrame:
    arrays = structure.recent(structure.swings(tables.indexed(spark, sf)), 2)
    return present(arrays.withColumn("trend", structure.trend_of(F.col("highs"), F.col("lows"))), "symbol", "trend")


@query("st_breaks", f"""WITH {sql.event_bars('1h')}, {SNAPSHOT},
k AS (SELECT * FROM broken QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY ix DESC) <= 5)
SELECT k.symbol, p.trend, CASE WHEN (side = 'high' AND p.trend = 'bullish') OR (side = 'low' AND p.trend = 'bearish') THEN 'BOS' ELSE 'CHoCH' END AS kind,
  CASE side WHEN 'high' THEN 'bullish' ELSE 'bearish' END AS direction, k.price AS level, k.ix AS swing_ix, k.break_ix
FROM k JOIN pit p ON p.symbol = k.symbol WHERE k.break_ix IS NOT NULL""")
def st_breaks(spark: SparkSession, sf: str) -> DataFrame:
    bars = cut(tables.indexed(spark, sf))
    out = structure.breaks(structure.swings(bars), bars)
    return present(out, "symbol", "trend", "kind", "direction", "level", "swing_ix", "break_ix")


@query("st_last_bos_choch", f"WITH {sql.event_bars('1h')}, {SNAPSHOT} SELECT symbol, trend, bos_direction, bos_ix, choch_direction, choch_ix FROM pit")
def st_last_bos_choch(spark: SparkSession, sf: str) -> DataFrame:
    out = structure.snapshot(cut(tables.indexed(spark, sf)))
    return present(out, "symbol", "trend", "bos_direction", "bos_ix", "choch_direction", "choch_ix")


@query("st_liquidity", f"""WITH {sql.event_bars('1h')}, {sql.atr_sma()}, {SWINGS},
now AS (SELECT symbol, close AS px, atr FROM atrs QUALIFY ix = max(ix) OVER (PARTITION BY symbol)),
c AS (SELECT a.symbol, a.side, a.ix, a.price, n.px, n.atr, count(*) AS strength, avg(b.price) AS mean
  FROM swing a JOIN now n ON n.symbol = a.symbol JOIN swing b ON b.symbol = a.symbol AND b.side = a.side AND abs(b.price - a.price) <= n.px*0.001
  GROUP BY ALL),
z AS (SELECT symbol, side, ix, strength, CASE WHEN strength >= 2 THEN {sql.fx('mean', 5)} ELSE price END AS level,
  CASE WHEN strength >= 2 THEN 'equal_' || side || 's' ELSE 'swing_' || side END AS kind,
  CASE WHEN side = 'high' THEN px > (CASE WHEN strength >= 2 THEN mean ELSE price END) + atr*0.5
       ELSE px < (CASE WHEN strength >= 2 THEN mean ELSE price END) - atr*0.5 END AS swept FROM c)
SELECT symbol, {sql.fx('level', 5)} AS level, kind, strength, CAST(swept AS INTEGER) AS swept FROM z
QUALIFY row_number() OVER (PARTITION BY symbol, floor(level*1000 + 0.5) ORDER BY CASE side WHEN 'high' THEN 0 ELSE 1 END, ix) = 1""")
def st_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    bars = cut(in_frames(tables.indexed(spark, sf), ind.add_atr_sma, before=15))
    out = structure.liquidity_zones(structure.swings(bars), structure.last_bars(bars, "close", "atr"))
    return present(out, "symbol", "level", "kind", "strength", "swept", digits=5)


@query("st_premium_discount", f"WITH {sql.event_bars('1h')}, {SNAPSHOT} SELECT symbol, {sql.out('~range_high', '~range_low', '~equilibrium', 'price_zone')} FROM pit")
def st_premium_discount(spark: SparkSession, sf: str) -> DataFrame:
    bars = tables.indexed(spark, sf)
    out = structure.last_bars(bars, "close").join(structure.recent(structure.swings(bars), 3), ["symbol", "tf"])
    out = out.withColumns(structure.equilibrium_parts(F.col("highs"), F.col("lows"), F.col("close")))
    return present(out, "symbol", "range_high", "range_low", "equilibrium", "price_zone")


@query("st_snapshot", f"WITH {sql.event_bars('1h')}, {SNAPSHOT} SELECT symbol, {sql.tx('ts')} AS ts, {sql.out(*STRUCTURE_OUT)} FROM pit")
def st_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return present(structure.snapshot(cut(tables.indexed(spark, sf))), "symbol", "ts", *_NAMES)


@query("st_snapshot_pit", f"""WITH {sql.event_bars('1h')}, {SWINGS}, {BROKEN}, {as_of()}
SELECT symbol, {sql.tx('ts')} AS ts, {sql.out(*STRUCTURE_OUT)} FROM pit""")
def st_snapshot_pit(spark: SparkSession, sf: str) -> DataFrame:
    return present(structure.point_in_time(cut(tables.indexed(spark, sf))), "symbol", "ts", *_NAMES)


_C20 = f"OVER ({sql.W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)"
VECTOR = f"""vc AS (SELECT *, CASE WHEN count(*) {_C20} = 20 THEN max(high) {_C20} END AS swing_high,
  CASE WHEN count(*) {_C20} = 20 THEN min(low) {_C20} END AS swing_low,
  ema_21 > ema_50 AND close > ema_200 AS trend_bull, ema_21 < ema_50 AND close < ema_200 AS trend_bear FROM rs),
vec AS (SELECT *, coalesce(close > (swing_high + swing_low)/2, FALSE) AS premium, coalesce(close < (swing_high + swing_low)/2, FALSE) AS discount,
  coalesce(close > lag(swing_high) OVER ({sql.W}), FALSE) AS bos_bull, coalesce(close < lag(swing_low) OVER ({sql.W}), FALSE) AS bos_bear,
  trend_bull AND NOT coalesce(lag(trend_bull) OVER ({sql.W}), FALSE) AS choch_bull,
  trend_bear AND NOT coalesce(lag(trend_bear) OVER ({sql.W}), FALSE) AS choch_bear,
  coalesce(close <= swing_low + atr*0.5, FALSE) AS entry_bull, coalesce(close >= swing_high - atr*0.5, FALSE) AS entry_bear,
  coalesce(close > open AND lag(close) OVER ({sql.W}) < lag(open) OVER ({sql.W}) AND close > lag(open) OVER ({sql.W}) AND open < lag(close) OVER ({sql.W}), FALSE) AS bull_engulf,
  coalesce(close < open AND lag(close) OVER ({sql.W}) > lag(open) OVER ({sql.W}) AND close < lag(open) OVER ({sql.W}) AND open > lag(close) OVER ({sql.W}), FALSE) AS bear_engulf
  FROM vc)"""
FLAGS = ("trend_bull", "trend_bear", "premium", "discount", "bos_bull", "bos_bear", "choch_bull", "choch_bear", "entry_bull", "entry_bear", "bull_engulf", "bear_engulf")


@query("st_vector_signals", f"WITH {sql.event_bars('1h')}, {sql.core(name='rs')}, {VECTOR} SELECT symbol, {sql.tx('ts')} AS ts, {sql.out(*[f'?{f}' for f in FLAGS])} FROM vec")
def st_vector_signals(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return structure.add_vector_flags(ind.add_core(df, w), w)
    out = in_frames(tables.indexed(spark, sf), build, before=ind.core_margin() + 32, after=9)
    return present(out, "symbol", "ts", *FLAGS)


@query("pat_engulf_vector", f"WITH {sql.event_bars('1h')}, {sql.core(name='rs')}, {VECTOR} SELECT symbol, {sql.tx('ts')} AS ts, {sql.out('?bull_engulf', '?bear_engulf')} FROM vec WHERE bull_engulf OR bear_engulf")
def pat_engulf_vector(spark: SparkSession, sf: str) -> DataFrame:
    from tickweave.functions.candles import engulfs

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"bull_engulf": engulfs(w, 1, False), "bear_engulf": engulfs(w, -1, False)})
    out = in_frames(tables.indexed(spark, sf), build, before=1).filter(F.col("bull_engulf") | F.col("bear_engulf"))
    return present(out, "symbol", "ts", "bull_engulf", "bear_engulf")
