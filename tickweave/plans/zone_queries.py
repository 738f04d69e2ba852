"""Queries on entry zones, scoring, routing and regimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.functions.candles import confirmation
from tickweave.operators import indicators as ind
from tickweave.operators import open_zones, regime, rules, scoring, signals, structure, zones
from tickweave.operators.frames import KEYS, in_frames, index_bars
from tickweave.plans import live, sql
from tickweave.plans.catalogue import present, query
from tickweave.plans.signal_queries import _FB_LIVE, fb_setups
from tickweave.plans.structure_queries import BROKEN, SWINGS, VECTOR, as_of
from tickweave.session import cut
from tickweave.sources import tables
from tickweave.sources.bars import resample

# Several series at once: events at 1h and 4h and the daily series, each a symbol of its own.
_MIXED = f"""{sql.event_bars('1h', 'e1')}, {sql.event_bars('4h', 'e4')}, {sql.daily_bars('dd')},
bars AS (SELECT symbol || ' ' || tf AS symbol, tf, ts, open, high, low, close, volume, ix FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM dd))"""


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    hourly = cut(tables.event_bars(spark, sf, "1h"))
    # Longer bars come from the hourly ones, so the ticks are read once.
    parts = [hourly, resample(hourly, "4h"), tables.daily_bars(spark, sf)]
    bars = index_bars(cut(reduce(DataFrame.unionByName, parts)))
    return bars.withColumn("symbol", F.concat_ws(" ", "symbol", "tf"))


def mixed_atr(spark: SparkSession, sf: str) -> DataFrame:
    return in_frames(mixed(spark, sf), ind.add_atr_sma, before=15)


_BUF = "((top - bottom)*0.002 + top*0.0001)"
_NOW = "now AS (SELECT symbol, tf, ts, ix, close, atr FROM atrs QUALIFY ix = max(ix) OVER (PARTITION BY symbol))"
_OB = f"""ob0 AS (SELECT a.*, n.atr AS natr, n.ix AS nix, max(a.high) OVER (PARTITION BY a.symbol ORDER BY a.ix ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS up,
  min(a.low) OVER (PARTITION BY a.symbol ORDER BY a.ix ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS down,
  min(a.close) OVER (PARTITION BY a.symbol ORDER BY a.ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cmin,
  max(a.close) OVER (PARTITION BY a.symbol ORDER BY a.ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS cmax
  FROM atrs a JOIN now n ON n.symbol = a.symbol),
ob1 AS (SELECT *, CASE WHEN open > close THEN up - low WHEN close > open THEN high - down END AS impulse FROM ob0
  WHERE ix < nix AND ix > nix - 20 AND abs(close - open) >= natr*0.1),
ob AS (SELECT symbol, ts, ix, CASE WHEN open > close THEN 'bullish' ELSE 'bearish' END AS kind, CASE WHEN open > close THEN open ELSE high END AS top,
  CASE WHEN open > close THEN low ELSE open END AS bottom, CASE WHEN open > close THEN cmin < low ELSE cmax > high END AS mitigated,
  {sql.fx('least(3.0, impulse/natr)', 2)} AS strength FROM ob1 WHERE impulse >= natr*2)"""
_FVG = f"""fv0 AS (SELECT a.*, n.atr AS natr, lag(a.high, 2) OVER (PARTITION BY a.symbol ORDER BY a.ix) AS h2, lag(a.low, 2) OVER (PARTITION BY a.symbol ORDER BY a.ix) AS l2,
  min(a.low) OVER (PARTITION BY a.symbol ORDER BY a.ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lmin,
  max(a.high) OVER (PARTITION BY a.symbol ORDER BY a.ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hmax FROM atrs a JOIN now n ON n.symbol = a.symbol),
fvg AS (SELECT symbol, ts, ix, CASE WHEN h2 < low THEN 'bullish' ELSE 'bearish' END AS kind, CASE WHEN h2 < low THEN low ELSE l2 END AS top,
  CASE WHEN h2 < low THEN h2 ELSE high END AS bottom, coalesce(CASE WHEN h2 < low THEN lmin <= h2 ELSE hmax >= l2 END, FALSE) AS filled FROM fv0
  WHERE CASE WHEN h2 < low THEN low - h2 WHEN l2 > high THEN l2 - high END >= natr*0.3
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ix DESC) <= 20)"""


@query("ez_order_blocks", f"WITH {_MIXED}, {sql.atr_sma()}, {_NOW}, {_OB} SELECT symbol, {sql.tx('ts')} AS ts, kind, {sql.out('~top', '~bottom', '?mitigated', '~strength')} FROM ob")
def ez_order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return present(zones.order_blocks(mixed_atr(spark, sf)), "symbol", "ts", "kind", "top", "bottom", "mitigated", "strength")


@query("ez_fvg", f"WITH {_MIXED}, {sql.atr_sma()}, {_NOW}, {_FVG} SELECT symbol, {sql.tx('ts')} AS ts, kind, {sql.out('~top', '~bottom', '?filled')} FROM fvg")
def ez_fvg(spark: SparkSession, sf: str) -> DataFrame:
    bars = mixed_atr(spark, sf)
    return present(zones.fair_value_gaps(bars, structure.last_bars(bars, "atr")), "symbol", "ts", "kind", "top", "bottom", "filled")


def _open_zones(src: str) -> str:
    """CTEs with the open order block (oz) and gap (gz) that hold the close at each bar of ``src``, per direction."""
    return f"""oz0 AS (SELECT t.symbol, t.ts, t.ix AS tix, t.close AS px, t.atr AS natr, i.ix, i.open, i.high, i.low, i.close, max(CASE WHEN m.ix <= i.ix + 5 THEN m.high END) AS up,
    min(CASE WHEN m.ix <= i.ix + 5 THEN m.low END) AS down, min(m.close) AS cmin, max(m.close) AS cmax
  FROM {src} t JOIN {src} i ON i.symbol = t.symbol AND i.ix BETWEEN t.ix - 19 AND t.ix - 1 AND i.ix >= 3 AND abs(i.close - i.open) >= t.atr*0.1
  JOIN {src} m ON m.symbol = t.symbol AND m.ix > i.ix AND m.ix <= t.ix GROUP BY ALL),
oz1 AS (SELECT *, CASE WHEN open > close THEN 'buy' ELSE 'sell' END AS direction, CASE WHEN open > close THEN open ELSE high END AS top, CASE WHEN open > close THEN low ELSE open END AS bottom,
    CASE WHEN open > close THEN up - low WHEN close > open THEN high - down END AS impulse FROM oz0 WHERE CASE WHEN open > close THEN cmin >= low ELSE cmax <= high END),
oz AS (SELECT symbol, ts, tix, direction, top, bottom, {sql.fx('least(3.0, impulse/natr)', 2)} AS strength, ix FROM oz1
  WHERE impulse >= natr*2 AND px BETWEEN bottom - {_BUF} AND top + {_BUF} QUALIFY row_number() OVER (PARTITION BY symbol, tix, direction ORDER BY strength DESC, ix DESC) = 1),
gz0 AS (SELECT *, lag(high, 2) OVER ({sql.W}) AS h2, lag(low, 2) OVER ({sql.W}) AS l2 FROM {src}),
gz1 AS (SELECT symbol, ix, CASE WHEN h2 < low THEN 'buy' ELSE 'sell' END AS direction, CASE WHEN h2 < low THEN low ELSE l2 END AS top, CASE WHEN h2 < low THEN h2 ELSE high END AS bottom
  FROM gz0 WHERE h2 < low OR l2 > high),
gz2 AS (SELECT g.*, (SELECT min(b.ix) FROM {src} b WHERE b.symbol = g.symbol AND b.ix > g.ix AND CASE WHEN g.direction = 'buy' THEN b.low <= g.bottom ELSE b.high >= g.top END) AS death FROM gz1 g),
gz3 AS (SELECT t.symbol, t.ts, t.ix AS tix, t.close AS px, g.direction, g.top, g.bottom, g.ix, g.death FROM {src} t JOIN gz2 g ON g.symbol = t.symbol AND g.ix <= t.ix AND g.top - g.bottom >= t.atr*0.3
  QUALIFY row_number() OVER (PARTITION BY t.symbol, t.ix ORDER BY g.ix DESC) <= 20),
gz AS (SELECT symbol, ts, tix, direction, top, bottom, ix FROM gz3 WHERE (death IS NULL OR death > tix) AND px BETWEEN bottom - {_BUF} AND top + {_BUF}
  QUALIFY row_number() OVER (PARTITION BY symbol, tix, direction ORDER BY ix DESC) = 1)"""


def open_zones_1h(spark: SparkSession, sf: str) -> DataFrame:
    return open_zones.zones_as_of(cut(in_frames(tables.indexed(spark, sf), ind.add_atr_sma, before=15)))


@query("ez_order_blocks_pit", f"WITH {sql.event_bars('1h')}, {sql.atr_sma()}, {_open_zones('atrs')} SELECT symbol, {sql.tx('ts')} AS ts, direction, {sql.out('~top', '~bottom', '~strength')}, ix FROM oz")
def ez_order_blocks_pit(spark: SparkSession, sf: str) -> DataFrame:
    """Open order block that holds the close at every bar, from what is known then."""
    out = open_zones_1h(spark, sf).filter("ob_ix IS NOT NULL")
    return present(out.select("symbol", "ts", "direction", F.col("ob_top").alias("top"), F.col("ob_bottom").alias("bottom"), F.col("ob_strength").alias("strength"), F.col("ob_ix").alias("ix")))


@query("ez_fvg_pit", f"WITH {sql.event_bars('1h')}, {sql.atr_sma()}, {_open_zones('atrs')} SELECT symbol, {sql.tx('ts')} AS ts, direction, {sql.out('~top', '~bottom')}, ix FROM gz")
def ez_fvg_pit(spark: SparkSession, sf: str) -> DataFrame:
    """Newest open gap that holds the close at every bar, from what is known then."""
    out = open_zones_1h(spark, sf).filter("fvg_ix IS NOT NULL")
    return present(out.select("symbol", "ts", "direction", F.col("fvg_top").alias("top"), F.col("fvg_bottom").alias("bottom"), F.col("fvg_ix").alias("ix")))


_PIT = f"{SWINGS}, {BROKEN}, {as_of()}"
_RATIOS = "(VALUES (0.5::DOUBLE), (0.618::DOUBLE), (0.786::DOUBLE)) q(ratio)"


@query("ez_fib", f"""WITH {sql.event_bars('1h')}, {_PIT}
SELECT symbol, {sql.tx('ts')} AS ts, ratio, {sql.fx('h1 - (h1 - l1)*ratio', 5)} AS level, 'support' AS kind FROM pit, {_RATIOS}
WHERE h1 IS NOT NULL AND l1 IS NOT NULL""")
def ez_fib(spark: SparkSession, sf: str) -> DataFrame:
    pit = structure.point_in_time(cut(tables.indexed(spark, sf)))
    out = pit.select("symbol", "ts", F.inline(zones.swing_fib(F.col("highs"), F.col("lows"))))
    return present(out, "symbol", "ts", "ratio", "level", "kind", digits=5)


_FIB_HIT = f"""SELECT symbol, ix, ts, close, coalesce(bool_or(abs(close - {sql.fx('h1 - (h1 - l1)*ratio', 5)})/nullif(close, 0) < 0.002), FALSE) AS fib_confluence
  FROM pit, {_RATIOS} GROUP BY symbol, ix, ts, close"""


@query("ez_fib_confluence", f"WITH {sql.event_bars('1h')}, {_PIT}, f AS ({_FIB_HIT}) SELECT symbol, {sql.tx('ts')} AS ts, {sql.out('?fib_confluence')} FROM f")
def ez_fib_confluence(spark: SparkSession, sf: str) -> DataFrame:
    pit = structure.point_in_time(cut(tables.indexed(spark, sf)))
    hit = zones.fib_confluence(F.col("close"), zones.swing_fib(F.col("highs"), F.col("lows")))
    return present(pit.withColumn("fib_confluence", hit), "symbol", "ts", "fib_confluence")


@query("ez_price_in_zone", f"""WITH {sql.event_bars('1h')}, z AS (SELECT *, lag(high) OVER ({sql.W}) AS top, lag(low) OVER ({sql.W}) AS bottom FROM bars)
SELECT symbol, {sql.tx('ts')} AS ts, CAST(close BETWEEN bottom - ((top - bottom)*0.002 + top*0.0001) AND top + ((top - bottom)*0.002 + top*0.0001) AS INTEGER) AS inside FROM z""")
def ez_price_in_zone(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("inside", zones.price_in_zone(F.col("close"), F.lag("high", 1).over(w), F.lag("low", 1).over(w), 0.002))
    return present(in_frames(tables.indexed(spark, sf), build, before=1), "symbol", "ts", "inside")


_MATCH = f"""dirs(direction, want) AS (VALUES ('buy', 'bullish'), ('sell', 'bearish')),
mob AS (SELECT n.symbol, d.direction, o.top, o.bottom, o.strength, o.ix FROM now n CROSS JOIN dirs d JOIN ob o ON o.symbol = n.symbol AND o.kind = d.want
  AND NOT o.mitigated AND n.close BETWEEN o.bottom - {_BUF} AND o.top + {_BUF} QUALIFY row_number() OVER (PARTITION BY n.symbol, d.direction ORDER BY strength DESC, o.ix DESC) = 1),
mfv AS (SELECT n.symbol, d.direction, g.top, g.bottom, g.ix FROM now n CROSS JOIN dirs d JOIN fvg g ON g.symbol = n.symbol AND g.kind = d.want
  AND NOT g.filled AND n.close BETWEEN g.bottom - {_BUF} AND g.top + {_BUF} QUALIFY row_number() OVER (PARTITION BY n.symbol, d.direction ORDER BY g.ix DESC) = 1)"""


@query("ez_match_zone", f"""WITH {_MIXED}, {sql.atr_sma()}, {_NOW}, {_OB}, {_FVG}, {_MATCH}
SELECT n.symbol, d.direction, {sql.fx('o.top')} AS ob_top, {sql.fx('o.strength')} AS ob_strength, {sql.fx('g.top')} AS fvg_top, {sql.fx('g.bottom')} AS fvg_bottom
FROM now n CROSS JOIN dirs d LEFT JOIN mob o ON o.symbol = n.symbol AND o.direction = d.direction LEFT JOIN mfv g ON g.symbol = n.symbol AND g.direction = d.direction""")
def ez_match_zone(spark: SparkSession, sf: str) -> DataFrame:
    bars = mixed_atr(spark, sf)
    last = structure.last_bars(bars, "ts", "ix", "close", "atr")
    out = zones.match_zones(zones.both_directions(last), zones.order_blocks(bars), zones.fair_value_gaps(bars, last))
    return present(out.select(
        "symbol", "direction", F.col("ob.top").alias("ob_top"), F.col("ob.strength").alias("ob_strength"),
        F.col("fvg.top").alias("fvg_top"), F.col("fvg.bottom").alias("fvg_bottom"),
    ))


def _confirm(side: int) -> str:
    lo, lc, w = f"lag(open) OVER ({sql.W})", f"lag(close) OVER ({sql.W})", ""
    wick = "least(close, open) - low" if side > 0 else "high - greatest(close, open)"
    core = f"close > open AND open < {lc} AND close > {lo}" if side > 0 else f"close < open AND open > {lc} AND close < {lo}"
    return f"""CASE WHEN ix < 2 THEN 'none' WHEN {core} AND abs(close - open) > abs({lc} - {lo}) THEN 'engulfing'
  WHEN abs(close - open) > 0 AND {wick} >= abs(close - open)*2 THEN 'rejection' ELSE 'none' END{w}"""


@query("pat_candle_confirm", f"WITH {sql.event_bars('1h')} SELECT symbol, {sql.tx('ts')} AS ts, {_confirm(1)} AS confirm_buy, {_confirm(-1)} AS confirm_sell FROM bars")
def pat_candle_confirm(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"confirm_buy": confirmation(w, 1), "confirm_sell": confirmation(w, -1)})
    return present(in_frames(tables.indexed(spark, sf), build, before=2), "symbol", "ts", "confirm_buy", "confirm_sell")


_ENTRY = f"""lb AS (SELECT * FROM bars QUALIFY ix = max(ix) OVER (PARTITION BY symbol)), {SWINGS}, {BROKEN}, {as_of(at='lb')},
cc AS (SELECT symbol, ix, {_confirm(1)} AS cb, {_confirm(-1)} AS cs FROM bars),
fh AS ({_FIB_HIT}),
su AS (SELECT n.symbol, d.direction, d.want, CASE d.direction WHEN 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, n.close AS px, n.atr, p.trend, p.price_zone, p.bos_direction, p.choch_direction,
  o.top AS ot, o.bottom AS obt, o.strength, g.top AS gt, g.bottom AS gb, f.fib_confluence, CASE d.direction WHEN 'buy' THEN c.cb ELSE c.cs END AS conf
  FROM now n CROSS JOIN dirs d JOIN pit p ON p.symbol = n.symbol JOIN cc c ON c.symbol = n.symbol AND c.ix = n.ix JOIN fh f ON f.symbol = n.symbol
  LEFT JOIN mob o ON o.symbol = n.symbol AND o.direction = d.direction LEFT JOIN mfv g ON g.symbol = n.symbol AND g.direction = d.direction),
s1 AS (SELECT *, ot IS NULL AND gt IS NULL AS bare, CASE WHEN ot IS NOT NULL THEN CASE WHEN sg > 0 THEN obt - atr*0.3 ELSE ot + atr*0.3 END ELSE px - sg*atr*1.5 END AS sl FROM su
  WHERE NOT (direction = 'buy' AND price_zone = 'premium') AND NOT (direction = 'sell' AND price_zone = 'discount')
    AND NOT (ot IS NULL AND gt IS NULL AND price_zone = 'equilibrium')),
s2 AS (SELECT *, sg*(px - sl) AS risk FROM s1 WHERE sg*(px - sl) > 0),
en AS (SELECT *, {sql.fx('px', 5)} AS entry, {sql.fx('sl', 5)} AS stop_loss, {sql.fx('px + sg*risk*1.5', 5)} AS tp1, {sql.fx('px + sg*risk*2.5', 5)} AS tp2, {sql.fx('px + sg*risk*3.5', 5)} AS tp3,
  concat_ws(', ', CASE WHEN ot IS NOT NULL THEN CASE direction WHEN 'buy' THEN 'Buy' ELSE 'Sell' END || printf(' OB (strength %.2f×)', strength) END,
    CASE WHEN gt IS NOT NULL THEN CASE want WHEN 'bullish' THEN 'Bullish' ELSE 'Bearish' END || printf(' FVG at %.2f–%.2f', gb, gt) END,
    CASE WHEN bare THEN 'ATR-based entry (' || price_zone || ' zone)' END, CASE WHEN fib_confluence THEN 'Fib confluence' END,
    CASE conf WHEN 'engulfing' THEN 'Engulfing candle confirm' WHEN 'rejection' THEN 'Rejection candle confirm' END,
    CASE WHEN bos_direction = want THEN 'BOS confirmed' END, CASE WHEN choch_direction = want THEN 'CHoCH confirmed' END) AS reason FROM s2)"""
_ENTRY_COLS = ("entry", "stop_loss", "tp1", "tp2", "tp3")


@query("ez_build_entry", f"""WITH {_MIXED}, {sql.atr_sma()}, {_NOW}, {_OB}, {_FVG}, {_MATCH}, {_ENTRY}
SELECT symbol, direction, {', '.join(sql.fx(c, 5) + ' AS ' + c for c in _ENTRY_COLS)}, CAST(bare AS INTEGER) AS atr_fallback, conf AS confirmation, reason FROM en""")
def ez_build_entry(spark: SparkSession, sf: str) -> DataFrame:
    out = live.entry_setups(cut(mixed_atr(spark, sf)))
    return present(out, "symbol", "direction", *_ENTRY_COLS, "atr_fallback", "confirmation", "reason", digits=5)


# --- scoring ---------------------------------------------------------------------------------

_LIVE = sql.core(name="lc0", spans=(21, 50, 200)) + f""", lc AS (SELECT * EXCLUDE (ema_21, ema_50, ema_200), ema_21 AS ema_fast, ema_50 AS ema_slow, ema_200 AS ema_trend,
  volume/nullif({sql.roll('avg(volume)', 20)}, 0) AS rvol FROM lc0)"""
_P9 = f"OVER ({sql.W} ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)"
_ASSESS = f"""dv AS (SELECT *, coalesce(ix >= 9 AND close < min(close) {_P9} AND rsi > min(rsi) {_P9}, FALSE) AS div_buy,
  coalesce(ix >= 9 AND close > max(close) {_P9} AND rsi < max(rsi) {_P9}, FALSE) AS div_sell FROM lc),
sides(direction, want) AS (VALUES ('buy', 'bullish'), ('sell', 'bearish')),
asx AS (SELECT v.*, s.direction, s.want, CASE s.direction WHEN 'buy' THEN CASE WHEN rsi BETWEEN 40 AND 65 THEN 'bullish' WHEN rsi < 70 THEN 'neutral' ELSE 'bearish' END
    ELSE CASE WHEN rsi BETWEEN 35 AND 60 THEN 'bearish' WHEN rsi > 30 THEN 'neutral' ELSE 'bullish' END END AS rsi_signal,
  CASE s.direction WHEN 'buy' THEN div_buy ELSE div_sell END AS rsi_divergence,
  CASE WHEN ema_fast > ema_slow AND close > ema_trend THEN 'bullish' WHEN ema_fast < ema_slow AND close < ema_trend THEN 'bearish' ELSE 'mixed' END AS ema_bias,
  close > ema_trend AS above_trend_ema, coalesce(rvol >= 1.2, FALSE) AS volume_elevated FROM dv v CROSS JOIN sides s)"""
_ASSESS_OUT = ("rsi_signal", "?rsi_divergence", "ema_bias", "?above_trend_ema", "?volume_elevated")


def assessed(bars: DataFrame) -> DataFrame:
    """Live columns and indicator labels at every bar for both directions."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_volume(ind.add_core(df, w, (21, 50, 200)), w)
        return scoring.add_rsi_divergence(df, w)
    out = in_frames(bars, build, before=ind.core_margin((21, 50, 200)) + 32)
    out = out.withColumnsRenamed({"ema_21": "ema_fast", "ema_50": "ema_slow", "ema_200": "ema_trend"})
    return scoring.assess_indicators(zones.both_directions(out))


@query("sc_indicator_assess", f"""WITH {sql.event_bars('1h')}, {_LIVE}, {_ASSESS}
SELECT symbol, {sql.tx('ts')} AS ts, direction, {sql.out(*_ASSESS_OUT)}, {sql.fx(sql.fx('ema_fast', 5), 3)} AS d_ema_fast, {sql.fx('coalesce(rvol, 1)', 2)} AS d_rvol FROM asx""")
def sc_indicator_assess(spark: SparkSession, sf: str) -> DataFrame:
    out = assessed(tables.indexed(spark, sf))
    out = out.withColumns({"d_ema_fast": F.col("details")["ema_fast"], "d_rvol": F.col("details")["rvol"]})
    return present(out, "symbol", "ts", "direction", *[c.lstrip("?") for c in _ASSESS_OUT], "d_ema_fast", "d_rvol", digits=3)


_POINTS = f"""sc0 AS (SELECT a.symbol, a.ts, a.ix, a.direction, {sql.session('a.ts')} AS session, p.trend, p.price_zone,
  least(CASE WHEN p.trend = a.want THEN 2 ELSE 0 END + CASE WHEN p.bos_direction = a.want THEN 2 ELSE 0 END + CASE WHEN p.choch_direction = a.want THEN 1 ELSE 0 END
    + CASE WHEN p.price_zone = CASE a.direction WHEN 'buy' THEN 'discount' ELSE 'premium' END THEN 1 ELSE 0 END, 5) AS ms,
  least(CASE WHEN oz.strength IS NULL THEN 0 WHEN oz.strength >= 2 THEN 2 ELSE 1 END + CASE WHEN gz.ix IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN f.fib_confluence THEN 1 ELSE 0 END
    + CASE WHEN CASE a.direction WHEN 'buy' THEN c.cb ELSE c.cs END <> 'none' THEN 1 ELSE 0 END, 4) AS ez,
  least(CASE WHEN rsi_signal = want THEN 1 ELSE 0 END + CASE WHEN rsi_divergence THEN 1 ELSE 0 END + CASE WHEN ema_bias = want THEN 1 ELSE 0 END
    + CASE WHEN volume_elevated THEN 1 ELSE 0 END, 3) AS ip
  FROM asx a JOIN pit p ON p.symbol = a.symbol AND p.ix = a.ix JOIN f ON f.symbol = a.symbol AND f.ix = a.ix JOIN cc c ON c.symbol = a.symbol AND c.ix = a.ix
  LEFT JOIN oz ON oz.symbol = a.symbol AND oz.tix = a.ix AND oz.direction = a.direction LEFT JOIN gz ON gz.symbol = a.symbol AND gz.tix = a.ix AND gz.direction = a.direction),
sc1 AS (SELECT *, CASE session WHEN 'overlap' THEN 3 WHEN 'london' THEN 2 WHEN 'new_york' THEN 2 WHEN 'asia' THEN 1 ELSE 0 END AS st FROM sc0),
sc AS (SELECT *, ms + ez + ip + st + 2 AS total FROM sc1)"""


@query("sc_score", f"""WITH {sql.event_bars('1h')}, {_LIVE}, {_ASSESS}, {_open_zones('lc')}, {_PIT}, f AS ({_FIB_HIT}), cc AS (SELECT symbol, ix, {_confirm(1)} AS cb, {_confirm(-1)} AS cs FROM bars), {_POINTS}
SELECT symbol, {sql.tx('ts')} AS ts, direction, ms AS pts_market_structure, ez AS pts_entry_zone, ip AS pts_indicators, st AS pts_session_timing, total,
  {sql.fx('total/20*100', 1)} AS confidence_pct, CAST(total >= 11 AND total/20*100 >= 55 AS INTEGER) AS passed,
  CASE WHEN total >= 11 THEN '' ELSE 'Score ' || total || '/20 below threshold (11)' END AS reject_reason FROM sc""")
def sc_score(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar and direction scored from structure, open zones, retracements, candles and indicators known by then."""
    out = live.scored_history(tables.indexed(spark, sf), assessed)
    return present(
        out, "symbol", "ts", "direction", "pts_market_structure", "pts_entry_zone", "pts_indicators", "pts_session_timing",
        "total", "confidence_pct", "passed", "reject_reason", digits=1,
    )


_PTS = {s: {n: f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for n, c, p in (
    ("trend", f"trend_{s}", 2), ("bos", f"bos_{s}", 2), ("choch", f"choch_{s}", 1), ("entry", f"entry_{s}", 2), ("eng", f"{s}_engulf", 1),
    ("ema", "ema_21 > ema_50" if s == "bull" else "ema_21 < ema_50", 1))} for s in ("bull", "bear")}


def _composite(s: str) -> str:
    p = _PTS[s]
    sess = f"CASE {sql.session()} WHEN 'overlap' THEN 3 WHEN 'london' THEN 2 WHEN 'new_york' THEN 2 WHEN 'asia' THEN 1 ELSE 0 END"
    return (f"least({p['trend']} + {p['bos']} + {p['choch']}, 5) + least({p['entry']} + {p['eng']}, 4) + "
            f"least({p['ema']} + CASE WHEN rvol > 1.5 THEN 1 ELSE 0 END, 3) + {sess} + 2")


COMPOSITE = f"cp AS (SELECT *, {_composite('bull')} AS total_buy, {_composite('bear')} AS total_sell FROM vec)"


def composite(bars: DataFrame) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return structure.add_vector_flags(ind.add_research(df, w), w)
    out = in_frames(bars, build, before=ind.core_margin() + 32, after=9)
    return scoring.add_composite(out.withColumn("session", cal.session_of(F.col("ts"))))


@query("sc_composite_vector", f"WITH {sql.event_bars('1h')}, {sql.research()}, {VECTOR}, {COMPOSITE} SELECT symbol, {sql.tx('ts')} AS ts, total_buy, total_sell FROM cp")
def sc_composite_vector(spark: SparkSession, sf: str) -> DataFrame:
    return present(composite(tables.indexed(spark, sf)), "symbol", "ts", "total_buy", "total_sell")


@query("sc_trend_prefilter", f"""WITH {sql.event_bars('1h')}, {_PIT}, d(direction) AS (VALUES ('buy'), ('sell'))
SELECT symbol, {sql.tx('ts')} AS ts, direction, trend, choch_direction FROM pit CROSS JOIN d
WHERE NOT ((direction = 'buy' AND trend = 'bearish' AND coalesce(choch_direction, '') <> 'bullish')
  OR (direction = 'sell' AND trend = 'bullish' AND coalesce(choch_direction, '') <> 'bearish'))""")
def sc_trend_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    out = zones.both_directions(structure.point_in_time(cut(tables.indexed(spark, sf))))
    out = out.filter(rules.trend_prefilter(F.col("direction"), F.col("trend"), F.col("choch_direction")))
    return present(out, "symbol", "ts", "direction", "trend", "choch_direction")


# --- regimes and routing ---------------------------------------------------------------------

_REGIME = f"""rg0 AS (SELECT *, CASE WHEN ix > 0 THEN {sql.TR} END AS tr FROM bars),
rg1 AS (SELECT *, avg(tr) OVER ({sql.W} ROWS 13 PRECEDING) AS a14, avg(tr) OVER ({sql.W} ROWS 49 PRECEDING) AS a50, lag(close, 19) OVER ({sql.W}) AS old FROM rg0),
rg AS (SELECT symbol, tf, ts, ix, close, CASE WHEN a14 IS NULL THEN 'UNKNOWN' WHEN a14 > a50*1.5 THEN 'VOLATILE' WHEN a14 < a50*0.7 THEN 'QUIET'
  WHEN coalesce(abs((close - old)/nullif(old, 0))*100, 0) > 3 THEN 'TRENDING' ELSE 'RANGING' END AS regime FROM rg1)"""


@query("rg_live", f"WITH {sql.event_bars('1h')}, {_REGIME} SELECT symbol, {sql.tx('ts')} AS ts, regime FROM rg")
def rg_live(spark: SparkSession, sf: str) -> DataFrame:
    return present(in_frames(tables.indexed(spark, sf), regime.add_live_regime, before=50), "symbol", "ts", "regime")


RESEARCH_REGIME = f"""rr0 AS (SELECT a.*, lag(close, 20) OVER ({sql.W}) AS old FROM atrs a),
rr1 AS (SELECT a.symbol, a.ix, count(b.atr) AS n, count(CASE WHEN b.atr < a.atr THEN 1 END) AS below FROM atrs a
  JOIN atrs b ON b.symbol = a.symbol AND b.ix BETWEEN a.ix - 60 AND a.ix - 1 GROUP BY a.symbol, a.ix),
rr2 AS (SELECT r.*, coalesce(CASE WHEN n > 10 AND atr IS NOT NULL THEN below/n END, 0.5) AS rk,
  coalesce(CASE WHEN atr > 0 THEN abs((close - old)/nullif(old, 0))/nullif(atr/nullif(close, 0), 0) END, 0) AS strength
  FROM rr0 r LEFT JOIN rr1 k ON k.symbol = r.symbol AND k.ix = r.ix),
reg AS (SELECT symbol, tf, ts, ix, open, high, low, close, atr, CASE WHEN ix < 60 THEN 'UNCLASSIFIED' WHEN rk > 0.75 THEN 'HIGH_VOL' WHEN rk < 0.25 THEN 'LOW_VOL'
  WHEN strength > 1.5 THEN 'TRENDING' WHEN strength < 0.5 THEN 'RANGING' ELSE 'MIXED' END AS regime FROM rr2)"""


@query("rg_research", f"WITH {sql.daily_bars()}, {sql.atr_sma()}, {RESEARCH_REGIME} SELECT symbol, {sql.tx('ts')} AS ts, regime FROM reg")
def rg_research(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return regime.add_research_regime(ind.add_atr_sma(df, w), w)
    return present(in_frames(tables.indexed_daily(spark, sf), build, before=80), "symbol", "ts", "regime")


@query("rg_adx_like", f"""WITH {sql.event_bars('1h')}, {sql.atr_sma()},
s AS (SELECT *, coalesce(abs(close - lag(close, 20) OVER ({sql.W}))/nullif(atr, 0), 0) AS strength FROM atrs)
SELECT symbol, {sql.tx('ts')} AS ts, CASE WHEN ix < 49 THEN 'unknown' WHEN strength > 1.5 THEN 'trending' WHEN strength < 0.5 THEN 'ranging' ELSE 'transitioning' END AS regime FROM s""")
def rg_adx_like(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return regime.add_adx_like(ind.add_atr_sma(df, w), w)
    return present(in_frames(tables.indexed(spark, sf), build, before=21), "symbol", "ts", "regime")


@query("sc_route", f"""WITH {sql.event_bars('1h')}, {_FB_LIVE}, {_REGIME},
best AS (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY symbol, ix ORDER BY confidence DESC, direction DESC) = 1),
bo AS (SELECT symbol, ix, ts, close, CASE WHEN close < {sql.prev_extreme('min(low)', 20)} THEN 'sell' WHEN close > {sql.prev_extreme('max(high)', 20)} THEN 'buy' END AS direction FROM bars),
smc AS (SELECT symbol, ix, ts, direction, close AS entry, 50.0 + ix % 25 AS confidence, 'breakout' AS strategy FROM bo WHERE direction IS NOT NULL),
j AS (SELECT coalesce(s.symbol, f.symbol) AS symbol, coalesce(s.ix, f.ix) AS ix, s.direction AS sd, s.entry AS se, s.confidence AS scf, f.direction AS fd, f.entry AS fe, f.confidence AS fcf
  FROM smc s FULL JOIN best f ON f.symbol = s.symbol AND f.ix = s.ix),
k AS (SELECT j.*, rg.regime, CASE WHEN fd IS NULL THEN TRUE WHEN sd IS NULL THEN FALSE WHEN regime IN ('VOLATILE', 'TRENDING') THEN TRUE
  WHEN regime IN ('RANGING', 'QUIET') THEN FALSE ELSE scf >= fcf END AS s FROM j JOIN rg ON rg.symbol = j.symbol AND rg.ix = j.ix)
SELECT symbol, ix, regime, CASE WHEN s THEN 'breakout' ELSE 'false_breakout' END AS strategy, CASE WHEN s THEN sd ELSE fd END AS direction,
  {sql.fx('CASE WHEN s THEN se ELSE fe END')} AS entry, {sql.fx('CASE WHEN s THEN scf ELSE fcf END')} AS confidence FROM k""")
def sc_route(spark: SparkSession, sf: str) -> DataFrame:
    """Breakouts stand for structure signals; every bar with at least one signal is routed."""
    bars = tables.indexed(spark, sf)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("_s", signals.breakout(20)(w))

    smc = in_frames(bars, build, before=20).filter(F.col("_s") != 0).select(
        *KEYS, "ix", F.when(F.col("_s") > 0, "buy").otherwise("sell").alias("direction"), F.col("close").alias("entry"),
        (F.lit(50.0) + F.col("ix") % 25).alias("confidence"), F.lit("breakout").alias("strategy"),
    )
    fb = signals.pick_best(fb_setups(spark, sf)).select(*KEYS, "ix", "direction", "entry", "confidence", F.lit("false_breakout").alias("strategy"))
    regimes = in_frames(bars, regime.add_live_regime, before=50)
    out = scoring.route(smc, fb, regimes, (*KEYS, "ix"))
    return present(out, "symbol", "ix", "regime", "strategy", "direction", "entry", "confidence")


_TEXT = "CASE WHEN c % 100 % 10 = 0 THEN floor(c/100)::BIGINT || '.' || floor(c % 100/10)::BIGINT ELSE floor(c/100)::BIGINT || '.' || lpad((c % 100)::VARCHAR, 2, '0') END"


@query("sc_dedupe_id", f"""WITH {sql.event_bars('1h')}, {sql.false_breakout()},
s AS (SELECT symbol, ts, CASE signal WHEN 1 THEN 'buy' ELSE 'sell' END AS direction, floor(close/10)*10 AS entry FROM sig WHERE signal <> 0
  UNION ALL SELECT symbol, ts + INTERVAL 10 MINUTE, CASE signal WHEN 1 THEN 'buy' ELSE 'sell' END, floor(close/10)*10 + 0.001 FROM sig WHERE signal <> 0),
t AS (SELECT *, floor(entry*100 + 0.5)::BIGINT AS c FROM s),
i AS (SELECT *, substr(md5(symbol || ':' || direction || ':' || {_TEXT} || ':' || strftime(ts, '%Y%m%d%H')), 1, 12) AS sig_id FROM t)
SELECT sig_id, symbol, {sql.tx('ts')} AS ts, direction FROM i QUALIFY row_number() OVER (PARTITION BY sig_id ORDER BY ts, symbol) = 1""")
def sc_dedupe_id(spark: SparkSession, sf: str) -> DataFrame:
    """Signals fired twice within the hour at almost the same price keep the first."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("signal", signals.false_breakout()(w))

    fired = in_frames(tables.indexed(spark, sf), build, before=10, after=2).filter(F.col("signal") != 0)
    base = fired.select(
        "symbol", "ts", F.when(F.col("signal") > 0, "buy").otherwise("sell").alias("direction"), (F.floor(F.col("close") / 10) * 10.0).alias("entry"),
    )
    again = base.withColumns({"ts": F.col("ts") + F.expr("interval 10 minutes"), "entry": F.col("entry") + 0.001})
    return present(rules.dedupe(base.unionByName(again)), "sig_id", "symbol", "ts", "direction")


_SESSION_POINTS = f"CASE {sql.session('a.ts')} WHEN 'overlap' THEN 3 WHEN 'london' THEN 2 WHEN 'new_york' THEN 2 WHEN 'asia' THEN 1 ELSE 0 END"
_ALLOWED = f"{sql.session('a.ts')} IN ('london', 'new_york', 'overlap')"
_SCAN = f"""{_MIXED}, {_LIVE}, atrs AS (SELECT * FROM lc), {_NOW}, {_OB}, {_FVG}, {_MATCH}, {_ENTRY}, {_ASSESS}, {_REGIME}, {_FB_LIVE.replace(sql.atr_sma() + ', ', '')},
sm0 AS (SELECT e.*, least(CASE WHEN trend = e.want THEN 2 ELSE 0 END + CASE WHEN bos_direction = e.want THEN 2 ELSE 0 END + CASE WHEN choch_direction = e.want THEN 1 ELSE 0 END
    + CASE WHEN price_zone = CASE e.direction WHEN 'buy' THEN 'discount' ELSE 'premium' END THEN 1 ELSE 0 END, 5)
  + least(CASE WHEN strength IS NULL THEN 0 WHEN strength >= 2 THEN 2 ELSE 1 END + CASE WHEN gt IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN fib_confluence THEN 1 ELSE 0 END
    + CASE WHEN conf <> 'none' THEN 1 ELSE 0 END, 4)
  + least(CASE WHEN rsi_signal = e.want THEN 1 ELSE 0 END + CASE WHEN rsi_divergence THEN 1 ELSE 0 END + CASE WHEN ema_bias = e.want THEN 1 ELSE 0 END + CASE WHEN volume_elevated THEN 1 ELSE 0 END, 3)
  + {_SESSION_POINTS} AS total
  FROM en e JOIN now n ON n.symbol = e.symbol JOIN asx a ON a.symbol = e.symbol AND a.direction = e.direction AND a.ix = n.ix
  WHERE {_ALLOWED} AND n.ix >= 49 AND NOT (e.direction = 'buy' AND trend = 'bearish' AND coalesce(choch_direction, '') <> 'bullish')
    AND NOT (e.direction = 'sell' AND trend = 'bullish' AND coalesce(choch_direction, '') <> 'bearish')),
sm AS (SELECT symbol, direction, entry, stop_loss, tp1, tp2, tp3, {sql.fx('total/20*100', 1)} AS confidence, total AS score, reason FROM sm0
  WHERE total >= 11 AND {sql.fx('abs(tp1 - entry)/nullif(abs(entry - stop_loss), 0)', 2)} >= 1.5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, direction) = 1),
fs AS (SELECT f.symbol, f.direction, f.entry, f.stop_loss, f.tp1, f.tp2, f.tp3, f.confidence, 14 AS score, f.reason FROM fb f JOIN now a ON a.symbol = f.symbol AND a.ix = f.available_ix
  WHERE {_ALLOWED} AND a.ix >= 49 QUALIFY row_number() OVER (PARTITION BY f.symbol ORDER BY f.confidence DESC, f.direction DESC) = 1),
fv AS (SELECT * FROM fs WHERE {sql.fx('abs(tp1 - entry)/nullif(abs(entry - stop_loss), 0)', 2)} >= 1.5 AND confidence >= 50),
rl AS (SELECT r.symbol, r.regime FROM rg r JOIN now n ON n.symbol = r.symbol AND n.ix = r.ix),
rt AS (SELECT rl.symbol, rl.regime, sm.symbol IS NOT NULL AND (fv.symbol IS NULL OR regime IN ('VOLATILE', 'TRENDING') OR (regime NOT IN ('RANGING', 'QUIET') AND sm.confidence >= fv.confidence)) AS s
  FROM rl LEFT JOIN sm ON sm.symbol = rl.symbol LEFT JOIN fv ON fv.symbol = rl.symbol WHERE sm.symbol IS NOT NULL OR fv.symbol IS NOT NULL),
ch AS (SELECT rt.regime, 'smc_8gate' AS strategy, sm.* FROM rt JOIN sm ON sm.symbol = rt.symbol WHERE rt.s UNION ALL SELECT rt.regime, 'false_breakout', fv.* FROM rt JOIN fv ON fv.symbol = rt.symbol WHERE NOT rt.s)"""


@query("live_scan", f"""WITH {_SCAN} SELECT symbol, regime, strategy, direction, {', '.join(sql.fx(c, 5) + ' AS ' + c for c in (*_ENTRY_COLS, 'confidence'))}, score, reason FROM ch""")
def live_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The whole scan: structure setups and false breakouts at the last bar of every series, scored and routed."""
    out = live.scan(mixed(spark, sf))
    return present(out, "symbol", "regime", "strategy", "direction", "entry", "stop_loss", "tp1", "tp2", "tp3", "confidence", "score", "reason", digits=5)


