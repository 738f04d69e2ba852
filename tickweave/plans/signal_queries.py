"""Queries on the calendar, reference data and signal generators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.functions.numbers import format_price
from tickweave.operators import indicators as ind
from tickweave.operators import risk, rules, signals
from tickweave.operators.frames import in_frames
from tickweave.plans import sql
from tickweave.plans.catalogue import present, query
from tickweave.sources import dims, tables

# --- calendar --------------------------------------------------------------------------------


@query("cal_session", f"SELECT {sql.session()} AS session, event_type AS symbol, count(*) AS n, {sql.fx('avg(value)')} AS avg_price FROM events GROUP BY ALL")
def cal_session(spark: SparkSession, sf: str) -> DataFrame:
    ticks = tables.ticks(spark, sf).withColumn("session", cal.session_of(F.col("ts")))
    return present(ticks.groupBy("session", "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("avg_price")))


@query("cal_session_allowed", f"""WITH {sql.event_bars('1h')} SELECT symbol, {sql.tx('ts')} AS ts, {sql.session()} AS session FROM bars
WHERE isodow(ts) < 6 AND {sql.session()} IN ('london', 'new_york', 'overlap')""")
def cal_session_allowed(spark: SparkSession, sf: str) -> DataFrame:
    bars = tables.event_bars(spark, sf).filter(cal.session_allowed(F.col("ts")))
    return present(bars.withColumn("session", cal.session_of(F.col("ts"))), "symbol", "ts", "session")


@query("cal_day_filter", f"""WITH {sql.daily_bars()}, {sql.pairs()},
k AS (SELECT * FROM pairs WHERE symbol <> 'R'), d AS (SELECT * FROM pairs WHERE symbol = 'error')
SELECT b.symbol, {sql.tx('b.ts')} AS ts, dayname(b.ts) AS day_name,
  CASE WHEN list_contains(coalesce(k.avoid_days, d.avoid_days), dayname(b.ts)) THEN 'avoid'
       WHEN list_contains(coalesce(k.best_days, d.best_days), dayname(b.ts)) THEN 'best' ELSE 'neutral' END AS day_filter
FROM bars b CROSS JOIN d LEFT JOIN k ON k.symbol = b.symbol""")
def cal_day_filter(spark: SparkSession, sf: str) -> DataFrame:
    # Symbol R is left out of the dimension, so it falls back to the default row.
    known = tables.stand_in_pairs(spark).filter(F.col("symbol") != "R")
    return present(rules.with_day_filter(tables.daily_bars(spark, sf), known), "symbol", "ts", "day_name", "day_filter")


_NEWS = """news AS (SELECT 'event ' || event_id AS title, CASE WHEN value > 150 THEN 'high' ELSE 'low' END AS impact,
  ['USD','EUR','GBP','JPY','XAU'][event_id % 5 + 1] AS currency, date_trunc('minute', ts) AS nts FROM events WHERE event_type = 'error')"""


@query("cal_news_blackout", f"""WITH {sql.event_bars('1h')}, {sql.pairs()}, {_NEWS},
m AS (SELECT b.symbol, b.ts, n.nts, n.title, date_diff('second', b.ts, n.nts)/60.0 AS ahead FROM bars b
  JOIN pairs p ON p.symbol = b.symbol JOIN news n ON n.impact = 'high' AND list_contains(p.currencies, n.currency)),
h AS (SELECT * FROM m WHERE (ahead > 0 AND ahead <= 30) OR (ahead < 0 AND -ahead <= 15)),
f AS (SELECT symbol, ts, arg_min(title, (nts, title)) AS title, arg_min(ahead, (nts, title)) AS ahead FROM h GROUP BY symbol, ts)
SELECT b.symbol, {sql.tx('b.ts')} AS ts, CASE WHEN f.title IS NULL THEN 0 ELSE 1 END AS blocked,
  CASE WHEN ahead > 0 THEN 'High-impact news in ' || CAST(trunc(ahead) AS INTEGER) || 'm: ' || title
       WHEN ahead < 0 THEN 'Post-news blackout (' || CAST(trunc(-ahead) AS INTEGER) || 'm ago): ' || title ELSE '' END AS reason
FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.ts = b.ts""")
def cal_news_blackout(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.news_blackout(tables.event_bars(spark, sf), tables.news(spark, sf), tables.stand_in_pairs(spark))
    return present(out, "symbol", "ts", "blocked", "reason")


@query("cal_trade_limits", f"""WITH {sql.event_bars('1h')}, {sql.false_breakout()},
s AS (SELECT symbol, ts, signal, CAST(ts AS DATE) AS day, {sql.session()} AS session FROM sig WHERE signal <> 0),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY day, session ORDER BY ts, symbol) <= 3),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY day ORDER BY ts, symbol) <= 5)
SELECT symbol, {sql.tx('ts')} AS ts, session, signal FROM b""")
def cal_trade_limits(spark: SparkSession, sf: str) -> DataFrame:
    fired = _signals(spark, sf, signals.false_breakout(), 10, 2).withColumn("session", cal.session_of(F.col("ts")))
    return present(rules.trade_limits(fired), "symbol", "ts", "session", "signal")


# --- risk and prices -------------------------------------------------------------------------



def _lots(balance: str = "10000.0", pct: str = "1.0") -> str:
    per = "CASE WHEN entry > 100 THEN abs(entry - stop_loss)*100 ELSE abs(entry - stop_loss)*10000*10 END"
    lots = f"{balance}*({pct}/100)/nullif({per}, 0)"
    return f"CASE WHEN abs(entry - stop_loss) = 0 THEN 0 ELSE {sql.fx(f'greatest(0.01, least({lots}, 100.0))', 2)} END"


_SETUPS = f"""WITH {sql.event_bars('1h')}, {sql.atr_sma()},
s AS (SELECT symbol, ts, close AS entry, close - 1.5*atr AS stop_loss, close + (1 + ix % 3)*0.75*atr AS tp1,
  close + 2.5*atr AS tp2, close + 3.5*atr AS tp3 FROM atrs WHERE atr IS NOT NULL)"""


def _setups(spark: SparkSession, sf: str) -> DataFrame:
    bars = in_frames(tables.indexed(spark, sf), ind.add_atr_sma, before=15).filter(F.col("atr").isNotNull())
    c, a = F.col("close"), F.col("atr")
    return bars.select(
        "symbol", "ts", c.alias("entry"), (c - 1.5 * a).alias("stop_loss"), (c + (1 + F.col("ix") % 3) * 0.75 * a).alias("tp1"),
        (c + 2.5 * a).alias("tp2"), (c + 3.5 * a).alias("tp3"),
    )


@query("rk_position_size", f"{_SETUPS} SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx(_lots())} AS lots FROM s")
def rk_position_size(spark: SparkSession, sf: str) -> DataFrame:
    lots = risk.position_size(F.lit(10000.0), F.lit(1.0), F.col("entry"), F.col("stop_loss"))
    return present(_setups(spark, sf).withColumn("lots", lots), "symbol", "ts", "lots")


_RR = {k: sql.fx(f"abs(tp{k} - entry)/nullif(abs(entry - stop_loss), 0)", 2) for k in (1, 2, 3)}


@query("rk_profile", f"""{_SETUPS}, r AS (SELECT *, coalesce({_RR[1]}, 0) AS rr_tp1, coalesce({_RR[2]}, 0) AS rr_tp2, coalesce({_RR[3]}, 0) AS rr_tp3 FROM s),
v AS (SELECT *, abs(entry - stop_loss) <> 0 AND rr_tp1 >= 1.5 AS valid FROM r)
SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx('rr_tp1')} AS rr_tp1, {sql.fx('rr_tp2')} AS rr_tp2, {sql.fx('rr_tp3')} AS rr_tp3, CAST(valid AS INTEGER) AS valid,
  {sql.fx(f'CASE WHEN valid THEN {_lots()} ELSE 0 END')} AS position_size, CASE WHEN valid THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS risk_amount FROM v""")
def rk_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.risk_profile(_setups(spark, sf), F.lit(10000.0), F.lit(1.0))
    return present(out, "symbol", "ts", "rr_tp1", "rr_tp2", "rr_tp3", "valid", "position_size", "risk_amount")


@query("rk_costs", f"""WITH {sql.event_bars('1d')}, {sql.pairs()}
SELECT b.symbol, {sql.tx('b.ts')} AS ts, {sql.fx(sql.COST_PIPS)} AS cost_pips,
  {sql.fx('coalesce(p.spread_px, 0.0001) + coalesce(p.slippage_px, 0.00005)')} AS cost_px
FROM bars b LEFT JOIN pairs p ON p.symbol = b.symbol AND p.symbol <> 'view'""")
def rk_costs(spark: SparkSession, sf: str) -> DataFrame:
    known = tables.stand_in_pairs(spark).filter(F.col("symbol") != "view")
    return present(risk.with_costs(tables.event_bars(spark, sf, "1d"), known), "symbol", "ts", "cost_pips", "cost_px")


_LISTED = sql.values([(s, p) for s, p in dims.STAND_IN.items()], "listed", "symbol, code")


@query("fmt_price", f"""WITH {sql.event_bars('4h')}, {_LISTED}
SELECT b.symbol, {sql.tx('ts')} AS ts, CASE WHEN code = 'XAUUSD' THEN format('{{:.2f}}', close)
  WHEN code IN ('USDJPY', 'GBPJPY') THEN format('{{:.3f}}', close) ELSE format('{{:.5f}}', close) END AS price_text
FROM bars b JOIN listed l ON l.symbol = b.symbol""")
def fmt_price(spark: SparkSession, sf: str) -> DataFrame:
    listed = dims.local_table(spark, list(dims.STAND_IN.items()), pa.schema([("symbol", pa.string()), ("code", pa.string())]))
    bars = dims.with_dimension(tables.event_bars(spark, sf, "4h"), listed, "symbol")
    return present(bars.withColumn("price_text", format_price(F.col("close"), F.col("code"))), "symbol", "ts", "price_text")


# --- signals ---------------------------------------------------------------------------------

def _signals(spark: SparkSession, sf: str, strategy, before: int, after: int = 0, prepare=None, tf: str = "1h") -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        if prepare is not None:
            df = prepare(df, w)
        return df.withColumn("signal", strategy(w))

    return in_frames(tables.indexed(spark, sf, tf), build, before, after).filter(F.col("signal") != 0)


def _rule(name: str, strategy, up: str, down: str, before: int, after: int = 0, prepare=None, ctes: str = "", src: str = "bars", up_first: bool = True) -> None:
    """Register a strategy whose SQL is one CASE over windows of ``src``."""
    pair = [(up, 1), (down, -1)] if up_first else [(down, -1), (up, 1)]
    case = " ".join(f"WHEN {c} THEN {v}" for c, v in pair)
    named = f"WITH {sql.event_bars('1h')}{', ' + ctes if ctes else ''}"

    @query(name, f"{named}, z AS (SELECT symbol, ts, CASE {case} ELSE 0 END AS signal FROM {src}) SELECT symbol, {sql.tx('ts')} AS ts, signal FROM z WHERE signal <> 0")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return present(_signals(spark, sf, strategy, before, after, prepare), "symbol", "ts", "signal")


def _lag(expr: str, k: int = 1) -> str:
    return f"lag({expr}, {k}) OVER ({sql.W})"


_RS = sql.research()
_CORE = sql.core(name="rs")
_MARGIN = ind.core_margin() + 32
_TOP, _BOTTOM = sql.prev_extreme("max(high)", 10), sql.prev_extreme("min(low)", 10)


def _edge(cond: str) -> str:
    held = f"coalesce({cond}, FALSE)"
    return f"{held} AND NOT coalesce(lag({held}) OVER ({sql.W}), FALSE)"


_rule("sig_false_breakout", signals.false_breakout(),
      f"low < {_BOTTOM} AND lead(close, 2) OVER ({sql.W}) > {_BOTTOM}", f"high > {_TOP} AND lead(close, 2) OVER ({sql.W}) < {_TOP}", 10, 2)
_rule("sig_ma_cross", signals.ma_cross(9, 21),
      f"{_lag('ema_9')} <= {_lag('ema_21')} AND ema_9 > ema_21", f"{_lag('ema_9')} >= {_lag('ema_21')} AND ema_9 < ema_21",
      _MARGIN, prepare=ind.add_core, ctes=_CORE, src="rs")
_rule("sig_rsi_extreme", signals.rsi_extreme(30, 70), "rsi < 30", "rsi > 70", _MARGIN, prepare=ind.add_core, ctes=_CORE, src="rs")
_PAST = f"OVER ({sql.W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_rule("sig_rsi_divergence", signals.rsi_divergence(),
      f"ix >= 20 AND close < min(close) {_PAST} AND rsi > min(rsi) {_PAST}", f"ix >= 20 AND close > max(close) {_PAST} AND rsi < max(rsi) {_PAST}",
      _MARGIN, prepare=ind.add_core, ctes=_CORE, src="rs")
_BB = f"""bb AS (SELECT *, {sql.roll('avg(close)', 20)} + 2*{sql.roll('stddev_samp(close)', 20)} AS bb_upper,
  {sql.roll('avg(close)', 20)} - 2*{sql.roll('stddev_samp(close)', 20)} AS bb_lower FROM bars)"""
_rule("sig_bollinger", signals.bollinger, "close <= bb_lower", "close >= bb_upper", 19, prepare=ind.add_bollinger, ctes=_BB, src="bb", up_first=False)
_rule("sig_breakout", signals.breakout(20), f"close > {sql.prev_extreme('max(high)', 20)}", f"close < {sql.prev_extreme('min(low)', 20)}", 20, up_first=False)
_VOL = f"vv AS (SELECT *, volume/nullif({sql.roll('avg(volume)', 20)}, 0) AS rvol, close/nullif(lag(close) OVER ({sql.W}), 0) - 1 AS ret FROM bars)"
_rule("sig_volume_spike", signals.volume_spike(1.5), "rvol >= 1.5 AND close > open", "rvol >= 1.5 AND close < open",
      19, prepare=ind.add_volume, ctes=_VOL, src="vv")
_rule("sig_session_entry", signals.session_entry(7, 12), "hour(ts) >= 7 AND hour(ts) < 12", "FALSE", 0)
_BULL, _BEAR = "ema_9 > ema_21 AND ema_21 > ema_50 AND close > ema_200", "ema_9 < ema_21 AND ema_21 < ema_50 AND close < ema_200"
_rule("sig_ema_align", signals.ema_align, _BULL, _BEAR, _MARGIN, prepare=ind.add_core, ctes=_CORE, src="rs")
_rule("sig_ema_align_change", signals.ema_align_change, _edge(_BULL), _edge(_BEAR), _MARGIN, prepare=ind.add_core, ctes=_CORE, src="rs")
_rule("sig_ema_rsi", signals.ema_rsi, _edge("close > ema_9 AND rsi > 50"), _edge("close < ema_9 AND rsi < 50"), _MARGIN, prepare=ind.add_core, ctes=_CORE, src="rs")


def _streak(cond: str) -> str:
    return f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER ({sql.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3"


# A narrow band, because three closes in a row beyond two deviations do not occur in the test tables.
_BB1 = _BB.replace("2*", "0.8*")
_rule("sig_bb_walk", signals.bb_walk(), _streak("close <= bb_lower"), _streak("close >= bb_upper"), 22,
      prepare=lambda df, w: ind.add_bollinger(df, w, width=0.8), ctes=_BB1, src="bb")
_QUIET = "rvol >= 2.0 AND abs(close - open)/nullif(high - low, 0) < 0.3"
_rule("sig_vol_disconnect", signals.volume_disconnect, f"{_QUIET} AND ret > 0", f"{_QUIET} AND ret < 0", 20, prepare=ind.add_volume, ctes=_VOL, src="vv")


def _fb_side(name: str, sign: int) -> str:
    level, gap, cond = (("bottom", "bottom - low", "low < bottom AND later > bottom") if sign > 0
                        else ("top", "high - top", "high > top AND later < top"))
    text = f"FB {name.capitalize()}: %s broke 10-bar swing {'low' if sign > 0 else 'high'} @ %.5f but closed back {'above' if sign > 0 else 'below'} (gap %.1fx ATR)"
    return f"""SELECT symbol, ts, ix, ix + 2 AS available_ix, '{name}' AS direction, entry, entry - {sign}*a AS stop_loss, entry + {sign}*a*1.5 AS tp1,
  entry + {sign}*a*2.5 AS tp2, entry + {sign}*a*3.5 AS tp3, least(50.0 + g*12.5, 75.0) AS confidence, g AS gap_atr_ratio, a AS atr_value,
  printf('{text}', symbol, {level}, g) AS reason FROM (SELECT *, CASE WHEN a > 0 THEN greatest(0.0, ({gap})/a) ELSE 0 END AS g FROM q WHERE {cond})"""


_FB_LIVE = f"""{sql.atr_sma()}, q0 AS (SELECT *, {_TOP} AS top, {_BOTTOM} AS bottom, lead(close, 2) OVER ({sql.W}) AS later, lead(open) OVER ({sql.W}) AS entry FROM atrs),
q AS (SELECT *, coalesce(atr, entry*0.005) AS a FROM q0), fb AS ({_fb_side('sell', -1)} UNION ALL {_fb_side('buy', 1)})"""
_FB_OUT = ("direction", "~entry", "~stop_loss", "~tp1", "~tp2", "~tp3", "~confidence", "~gap_atr_ratio", "~atr_value")
_FB_NAMES = [c.lstrip("~") for c in _FB_OUT]


def fb_setups(spark: SparkSession, sf: str, tf: str = "1h") -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return signals.add_false_breakout_setups(ind.add_atr_sma(df, w), w)
    return in_frames(tables.indexed(spark, sf, tf), build, before=15, after=2)


@query("sig_false_breakout_live", f"WITH {sql.event_bars('1h')}, {_FB_LIVE} SELECT symbol, {sql.tx('ts')} AS ts, available_ix, {sql.out(*_FB_OUT)} FROM fb")
def sig_false_breakout_live(spark: SparkSession, sf: str) -> DataFrame:
    return present(fb_setups(spark, sf), "symbol", "ts", "available_ix", *_FB_NAMES)


@query("sig_pick_best", f"""WITH {sql.event_bars('1h')}, {_FB_LIVE}
SELECT symbol, {sql.tx('ts')} AS ts, {sql.out(*_FB_OUT)} FROM fb
QUALIFY row_number() OVER (PARTITION BY symbol, ix ORDER BY confidence DESC, direction DESC) = 1""")
def sig_pick_best(spark: SparkSession, sf: str) -> DataFrame:
    return present(signals.pick_best(fb_setups(spark, sf)), "symbol", "ts", *_FB_NAMES)


@query("sig_monday_gap", f"""WITH {sql.daily_bars()}, {sql.atr_sma()},
u AS (SELECT *, last_value(CASE WHEN isodow(ts) = 5 THEN close END IGNORE NULLS) OVER ({sql.W}) AS friday_close,
  last_value(CASE WHEN isodow(ts) = 5 THEN ix END IGNORE NULLS) OVER ({sql.W}) AS friday_ix FROM atrs WHERE ix >= 20),
m AS (SELECT *, abs(open - friday_close)/atr AS gap_atr, abs(open - friday_close)/friday_close*100 AS gap_pct FROM u
  WHERE isodow(ts) = 1 AND friday_close IS NOT NULL AND atr > 0),
k AS (SELECT * FROM m WHERE gap_atr >= 0.3 QUALIFY row_number() OVER (PARTITION BY symbol, friday_ix ORDER BY ix) = 1)
SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx('friday_close')} AS friday_close, {sql.fx('gap_atr')} AS gap_atr, {sql.fx('gap_pct')} AS gap_pct,
  CASE WHEN open > friday_close THEN 'up' ELSE 'down' END AS gap_type, CASE WHEN open > friday_close THEN -1 ELSE 1 END AS signal FROM k""")
def sig_monday_gap(spark: SparkSession, sf: str) -> DataFrame:
    bars = in_frames(tables.indexed_daily(spark, sf), ind.add_atr_sma, before=15)
    return present(signals.monday_gap(bars), "symbol", "ts", "friday_close", "gap_atr", "gap_pct", "gap_type", "signal")


@query("sig_vshape", f"""WITH RECURSIVE {sql.event_bars('1h')}, {sql.atr_sma()},
m AS (SELECT *, close/nullif(lag(close) OVER ({sql.W}), 0) - 1 AS ret, lag(close) OVER ({sql.W}) AS prev FROM atrs),
s AS (SELECT symbol, 0::BIGINT AS ix, 0 AS streak, 0.0::DOUBLE AS moved, 0 AS fired FROM m WHERE ix = 0
  UNION ALL SELECT n.symbol, n.ix, CASE WHEN hit THEN 0 ELSE st END, CASE WHEN hit THEN 0 ELSE mv END, CASE WHEN hit THEN CASE WHEN st > 0 THEN -1 ELSE 1 END ELSE 0 END
  FROM (SELECT *, coalesce(abs(st) >= 3 AND mv > atr*1.5, FALSE) AS hit FROM (SELECT m.symbol, m.ix, m.atr,
    CASE WHEN ret IS NULL THEN streak WHEN ret > 0 AND streak >= 0 THEN streak + 1 WHEN ret < 0 AND streak <= 0 THEN streak - 1 WHEN ret > 0 THEN 1 ELSE -1 END AS st,
    CASE WHEN ret IS NULL THEN moved WHEN (ret > 0 AND streak >= 0) OR (ret < 0 AND streak <= 0) THEN moved + abs(ret)*prev ELSE abs(ret)*prev END AS mv
    FROM s JOIN m ON m.symbol = s.symbol AND m.ix = s.ix + 1) k) n)
SELECT s.symbol, {sql.tx('m.ts')} AS ts, fired AS signal FROM s JOIN m ON m.symbol = s.symbol AND m.ix = s.ix WHERE fired <> 0""")
def sig_vshape(spark: SparkSession, sf: str) -> DataFrame:
    bars = in_frames(tables.indexed(spark, sf), ind.add_atr_sma, before=15)
    return present(signals.vshape(bars), "symbol", "ts", "signal")


_VOTERS = {
    "ma_9_21": (f"{_lag('ema_9')} <= {_lag('ema_21')} AND ema_9 > ema_21", f"{_lag('ema_9')} >= {_lag('ema_21')} AND ema_9 < ema_21"),
    "ma_21_50": (f"{_lag('ema_21')} <= {_lag('ema_50')} AND ema_21 > ema_50", f"{_lag('ema_21')} >= {_lag('ema_50')} AND ema_21 < ema_50"),
    "rsi_30_70": ("rsi < 30", "rsi > 70"),
    "bollinger_bounce": ("close <= bb_lower AND NOT close >= bb_upper", "close >= bb_upper"),
    "breakout_20": (f"close > {sql.prev_extreme('max(high)', 20)}", f"close < {sql.prev_extreme('min(low)', 20)}"),
    "vol_1.5x": ("rvol >= 1.5 AND close > open", "rvol >= 1.5 AND close < open"),
    "ema_alignment": (_BULL, _BEAR),
}
VOTE_SQL = "v AS (SELECT symbol, tf, ts, ix, close, open, atr, unnest([" + ", ".join(
    f"{{'strategy': '{n}', 'signal': CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END}}" for n, (u, d) in _VOTERS.items()
) + "], recursive := true) FROM rs)"
PAIR_SQL = """vp AS (SELECT a.symbol, a.tf, a.ts, a.ix, a.close, a.atr, a.strategy || ' + ' || b.strategy AS strategy, a.signal FROM v a
  JOIN v b ON a.symbol = b.symbol AND a.ix = b.ix AND a.signal = b.signal AND a.signal <> 0
  JOIN pool x ON x.strategy = a.strategy JOIN pool y ON y.strategy = b.strategy AND x.k < y.k)"""
POOL_SQL = sql.values([(k, n) for k, n in enumerate(signals.VOTE_POOL)], "pool", "k, strategy")


@query("sig_vote", f"WITH {sql.event_bars('1h')}, {_RS}, {POOL_SQL}, {VOTE_SQL}, {PAIR_SQL} SELECT symbol, {sql.tx('ts')} AS ts, strategy, signal FROM vp")
def sig_vote(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return signals.add_votes(ind.add_research(df, w), w, signals.votes(2))
    out = in_frames(tables.indexed(spark, sf), build, before=_MARGIN)
    return present(signals.to_long(out), "symbol", "ts", "strategy", "signal")


def _beyond(n: int) -> tuple[str, str]:
    up, down = f"close > {sql.prev_extreme('max(high)', n)}", f"close < {sql.prev_extreme('min(low)', n)}"
    return f"{up} AND NOT coalesce({down}, FALSE)", down


_HOURS = "hour(ts) >= {} AND hour(ts) < {}"
_SPIKE = "rvol >= {0} AND close > open", "rvol >= {0} AND close < open"
_ALL_RULES = _VOTERS | {
    "ma_50_200": (f"{_lag('ema_50')} <= {_lag('ema_200')} AND ema_50 > ema_200", f"{_lag('ema_50')} >= {_lag('ema_200')} AND ema_50 < ema_200"),
    "rsi_25_75": ("rsi < 25", "rsi > 75"), "rsi_20_80": ("rsi < 20", "rsi > 80"),
    "rsi_divergence": (f"ix >= 20 AND close < min(close) {_PAST} AND rsi > min(rsi) {_PAST}", f"ix >= 20 AND close > max(close) {_PAST} AND rsi < max(rsi) {_PAST}"),
    "breakout_10": _beyond(10), "breakout_20": _beyond(20), "breakout_50": _beyond(50),
    "vol_2x": tuple(c.format("2.0") for c in _SPIKE),
    "london_session": (_HOURS.format(7, 12), "FALSE"), "ny_session": (_HOURS.format(12, 21), "FALSE"), "overlap_session": (_HOURS.format(12, 16), "FALSE"),
    "ema_rsi": (_edge("close > ema_9 AND rsi > 50"), _edge("close < ema_9 AND rsi < 50")),
    "bb_walk": (_streak("close <= bb_lower"), _streak("close >= bb_upper")),
    "vol_disc": (f"{_QUIET} AND return_1h > 0", f"{_QUIET} AND return_1h < 0"),
    "false_bo": (f"low < {_BOTTOM} AND lead(close, 2) OVER ({sql.W}) > {_BOTTOM}", f"high > {_TOP} AND lead(close, 2) OVER ({sql.W}) < {_TOP}"),
    "momentum_3": (f"close > {_lag('close', 3)}", f"close < {_lag('close', 3)}"),
}
_ALL_SQL = "v AS (SELECT symbol, ts, unnest([" + ", ".join(
    f"{{'strategy': '{n}', 'signal': CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END}}" for n, (u, d) in _ALL_RULES.items()
) + "], recursive := true) FROM rs)"


@query("sig_registry", f"WITH {sql.event_bars('1h')}, {_RS}, {_ALL_SQL} SELECT symbol, {sql.tx('ts')} AS ts, strategy, signal FROM v WHERE signal <> 0")
def sig_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered strategy, and a user's pandas strategy next to them."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return signals.add_signals(ind.add_research(df, w), w, signals.STRATEGIES | signals.FRESH)

    def momentum(block):
        return (block["close"].diff(3) > 0).astype(int) - (block["close"].diff(3) < 0).astype(int)

    bars = tables.indexed(spark, sf)
    builtin = signals.to_long(in_frames(bars, build, before=_MARGIN + 32, after=2))
    own = signals.pandas_strategy(bars, "momentum_3", momentum, before=3)
    return present(builtin.unionByName(own), "symbol", "ts", "strategy", "signal")


