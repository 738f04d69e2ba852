"""Pieces of SQL shared by the check statements (DuckDB dialect)."""

from __future__ import annotations

from tickweave.operators.indicators import EMA_SPANS
from tickweave.sources import dims

INTERVAL = {"1h": "INTERVAL 1 HOUR", "4h": "INTERVAL 4 HOUR", "1d": "INTERVAL 1 DAY"}


def fx(expr: str, digits: int = 6) -> str:
    return f"floor(({expr})*1e{digits}+0.5)/1e{digits}"


def tx(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def out(*cols: str, digits: int = 6) -> str:
    """Select list: ``name`` as it is, ``~name`` rounded, ``@name`` time as text, ``?name`` flag as 0/1."""
    parts = []
    for c in cols:
        mark, name = (c[0], c[1:]) if c[0] in "~@?" else ("", c)
        expr, _, alias = name.partition(" AS ")
        alias = alias or expr
        if mark == "~":
            parts.append(f"{fx(expr, digits)} AS {alias}")
        elif mark == "@":
            parts.append(f"{tx(expr)} AS {alias}")
        elif mark == "?":
            parts.append(f"CAST({expr} AS INTEGER) AS {alias}")
        else:
            parts.append(f"{expr} AS {alias}")
    return ", ".join(parts)


def event_bars(tf: str, name: str = "bars", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT symbol, '{tf}' AS tf, b AS ts,
         first(price ORDER BY t, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY t, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,
         row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS ix
  FROM (SELECT event_type AS symbol, time_bucket({INTERVAL[tf]}, ts) AS b, ts AS t, value AS price, event_id
        FROM events WHERE {where}) GROUP BY symbol, b)"""


def daily_bars(name: str = "bars") -> str:
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price"
    return f"""{name} AS (
  SELECT symbol, '1d' AS tf, b AS ts,
         first(price ORDER BY {key}) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {key}) AS close, CAST(count(*) AS DOUBLE) AS volume,
         row_number() OVER (PARTITION BY symbol ORDER BY b) - 1 AS ix
  FROM (SELECT l_returnflag AS symbol, time_bucket(INTERVAL 1 DAY, l_shipdate) AS b, l_extendedprice AS price,
               l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) GROUP BY symbol, b)"""


W = "PARTITION BY symbol ORDER BY ix"


def roll(agg: str, n: int, nulls: int = 0) -> str:
    return f"CASE WHEN ix >= {n - 1 + nulls} THEN {agg} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


def prev_extreme(agg: str, n: int) -> str:
    return f"CASE WHEN ix >= {n} THEN {agg} OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


TR = f"greatest(high-low, abs(high-lag(close) OVER ({W})), abs(low-lag(close) OVER ({W})))"


def atr_sma(src: str = "bars", name: str = "atrs", first: bool = False, n: int = 14) -> str:
    """CTEs adding the simple-mean ATR as ``atr``."""
    tr = TR if first else f"CASE WHEN ix > 0 THEN {TR} END"
    return f"""{name}_tr AS (SELECT *, {tr} AS tr FROM {src}),
{name} AS (SELECT * EXCLUDE (tr), {roll('avg(tr)', n, 0 if first else 1)} AS atr FROM {name}_tr)"""


def core(src: str = "bars", name: str = "core", spans=EMA_SPANS) -> str:
    """CTEs adding exponential atr, rsi and EMAs as weighted sums over all earlier bars."""
    def term(value: str, span: int, start: int) -> str:
        alpha = 2.0 / (span + 1)
        return (f"sum(CASE WHEN b.ix < {start} THEN 0 ELSE "
                f"(CASE WHEN b.ix = {start} THEN 1.0 ELSE {alpha!r} END) * pow({1.0 - alpha!r}, a.ix - b.ix) * b.{value} END)")
    emas = ", ".join(f"{term('close', s, 0)} AS ema_{s}" for s in spans)
    return f"""{name}_d AS (SELECT *, {TR} AS tr, close - lag(close) OVER ({W}) AS chg FROM {src}),
{name}_g AS (SELECT symbol, ix, close, tr, coalesce(greatest(chg, 0), 0) AS gain, coalesce(greatest(-chg, 0), 0) AS loss FROM {name}_d),
{name}_s AS (SELECT a.symbol, a.ix, {term('tr', 14, 0)} AS atr, {term('gain', 14, 1)} AS mg, {term('loss', 14, 1)} AS ml, {emas}
  FROM {name}_g a JOIN {name}_g b ON a.symbol = b.symbol AND b.ix <= a.ix GROUP BY a.symbol, a.ix),
{name} AS (SELECT d.* EXCLUDE (tr, chg), s.atr, CASE WHEN d.ix >= 1 AND s.ml <> 0 THEN 100 - 100/(1 + s.mg/s.ml) END AS rsi,
  {', '.join(f's.ema_{s}' for s in spans)} FROM {name}_d d JOIN {name}_s s ON d.symbol = s.symbol AND d.ix = s.ix)"""


def research(src: str = "bars", name: str = "rs") -> str:
    """CTEs with every research column."""
    core_cte = core(src, f"{name}_core")
    return f"""{core_cte},
{name}_b AS (SELECT *, {roll('avg(close)', 20)} AS bb_mid, {roll('stddev_samp(close)', 20)} AS sd,
  {roll('avg(volume)', 20)} AS volume_sma, close/nullif(lag(close) OVER ({W}), 0) - 1 AS return_1h,
  close/nullif(lag(close, 4) OVER ({W}), 0) - 1 AS return_4h, close/nullif(lag(close, 24) OVER ({W}), 0) - 1 AS return_1d,
  atr/nullif(close, 0)*100 AS volatility, hour(ts) AS hour FROM {name}_core),
{name} AS (SELECT * EXCLUDE (sd), bb_mid + 2*sd AS bb_upper, bb_mid - 2*sd AS bb_lower, 4*sd/bb_mid AS bb_width,
  coalesce(volume/nullif(volume_sma, 0), 1.0) AS rvol FROM {name}_b)"""


def session(ts: str = "ts") -> str:
    h = f"hour({ts})"
    return (f"CASE WHEN {h} >= 12 AND {h} < 16 THEN 'overlap' WHEN {h} >= 7 AND {h} < 16 THEN 'london' "
            f"WHEN {h} >= 0 AND {h} < 8 THEN 'asia' WHEN {h} >= 12 AND {h} < 21 THEN 'new_york' ELSE 'dead_zone' END")


def values(rows: list[tuple], name: str, cols: str) -> str:
    def lit(v) -> str:
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return f'{v!r}::DOUBLE' if isinstance(v, float) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def pairs() -> str:
    rows = [
        (s, dims.SPREAD_PIPS[p], dims.PIP_SIZE[p], dims.SPREAD_PX[p], dims.SLIPPAGE_PX[p], dims.BEST_DAYS[p],
         dims.AVOID_DAYS[p], dims.NEWS_CURRENCIES.get(p, dims.DEFAULT_CURRENCIES))
        for s, p in dims.STAND_IN.items()
    ]
    return values(rows, "pairs", "symbol, spread_pips, pip_size, spread_px, slippage_px, best_days, avoid_days, currencies")


COST_PIPS = ("(coalesce(p.spread_pips, 1.0)*CAST(coalesce(p.pip_size, 0.0001) AS DOUBLE)"
             " + 0.5*CAST(coalesce(p.pip_size, 0.0001) AS DOUBLE) + 0.5*CAST(coalesce(p.pip_size, 0.0001) AS DOUBLE))")


def barrier_trades(
    src: str, name: str = "trades", lag: int = 1, hold: int = 24, rr: float = 1.5, sl: float = 1.5,
    warm_up: int = 15, fallback: str = "entry_price", by: str = "", sl_first: bool = True,
) -> str:
    """CTEs labelling rows of ``src`` (symbol, ix, ts, close, atr, signal, ...) by first touch on ``bars``."""
    extra = f", {by}" if by else ""
    first = "1" if sl_first else "2"
    second = "2" if sl_first else "1"
    return f"""{name}_e AS (SELECT s.symbol, s.tf, s.ix, s.ts, s.close, s.signal{extra}, e.open AS entry_price,
    coalesce(s.atr, e.open*0.005)*{sl} AS dist
  FROM {src} s JOIN bars e ON e.symbol = s.symbol AND e.ix = s.ix + {lag} WHERE s.signal <> 0 AND s.ix >= {warm_up}),
{name}_b AS (SELECT *, entry_price - signal*dist AS sl, entry_price + signal*dist*{rr} AS tp FROM {name}_e),
{name}_h AS (SELECT s.*, f.ix AS fix, f.close AS fclose,
    CASE WHEN s.signal = 1 THEN f.low <= s.sl ELSE f.high >= s.sl END AS hit_sl,
    CASE WHEN s.signal = 1 THEN f.high >= s.tp ELSE f.low <= s.tp END AS hit_tp
  FROM {name}_b s LEFT JOIN bars f ON f.symbol = s.symbol AND f.ix BETWEEN s.ix + {lag + 1} AND s.ix + {lag + hold}),
{name}_f AS (SELECT symbol, tf, ix, ts, close, signal{extra}, entry_price, sl, tp,
    min(CASE WHEN hit_sl THEN fix END) AS sl_ix, min(CASE WHEN hit_tp THEN fix END) AS tp_ix,
    max(fix) AS last_ix, arg_max(fclose, fix) AS last_close FROM {name}_h GROUP BY ALL),
{name}_x AS (SELECT *, CASE
    WHEN sl_ix IS NOT NULL AND (tp_ix IS NULL OR sl_ix {'<=' if sl_first else '<'} tp_ix) THEN 'SL' WHEN tp_ix IS NOT NULL THEN 'TP'
    WHEN last_ix IS NOT NULL THEN 'TIME_EXIT' ELSE 'CLOSE_EXIT' END AS exit_reason FROM {name}_f),
{name}_p AS (SELECT *, CASE exit_reason WHEN 'SL' THEN sl WHEN 'TP' THEN tp WHEN 'TIME_EXIT' THEN last_close ELSE {fallback} END AS exit_price,
    CASE exit_reason WHEN 'SL' THEN sl_ix WHEN 'TP' THEN tp_ix WHEN 'TIME_EXIT' THEN last_ix END AS exit_ix,
    abs(entry_price - sl) AS risk, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS direction, year(ts) AS year FROM {name}_x),
{name} AS (SELECT t.*, CASE WHEN risk > 0 THEN signal*(exit_price - entry_price)/risk ELSE 0 END AS pnl_r,
    CASE WHEN risk > 0 THEN signal*(exit_price - entry_price)/risk - {COST_PIPS}/risk ELSE 0 END AS net_pnl_r
  FROM {name}_p t LEFT JOIN pairs p ON p.symbol = t.symbol)"""


def stats(src: str, by: str, pnl: str = "net_pnl_r", order: str = "ts", periods: str = "52.0*7*24", name: str = "st") -> str:
    """CTEs with trade statistics per group."""
    return f"""{name}_c AS (SELECT *, {pnl} AS v, sum({pnl}) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cum FROM {src}),
{name}_d AS (SELECT *, max(cum) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - cum AS dd FROM {name}_c),
{name} AS (SELECT {by}, count(*) AS total_trades, count(CASE WHEN v > 0 THEN 1 END) AS wins, count(CASE WHEN v < 0 THEN 1 END) AS losses,
  sum(CASE WHEN v > 0 THEN v ELSE 0 END)/nullif(sum(CASE WHEN v < 0 THEN -v ELSE 0 END), 0) AS pf,
  count(CASE WHEN v > 0 THEN 1 END)/count(*) AS wr, avg(v) AS avg_r, max(dd) AS mdd_r,
  CASE WHEN count(*) = 1 THEN avg(v)*sqrt({periods}) WHEN stddev_pop(v) > 1e-9 THEN avg(v)/stddev_pop(v)*sqrt({periods}) ELSE 0 END AS sharpe,
  sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS gross_profit, sum(CASE WHEN v < 0 THEN -v ELSE 0 END) AS gross_loss
  FROM {name}_d GROUP BY {by})"""


STATS_OUT = ("total_trades", "wins", "losses", "~pf", "~wr", "~avg_r", "~mdd_r", "~sharpe", "~gross_profit", "~gross_loss")


def false_breakout(src: str = "bars", name: str = "sig", n: int = 10) -> str:
    return f"""{name}_x AS (SELECT *, {prev_extreme('max(high)', n)} AS top, {prev_extreme('min(low)', n)} AS bottom,
  lead(close, 2) OVER ({W}) AS later FROM {src}),
{name} AS (SELECT *, CASE WHEN low < bottom AND later > bottom THEN 1 WHEN high > top AND later < top THEN -1 ELSE 0 END AS signal FROM {name}_x)"""
