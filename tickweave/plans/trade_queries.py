"""Queries from signals to labelled trades and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.functions.numbers import fix
from tickweave.operators import greedy, labels, risk, rules, scoring, signals, stats, structure
from tickweave.operators import indicators as ind
from tickweave.operators.frames import KEYS, block_of, in_frames
from tickweave.plans import research, sql
from tickweave.plans.catalogue import present, query
from tickweave.plans.signal_queries import VOTE_SQL
from tickweave.plans.structure_queries import VECTOR
from tickweave.plans.zone_queries import COMPOSITE
from tickweave.session import cut
from tickweave.sources import tables

_FB = f"{sql.pairs()}, {sql.atr_sma()}, {sql.false_breakout('atrs')}"
FB_1H = f"{sql.event_bars('1h')}, {_FB}, {sql.barrier_trades('sig')}"
FB_DAILY = f"{sql.daily_bars()}, {_FB}, {sql.barrier_trades('sig', warm_up=20, fallback='close')}"
TRADE_OUT = ("symbol", "@ts", "direction", "~entry_price", "~sl", "~tp", "exit_ix", "~exit_price", "exit_reason", "~risk", "~pnl_r", "~net_pnl_r")
_TRADE_NAMES = [c.lstrip("~@") for c in TRADE_OUT]


def fb_1h(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return research.false_breakout_trades(tables.indexed(spark, sf), tables.stand_in_pairs(spark), **kw)


def fb_daily(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    return research.false_breakout_trades(
        tables.indexed_daily(spark, sf) if bars is None else bars, tables.stand_in_pairs(spark), warm_up=20, close_exit_at="close"
    )


@query("entry_slice", f"""WITH {sql.event_bars('4h')}, {_FB}, {sql.barrier_trades('sig')}, {sql.stats('trades', 'symbol')}
SELECT {sql.out('symbol', *sql.STATS_OUT)} FROM st""")
def entry_slice(spark: SparkSession, sf: str) -> DataFrame:
    trades = research.false_breakout_trades(tables.indexed(spark, sf, "4h"), tables.stand_in_pairs(spark))
    return present(stats.trade_stats(trades, ["symbol"]))


# --- labels ----------------------------------------------------------------------------------

@query("lb_barrier_exit", f"WITH {FB_1H} SELECT {sql.out(*TRADE_OUT)} FROM trades")
def lb_barrier_exit(spark: SparkSession, sf: str) -> DataFrame:
    return present(fb_1h(spark, sf), *_TRADE_NAMES)


@query("lb_barrier_exit_pit", f"WITH {sql.event_bars('1h')}, {_FB}, {sql.barrier_trades('sig', lag=3)} SELECT {sql.out(*TRADE_OUT)} FROM trades")
def lb_barrier_exit_pit(spark: SparkSession, sf: str) -> DataFrame:
    """Entered only when the signal is known, three bars after the break."""
    return present(fb_1h(spark, sf, entry_lag=3), *_TRADE_NAMES)


@query("lb_barrier_exit_research", f"WITH {FB_DAILY} SELECT {sql.out(*TRADE_OUT)} FROM trades")
def lb_barrier_exit_research(spark: SparkSession, sf: str) -> DataFrame:
    return present(fb_daily(spark, sf), *_TRADE_NAMES)


@query("lb_r_multiple", f"WITH {FB_1H} SELECT symbol, {sql.tx('ts')} AS ts, {sql.out('~risk', '~pnl_r', '~net_pnl_r')} FROM trades WHERE exit_reason <> 'CLOSE_EXIT'")
def lb_r_multiple(spark: SparkSession, sf: str) -> DataFrame:
    trades = fb_1h(spark, sf).filter(F.col("exit_reason") != "CLOSE_EXIT")
    return present(trades, "symbol", "ts", "risk", "pnl_r", "net_pnl_r")


_MULTI_SIDE = "CASE WHEN total_buy >= 8 THEN 1 WHEN total_sell >= 8 THEN -1 ELSE 0 END"


def _multi_sql(sl_first: bool) -> str:
    stop = "f.low <= s.sl" , "f.high >= s.sl"
    hits = {k: (f"f.high >= s.tp{k}", f"f.low <= s.tp{k}") for k in (1, 2, 3)}
    side = lambda pair: f"(CASE WHEN s.signal = 1 THEN {pair[0]} ELSE {pair[1]} END)"
    targets = " ".join(f"WHEN {side(hits[k])} THEN {k}" for k in (3, 2, 1))
    case = f"CASE WHEN {side(stop)} THEN -1 {targets} END" if sl_first else f"CASE {targets} WHEN {side(stop)} THEN -1 END"
    return f"""ms0 AS (SELECT c.symbol, c.ts, c.ix, c.close, c.atr, {_MULTI_SIDE} AS signal, p.avoid_days, coalesce(p.spread_px, 0.0001) + coalesce(p.slippage_px, 0.00005) AS cost
  FROM cp c LEFT JOIN pairs p ON p.symbol = c.symbol),
ms1 AS (SELECT * FROM ms0 WHERE signal <> 0 AND {sql.session()} IN ('london', 'new_york', 'overlap') AND NOT list_contains(avoid_days, dayname(ts)) AND atr IS NOT NULL),
ms2 AS (SELECT *, close + signal*cost AS entry, close + signal*cost - signal*1.5*atr AS sl, close + signal*cost + signal*1.5*atr*1.5 AS tp1,
  close + signal*cost + signal*1.5*atr*2.5 AS tp2, close + signal*cost + signal*1.5*atr*3.5 AS tp3 FROM ms1),
ms3 AS (SELECT s.*, f.ix AS fix, {case} AS lv FROM ms2 s LEFT JOIN bars f ON f.symbol = s.symbol AND f.ix BETWEEN s.ix + 1 AND s.ix + 48),
ms AS (SELECT symbol, ts, ix, signal, entry, sl, tp1, min(CASE WHEN lv IS NOT NULL THEN fix END) AS hit_ix, arg_min(lv, CASE WHEN lv IS NOT NULL THEN fix END) AS lv,
  count(fix) AS n, max(fix) AS last_ix FROM ms3 GROUP BY ALL)
SELECT symbol, {sql.tx('ts')} AS ts, CASE signal WHEN 1 THEN 'buy' ELSE 'sell' END AS direction, {sql.fx('entry')} AS entry,
  CASE WHEN hit_ix IS NOT NULL THEN hit_ix WHEN n >= 48 THEN last_ix END AS exit_ix,
  CASE WHEN hit_ix IS NULL THEN CASE WHEN n >= 48 THEN 'exit' ELSE 'open' END WHEN lv = -1 THEN 'loss' ELSE 'win_tp' || lv END AS result FROM ms"""


def _multi(spark: SparkSession, sf: str, sl_first: bool) -> DataFrame:
    pairs = tables.stand_in_pairs(spark)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return structure.add_vector_flags(ind.add_research(df, w), w).withColumns(labels.future(w, 1, 48))


    framed = in_frames(tables.indexed(spark, sf), build, before=ind.core_margin() + 32, after=48)
    scored = scoring.add_composite(framed.withColumn("session", cal.session_of(F.col("ts"))))
    side = F.when(F.col("total_buy") >= 8, 1).when(F.col("total_sell") >= 8, -1).otherwise(0)
    scored = rules.with_day_filter(scored.withColumn("signal", side), pairs)
    fired = scored.filter(
        (F.col("signal") != 0) & F.col("session").isin(*cal.ALLOWED_SESSIONS) & (F.col("day_filter") != "avoid") & F.col("atr").isNotNull()
    )
    fired = risk.with_costs(fired, pairs)
    sign, dist = F.col("signal"), F.col("atr") * 1.5
    fired = fired.withColumn("entry", F.col("close") + sign * F.col("cost_px"))
    fired = fired.withColumns({
        "sl": F.col("entry") - sign * dist, **{f"tp{k}": F.col("entry") + sign * dist * m for k, m in ((1, 1.5), (2, 2.5), (3, 3.5))},
    })
    x = labels.multi_target(F.col("_fut"), sign, F.col("sl"), [F.col(f"tp{k}") for k in (1, 2, 3)], 48, sl_first)
    fired = fired.withColumn("_x", x).select("*", "_x.*")
    return fired.withColumn("direction", F.when(sign > 0, "buy").otherwise("sell"))


_MULTI_BASE = f"WITH {sql.event_bars('1h')}, {sql.pairs()}, {sql.research()}, {VECTOR}, {COMPOSITE}, "


@query("lb_barrier_multi", _MULTI_BASE + _multi_sql(True))
def lb_barrier_multi(spark: SparkSession, sf: str) -> DataFrame:
    return present(_multi(spark, sf, True), "symbol", "ts", "direction", "entry", "exit_ix", "result")


@query("lb_barrier_multi_tp_first", _MULTI_BASE + _multi_sql(False))
def lb_barrier_multi_tp_first(spark: SparkSession, sf: str) -> DataFrame:
    return present(_multi(spark, sf, False), "symbol", "ts", "direction", "entry", "exit_ix", "result")


GAPS = f"""u AS (SELECT *, last_value(CASE WHEN isodow(ts) = 5 THEN close END IGNORE NULLS) OVER ({sql.W}) AS friday_close,
  last_value(CASE WHEN isodow(ts) = 5 THEN ix END IGNORE NULLS) OVER ({sql.W}) AS friday_ix, max(ix) OVER (PARTITION BY symbol) AS nix FROM atrs WHERE ix >= 20),
m AS (SELECT *, abs(open - friday_close)/atr AS gap_atr FROM u WHERE isodow(ts) = 1 AND friday_close IS NOT NULL AND atr > 0 AND ix < nix)"""


def gap_sql(src: str, hold: str = "5", sl_mult: str = "1.0", by: str = "") -> str:
    """CTEs labelling Monday gaps of ``src`` including the entry bar."""
    extra = f", {by}" if by else ""
    return f"""g1 AS (SELECT *, CASE WHEN open > friday_close THEN -1 ELSE 1 END AS signal, open AS entry_price,
  open - CASE WHEN open > friday_close THEN -1 ELSE 1 END*atr*{sl_mult} AS sl, friday_close AS tp FROM {src}),
g2 AS (SELECT g.*, f.ix AS fix, f.close AS fclose, CASE WHEN signal = 1 THEN f.low <= sl ELSE f.high >= sl END AS hs,
  CASE WHEN signal = 1 THEN f.high >= tp OR f.close >= tp ELSE f.low <= tp OR f.close <= tp END AS ht
  FROM g1 g JOIN bars f ON f.symbol = g.symbol AND f.ix BETWEEN g.ix AND g.ix + {hold}),
g3 AS (SELECT symbol, tf, ts, ix, close, signal, entry_price, sl, tp, gap_atr{extra}, min(CASE WHEN hs THEN fix END) AS si, min(CASE WHEN ht THEN fix END) AS ti,
  arg_max(fclose, fix) AS lc, max(fix) AS li FROM g2 GROUP BY ALL),
g4 AS (SELECT *, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'SL' WHEN ti IS NOT NULL THEN 'TP' WHEN li > ix THEN 'TIME_EXIT' ELSE 'CLOSE_EXIT' END AS exit_reason FROM g3),
g5 AS (SELECT *, CASE exit_reason WHEN 'SL' THEN sl WHEN 'TP' THEN tp ELSE lc END AS exit_price, abs(entry_price - sl) AS risk, year(ts) AS year,
  CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS direction, CASE WHEN signal = 1 THEN 'down' ELSE 'up' END AS gap_type FROM g4),
gt AS (SELECT t.*, CASE WHEN risk > 0 THEN signal*(exit_price - entry_price)/risk ELSE 0 END AS pnl_r,
  CASE WHEN risk > 0 THEN (signal*(exit_price - entry_price) - {sql.COST_PIPS})/risk ELSE 0 END AS net_pnl_r FROM g5 t LEFT JOIN pairs p ON p.symbol = t.symbol)"""


GAP_TRADES = f"""{sql.daily_bars()}, {sql.pairs()}, {sql.atr_sma()}, {GAPS},
k AS (SELECT * FROM m WHERE gap_atr >= 0.3 QUALIFY row_number() OVER (PARTITION BY symbol, friday_ix ORDER BY ix) = 1), {gap_sql('k')}"""


def gap_trades(spark: SparkSession, sf: str) -> DataFrame:
    return research.gap_trades(tables.indexed_daily(spark, sf), tables.stand_in_pairs(spark))


@query("lb_gap_exit", f"WITH {GAP_TRADES} SELECT symbol, {sql.tx('ts')} AS ts, direction, gap_type, exit_reason, {sql.out('~entry_price', '~sl', '~tp', '~exit_price', '~gap_atr', '~pnl_r', '~net_pnl_r')} FROM gt")
def lb_gap_exit(spark: SparkSession, sf: str) -> DataFrame:
    return present(
        gap_trades(spark, sf), "symbol", "ts", "direction", "gap_type", "exit_reason", "entry_price", "sl", "tp", "exit_price", "gap_atr", "pnl_r", "net_pnl_r"
    )


_TOP10, _LOW10 = sql.prev_extreme("max(high)", 10), sql.prev_extreme("min(low)", 10)
_PCT = f"""ps AS (SELECT symbol, tf, ts, ix, close, CASE WHEN close < {_LOW10} THEN -1 WHEN close > {_TOP10} THEN 1 ELSE 0 END AS signal FROM bars),
pe AS (SELECT s.*, (SELECT min(f.ix) FROM bars f WHERE f.symbol = s.symbol AND f.ix > s.ix AND CASE WHEN signal = 1 THEN f.close >= s.close*1.01 OR f.close <= s.close*0.995
  ELSE f.close <= s.close*0.99 OR f.close >= s.close*1.005 END) AS exit_ix FROM ps s WHERE signal <> 0 AND ix >= 50),
nx AS (SELECT t.symbol, t.signal, t.ix, (SELECT min(c.ix) FROM pe c WHERE c.symbol = t.symbol AND c.signal = t.signal AND c.ix > t.exit_ix) AS next_ix FROM pe t),
pick AS (SELECT symbol, signal, min(ix) AS ix FROM pe GROUP BY symbol, signal
  UNION ALL SELECT p.symbol, p.signal, n.next_ix FROM pick p JOIN nx n ON n.symbol = p.symbol AND n.signal = p.signal AND n.ix = p.ix WHERE n.next_ix IS NOT NULL)"""


@query("lb_pct_exit", f"""WITH RECURSIVE {sql.event_bars('1h')}, {_PCT}
SELECT e.symbol, CASE e.signal WHEN 1 THEN 'bullish' ELSE 'bearish' END AS direction, {sql.tx('e.ts')} AS ts, e.exit_ix, {sql.fx('e.signal*(x.close - e.close)/nullif(e.close, 0)*100')} AS pnl_pct
FROM pick p JOIN pe e ON e.symbol = p.symbol AND e.signal = p.signal AND e.ix = p.ix JOIN bars x ON x.symbol = e.symbol AND x.ix = e.exit_ix""")
def lb_pct_exit(spark: SparkSession, sf: str) -> DataFrame:
    return present(research.percent_exit_trades(cut(tables.indexed(spark, sf)), signals.breakout(10)), "symbol", "direction", "ts", "exit_ix", "pnl_pct")


_PICK = """nx AS (SELECT t.symbol, t.ix, (SELECT min(c.ix) FROM trades c WHERE c.symbol = t.symbol AND c.ix > t.exit_ix) AS next_ix FROM trades t),
pick AS (SELECT symbol, min(ix) AS ix FROM trades GROUP BY symbol
  UNION ALL SELECT p.symbol, n.next_ix FROM pick p JOIN nx n ON n.symbol = p.symbol AND n.ix = p.ix WHERE n.next_ix IS NOT NULL)"""


@query("lb_non_overlap", f"WITH RECURSIVE {FB_1H}, {_PICK} SELECT t.symbol, {sql.tx('t.ts')} AS ts, t.ix, t.exit_ix, {sql.fx('t.pnl_r')} AS pnl_r FROM trades t JOIN pick p ON p.symbol = t.symbol AND p.ix = t.ix")
def lb_non_overlap(spark: SparkSession, sf: str) -> DataFrame:
    taken = greedy.non_overlapping(fb_1h(spark, sf), [*KEYS, "strategy"])
    return present(taken, "symbol", "ts", "ix", "exit_ix", "pnl_r")


@query("lb_equity_curve", f"""WITH {FB_1H} SELECT symbol, {sql.tx('ts')} AS ts,
  {sql.fx('10000*exp(sum(ln(1 + pnl_r*0.01)) OVER (PARTITION BY symbol ORDER BY ix ROWS UNBOUNDED PRECEDING))', 4)} AS equity FROM trades""")
def lb_equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = stats.equity_curve(fb_1h(spark, sf), KEYS, "pnl_r", ["ix"], block_of())
    return present(curve, "symbol", "ts", "equity", digits=4)


@query("lb_forward_return", f"""WITH {sql.event_bars('1h')}, f AS (SELECT *, lead(close) OVER ({sql.W})/nullif(close, 0) - 1 AS fwd_return FROM bars)
SELECT symbol, {sql.tx('ts')} AS ts, {sql.fx('fwd_return')} AS fwd_return, CAST(CASE WHEN close > open THEN fwd_return > 0 ELSE fwd_return < 0 END AS INTEGER) AS direction_hit FROM f""")
def lb_forward_return(spark: SparkSession, sf: str) -> DataFrame:
    return present(in_frames(tables.indexed(spark, sf), labels.forward_return, after=1), "symbol", "ts", "fwd_return", "direction_hit")


# --- statistics ------------------------------------------------------------------------------

_NAMED = FB_1H + ", named AS (SELECT *, 'false_breakout' AS strategy FROM trades)"


@query("ag_trade_stats", f"WITH {_NAMED}, {sql.stats('named', 'strategy', order='ts, symbol', periods='52.0')} SELECT {sql.out('strategy', *sql.STATS_OUT)} FROM st")
def ag_trade_stats(spark: SparkSession, sf: str) -> DataFrame:
    """All trades as one group in time order: cut into days, so even one group is spread over tasks."""
    out = stats.trade_stats(fb_1h(spark, sf), ["strategy"], order=("ts", "symbol"), periods=stats.WEEKS)
    return present(out)


_ACC = """ac0 AS (SELECT *, coalesce(exit_ix, ix) - ix AS hold, sum(ln(1 + net_pnl_r*0.01)) OVER (PARTITION BY symbol ORDER BY ix ROWS UNBOUNDED PRECEDING) AS g FROM trades),
ac1 AS (SELECT *, 10000*exp(g) - 10000*exp(g - ln(1 + net_pnl_r*0.01)) AS money, greatest(max(g) OVER (PARTITION BY symbol ORDER BY ix ROWS UNBOUNDED PRECEDING), 0) - g AS dd,
  last_value(g) OVER (PARTITION BY symbol ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ge FROM ac0),
acc AS (SELECT symbol, count(*) AS total_trades, count(CASE WHEN net_pnl_r > 0 THEN 1 END) AS wins, count(CASE WHEN net_pnl_r < 0 THEN 1 END) AS losses,
  count(CASE WHEN net_pnl_r > 0 THEN 1 END)/count(*)*100 AS win_rate,
  sum(CASE WHEN net_pnl_r > 0 THEN money END)/nullif(-sum(CASE WHEN net_pnl_r < 0 THEN money END), 0) AS profit_factor, (exp(any_value(ge)) - 1)*100 AS total_return,
  (1 - exp(-max(dd)))*100 AS max_drawdown, avg(CASE WHEN net_pnl_r > 0 THEN money END) AS avg_win, avg(CASE WHEN net_pnl_r < 0 THEN money END) AS avg_loss,
  max(money) AS best_trade, min(money) AS worst_trade, avg(hold) AS avg_hold,
  avg(CASE WHEN net_pnl_r > 0 THEN 1.0 ELSE 0 END)*coalesce(avg(CASE WHEN net_pnl_r > 0 THEN money END), 0)
    + (1 - avg(CASE WHEN net_pnl_r > 0 THEN 1.0 ELSE 0 END))*coalesce(avg(CASE WHEN net_pnl_r < 0 THEN money END), 0) AS expectancy,
  avg(money)/nullif(stddev_pop(money), 0) AS sharpe FROM ac1 GROUP BY symbol)"""
_ACC_OUT = ("total_trades", "wins", "losses", "~win_rate", "~profit_factor", "~total_return", "~max_drawdown", "~avg_win", "~avg_loss", "~best_trade", "~worst_trade", "~avg_hold", "~expectancy", "~sharpe")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    trades = fb_1h(spark, sf).withColumn("hold", F.coalesce(F.col("exit_ix"), F.col("ix")) - F.col("ix"))
    return stats.account_stats(trades, ["symbol"], "net_pnl_r", "hold", ["ix"], block_of())


@query("ag_account_stats", f"WITH {FB_1H}, {_ACC} SELECT {sql.out('symbol', *_ACC_OUT, digits=4)} FROM acc")
def ag_account_stats(spark: SparkSession, sf: str) -> DataFrame:
    return present(accounts(spark, sf), digits=4)


@query("pf_portfolio_summary", f"""WITH {FB_1H}, {_ACC}
SELECT coalesce(symbol, 'ALL') AS symbol, CAST(sum(total_trades) AS BIGINT) AS total_trades, CAST(sum(wins) AS BIGINT) AS wins, {sql.fx('sum(wins)/sum(total_trades)*100', 4)} AS win_rate,
  {sql.fx('sum(total_return)', 4)} AS total_return, {sql.fx('avg(CASE WHEN max_drawdown > 0 THEN max_drawdown END)', 4)} AS avg_drawdown FROM acc GROUP BY ROLLUP(symbol)""")
def pf_portfolio_summary(spark: SparkSession, sf: str) -> DataFrame:
    return present(stats.portfolio_summary(accounts(spark, sf)), digits=4)


# Two strategies on the same bars, so that a breakdown by strategy has something to show.
_TWO = f"""{sql.event_bars('1h')}, {sql.pairs()}, {sql.atr_sma()},
two0 AS (SELECT *, CASE WHEN close < {sql.prev_extreme('min(low)', 20)} THEN -1 WHEN close > {sql.prev_extreme('max(high)', 20)} THEN 1 ELSE 0 END AS breakout_20,
  CASE WHEN volume >= 1.5*nullif({sql.roll('avg(volume)', 20)}, 0) AND close > open THEN 1 WHEN volume >= 1.5*nullif({sql.roll('avg(volume)', 20)}, 0) AND close < open THEN -1 ELSE 0 END AS vol FROM atrs),
two AS (SELECT *, breakout_20 AS signal, 'breakout_20' AS strategy FROM two0 UNION ALL SELECT *, vol AS signal, 'vol_1.5x' AS strategy FROM two0),
{sql.barrier_trades('two', by='strategy', warm_up=0)}, dims AS (SELECT *, {sql.session()} AS session, dayname(ts) AS day FROM trades)"""


def two_strategies(spark: SparkSession, sf: str) -> DataFrame:
    pool = {n: signals.STRATEGIES[n] for n in ("breakout_20", "vol_1.5x")}

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_volume(ind.add_atr_sma(df, w), w)
        return labels.add_entry(signals.add_signals(df, w, pool), w)

    framed = in_frames(tables.indexed(spark, sf), build, before=21, after=25).filter(F.size("signals") > 0)
    long = framed.select(*KEYS, "ts", "ix", "open", "close", "atr", "_entry", "_fut", F.inline("signals"))
    trades = labels.barrier_trades(long, warm_up=0)
    trades = labels.net_of_costs(risk.with_costs(trades, tables.stand_in_pairs(spark)), F.col("cost_pips"))
    return trades.withColumns({"session": cal.session_of(F.col("ts")), "day": cal.day_name(F.col("ts"))})


def _one_dim(d: str) -> str:
    return (f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS total, count(CASE WHEN net_pnl_r > 0 THEN 1 END) AS wins, "
            f"{sql.fx('count(CASE WHEN net_pnl_r > 0 THEN 1 END)/count(*)*100')} AS win_rate, {sql.fx('sum(net_pnl_r)')} AS pnl FROM dims GROUP BY {d}")


_DIMS = ("session", "day", "strategy", "symbol")
for _d in _DIMS:
    @query(f"ag_by_{_d}", f"WITH {_TWO} {_one_dim(_d)}")
    def _by(spark: SparkSession, sf: str, dim: str = _d) -> DataFrame:
        return present(stats.by_dimensions(two_strategies(spark, sf), [dim], total=False))


@query("ag_by_dimensions", f"WITH {_TWO} " + " UNION ALL ".join(_one_dim(d) for d in _DIMS) + " UNION ALL " + _one_dim("'all'").replace("''all''", "'all'").replace("GROUP BY 'all'", ""))
def ag_by_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Every breakdown and the total in one pass over the trades."""
    return present(stats.by_dimensions(two_strategies(spark, sf), _DIMS))


_PLAIN = ("total_trades", "wins", "losses", "~pf", "~wr", "~avg_r", "~sharpe", "~gross_profit", "~gross_loss")


@query("ag_year_by_year", f"WITH {FB_DAILY}, {sql.stats('trades', 'symbol, year')} SELECT symbol, CAST(year AS INTEGER) AS year, {sql.out(*_PLAIN)} FROM st")
def ag_year_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return present(stats.plain_stats(fb_daily(spark, sf), ["symbol", "year"]))


@query("ag_direction_split", f"WITH {GAP_TRADES}, {sql.stats('gt', 'symbol, gap_type', periods='52.0')} SELECT symbol, gap_type, {sql.out(*_PLAIN)} FROM st")
def ag_direction_split(spark: SparkSession, sf: str) -> DataFrame:
    return present(stats.plain_stats(gap_trades(spark, sf), ["symbol", "gap_type"], periods=stats.WEEKS))


_POOL = f"""{sql.event_bars('1h')}, {sql.pairs()}, {sql.research()}, {VOTE_SQL}, {sql.barrier_trades('v', by='strategy', warm_up=0)},
res AS (SELECT *, CASE exit_reason WHEN 'TP' THEN 'win' WHEN 'SL' THEN 'loss' ELSE 'open' END AS result FROM trades)"""


def pool_trades(spark: SparkSession, sf: str) -> DataFrame:
    return research.strategy_trades(tables.indexed(spark, sf), {n: signals.STRATEGIES[n] for n in signals.VOTE_POOL})


@query("ag_strategy_day", f"""WITH {_POOL},
d AS (SELECT symbol, strategy, dayname(ts) AS day, count(*) AS trades, count(CASE result WHEN 'win' THEN 1 END) AS wins, count(CASE result WHEN 'loss' THEN 1 END) AS losses FROM res WHERE result <> 'open' GROUP BY ALL)
SELECT symbol, strategy, day, trades, wins, losses, {sql.fx('wins/trades*100')} AS win_rate, {sql.fx('wins*1.5/nullif(losses, 0)')} AS profit_factor, {sql.fx('wins*1.5 - losses')} AS net_r FROM d""")
def ag_strategy_day(spark: SparkSession, sf: str) -> DataFrame:
    return present(stats.strategy_day(pool_trades(spark, sf)).drop("tf"))


@query("ag_best_worst_day", f"""WITH {_POOL},
d AS (SELECT symbol, strategy, dayname(ts) AS day, count(*) AS trades, count(CASE result WHEN 'win' THEN 1 END)*1.5/nullif(count(CASE result WHEN 'loss' THEN 1 END), 0) AS pf FROM res WHERE result <> 'open' GROUP BY ALL),
b AS (SELECT *, 'best' AS rank FROM d QUALIFY row_number() OVER (PARTITION BY symbol, strategy ORDER BY pf DESC NULLS FIRST, day) = 1),
w AS (SELECT *, 'worst' AS rank FROM d QUALIFY row_number() OVER (PARTITION BY symbol, strategy ORDER BY pf ASC NULLS LAST, day) = 1)
SELECT symbol, strategy, day, trades, {sql.fx('pf')} AS profit_factor, rank FROM (SELECT * FROM b UNION ALL SELECT * FROM w) WHERE trades >= 5""")
def ag_best_worst_day(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.best_worst_day(cut(stats.strategy_day(pool_trades(spark, sf))))
    return present(out, "symbol", "strategy", "day", "trades", "profit_factor", "rank")


_GRID = f"""{_POOL}, gr AS (SELECT symbol, strategy, count(*) AS trades, count(CASE result WHEN 'win' THEN 1 END) AS wins, count(CASE result WHEN 'loss' THEN 1 END) AS losses,
  avg(CASE result WHEN 'win' THEN 0.015 ELSE -0.01 END)/nullif(stddev_pop(CASE result WHEN 'win' THEN 0.015::DOUBLE ELSE -0.01::DOUBLE END), 0) AS sr FROM res WHERE result <> 'open' GROUP BY ALL),
grid AS (SELECT *, wins/trades*100 AS win_rate, wins*1.5/nullif(losses, 0) AS profit_factor, coalesce(sr, 0) AS sharpe FROM gr)"""
_GRID_OUT = sql.out("symbol", "strategy", "trades", "wins", "losses", "~win_rate", "~profit_factor", "~sharpe")


@query("ag_grid_rank", f"WITH {_GRID} SELECT {_GRID_OUT} FROM grid ORDER BY {sql.fx('sharpe', 9)} DESC, symbol, strategy LIMIT 15")
def ag_grid_rank(spark: SparkSession, sf: str) -> DataFrame:
    return present(_ranked(spark, sf, 15), "symbol", "strategy", "trades", "wins", "losses", "win_rate", "profit_factor", "sharpe")


@query("ag_grid_rank_per_symbol", f"WITH {_GRID} SELECT {_GRID_OUT} FROM grid QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {sql.fx('sharpe', 9)} DESC, strategy) <= 3")
def ag_grid_rank_per_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return present(_ranked(spark, sf, 3, ("symbol",)), "symbol", "strategy", "trades", "wins", "losses", "win_rate", "profit_factor", "sharpe")


def _ranked(spark: SparkSession, sf: str, n: int, per: tuple[str, ...] = ()) -> DataFrame:

    grid = stats.win_loss_grid(pool_trades(spark, sf), [*KEYS, "strategy"]).withColumn("_order", fix(F.col("sharpe"), 9))
    return stats.rank_grid(grid, n, "_order", per)


