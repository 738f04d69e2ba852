"""Queries on market profile, trade log and source comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.operators import indicators as ind
from tickweave.operators import profile, quality, tradelog
from tickweave.operators.frames import SLICE_ROWS, in_frames
from tickweave.plans import sql
from tickweave.plans.catalogue import present, query
from tickweave.plans.signal_queries import _FB_LIVE, fb_setups
from tickweave.session import cut
from tickweave.sources import tables
from tickweave.sources.bars import bars_from_ticks

# --- profile ---------------------------------------------------------------------------------

_FULL = "rs WHERE return_1d IS NOT NULL AND rsi IS NOT NULL AND bb_width IS NOT NULL AND volatility IS NOT NULL AND return_4h IS NOT NULL AND return_1h IS NOT NULL"
_R = f"WITH {sql.event_bars('1h')}, {sql.research()}, r AS (SELECT *, {sql.session()} AS session FROM {_FULL})"


def full_bars(spark: SparkSession, sf: str, extra=None, after: int = 0) -> DataFrame:
    """Research bars of the events with no column missing."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_research(df, w)
        return df if extra is None else extra(df, w)

    columns = ["return_1d", "return_4h", "return_1h", "rsi", "bb_width", "volatility"]
    return in_frames(tables.indexed(spark, sf), build, before=ind.core_margin() + 64, after=after).dropna(subset=columns)


@query("pf_returns", f"""{_R} SELECT symbol, count(*) AS candles, {sql.tx('min(ts)')} AS first_ts, {sql.tx('max(ts)')} AS last_ts, {sql.fx('avg(return_1h)*100', 4)} AS avg_return,
  {sql.fx('stddev_samp(return_1h)*100', 4)} AS std_return, {sql.fx('avg(CASE WHEN return_1h > 0 THEN 1.0::DOUBLE ELSE 0 END)*100', 4)} AS positive_pct,
  {sql.fx('skewness(return_1h)', 4)} AS skew, {sql.fx('kurtosis(return_1h)', 4)} AS kurtosis FROM r GROUP BY symbol""")
def pf_returns(spark: SparkSession, sf: str) -> DataFrame:
    return present(profile.returns(full_bars(spark, sf)).drop("tf"), digits=4)


@query("pf_session", f"""{_R}, s AS (SELECT *, lead(close) OVER (PARTITION BY symbol, session ORDER BY ts)/nullif(close, 0) - 1 AS fwd FROM r WHERE session <> 'dead_zone')
SELECT symbol, session, count(*) AS candles, {sql.fx('avg(return_1h)*100', 4)} AS avg_return, {sql.fx('stddev_samp(return_1h)*100', 4)} AS std_return, {sql.fx('avg(volatility)', 4)} AS volatility,
  {sql.fx('avg(CASE WHEN coalesce(CASE WHEN close > open THEN fwd > 0 ELSE fwd < 0 END, FALSE) THEN 1.0::DOUBLE ELSE 0 END)*100', 4)} AS directional_win_rate FROM s GROUP BY symbol, session""")
def pf_session(spark: SparkSession, sf: str) -> DataFrame:
    bars = full_bars(spark, sf).withColumn("session", cal.session_of(F.col("ts")))
    out = profile.sessions(bars, F.floor(F.col("ix") / SLICE_ROWS))
    return present(out.drop("tf"), digits=4)


@query("pf_hourly", f"""{_R}, h AS (SELECT symbol, CAST(hour AS INTEGER) AS hour, avg(return_1h) AS mean, stddev_samp(return_1h) AS std, count(*) AS count FROM r GROUP BY symbol, hour),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, hour) AS b, row_number() OVER (PARTITION BY symbol ORDER BY mean, hour) AS w FROM h)
SELECT symbol, hour, {sql.fx('mean', 5)} AS mean, {sql.fx('std', 5)} AS std, count, {sql.fx('mean/nullif(std, 0)', 5)} AS sharpe,
  CASE WHEN b <= 3 THEN b END AS best_rank, CASE WHEN w <= 3 THEN w END AS worst_rank FROM k""")
def pf_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return present(profile.hourly(full_bars(spark, sf)).drop("tf"), digits=5)


@query("pf_regime_dist", f"""{_R}, s AS (SELECT *, abs(close - lag(close, 50) OVER ({sql.W}))/nullif(atr, 0) AS strength FROM r)
SELECT symbol, {sql.fx('avg(CASE WHEN strength > 1.5 THEN 100.0::DOUBLE ELSE 0 END)', 4)} AS trending, {sql.fx('avg(CASE WHEN strength < 0.5 THEN 100.0::DOUBLE ELSE 0 END)', 4)} AS ranging,
  {sql.fx('100 - avg(CASE WHEN strength > 1.5 THEN 100.0::DOUBLE ELSE 0 END) - avg(CASE WHEN strength < 0.5 THEN 100.0::DOUBLE ELSE 0 END)', 4)} AS transitioning
FROM s WHERE strength IS NOT NULL GROUP BY symbol""")
def pf_regime_dist(spark: SparkSession, sf: str) -> DataFrame:
    def strength(df: DataFrame, w: WindowSpec) -> DataFrame:
        move = F.abs(F.col("close") - F.lag("close", 50).over(w))
        return df.withColumn("strength", F.when(F.col("ix") >= 74, F.try_divide(move, F.col("atr"))))
    return present(profile.regime_distribution(full_bars(spark, sf, strength)).drop("tf"), digits=4)


@query("pf_rsi_dist", f"""{_R} SELECT symbol, {sql.fx('avg(rsi)', 4)} AS mean, {sql.fx('stddev_samp(rsi)', 4)} AS std, {sql.fx('count(CASE WHEN rsi < 30 THEN 1 END)/count(*)*100', 4)} AS oversold_pct,
  {sql.fx('count(CASE WHEN rsi > 70 THEN 1 END)/count(*)*100', 4)} AS overbought_pct FROM r GROUP BY symbol""")
def pf_rsi_dist(spark: SparkSession, sf: str) -> DataFrame:
    return present(profile.rsi_distribution(full_bars(spark, sf)).drop("tf"), digits=4)


@query("pf_ma_perf", f"""{_R}, s AS (SELECT *, lead(close) OVER ({sql.W})/nullif(close, 0) - 1 AS fwd FROM r),
l AS (SELECT symbol, 'ma_9_21' AS pair, sign(ema_9 - ema_21)*fwd AS x FROM s UNION ALL SELECT symbol, 'ma_21_50', sign(ema_21 - ema_50)*fwd FROM s
  UNION ALL SELECT symbol, 'ma_50_200', sign(ema_50 - ema_200)*fwd FROM s)
SELECT symbol, pair, {sql.fx('sum(x)*100', 4)} AS total_return_pct, {sql.fx('avg(CASE WHEN x > 0 THEN 100.0::DOUBLE ELSE 0 END)', 4)} AS win_rate,
  {sql.fx('coalesce(avg(x)/nullif(stddev_samp(x), 0), 0)', 4)} AS sharpe, count(*) AS trades FROM l WHERE x IS NOT NULL GROUP BY symbol, pair""")
def pf_ma_perf(spark: SparkSession, sf: str) -> DataFrame:
    def forward(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("fwd_return", F.try_divide(F.lead("close", 1).over(w), F.col("close")) - 1)
    return present(profile.ma_performance(full_bars(spark, sf, forward, after=1)).drop("tf"), digits=4)


# --- trade log -------------------------------------------------------------------------------

NOW = "2001-07-31 12:00:00"
_LOG = """log AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS k, c_mktsegment AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS direction, o_totalprice AS entry,
  o_totalprice - CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END*(o_totalprice*0.01::DOUBLE) AS stop_loss,
  o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END*(o_totalprice*0.01::DOUBLE)*1.5::DOUBLE AS tp1, 50.0::DOUBLE + o_orderkey % 50 AS confidence, CAST(o_orderkey % 21 AS INTEGER) AS score,
  ['asia','london','new_york','overlap'][o_orderkey % 4 + 1] AS session, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'P' THEN 'loss' END AS result, CASE o_orderstatus WHEN 'F' THEN o_orderkey % 3 + 1 WHEN 'P' THEN -1 END::DOUBLE AS actual_rr,
  o_orderdate AS opened_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY END AS closed_at,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS strategy_used, CASE o_orderkey % 7 % 4 WHEN 0 THEN 'TRENDING' WHEN 1 THEN 'RANGING' WHEN 2 THEN 'QUIET' END AS regime_at_entry
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_CLOSED = f"cl AS (SELECT * FROM log WHERE status = 'closed' AND opened_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY)"


def _at() -> Column:
    return F.lit(NOW).cast("timestamp")



@query("ag_perf_30d", f"""WITH {_LOG}, {_CLOSED}
SELECT count(*) AS total_trades, count(CASE result WHEN 'win' THEN 1 END) AS wins, count(*) - count(CASE result WHEN 'win' THEN 1 END) AS losses,
  {sql.fx("count(CASE result WHEN 'win' THEN 1 END)*100.0/count(*)")} AS win_rate, {sql.fx("avg(CASE WHEN result = 'win' THEN nullif(actual_rr, 0) END)")} AS avg_rr,
  (SELECT session FROM cl WHERE result = 'win' GROUP BY session ORDER BY count(*) DESC, session LIMIT 1) AS best_session FROM cl""")
def ag_perf_30d(spark: SparkSession, sf: str) -> DataFrame:
    return present(tradelog.performance(tables.trade_log(spark, sf), _at()))


_DIM_COLUMNS = {"strategy": "strategy_used", "pair": "symbol", "regime": "regime_at_entry"}


def _dim_sql(label: str) -> str:
    c = _DIM_COLUMNS[label]
    keep = "" if label == "pair" else f"WHERE {c} IS NOT NULL"
    return f"""SELECT '{label}' AS dimension, {c} AS value, count(*) AS total, count(CASE result WHEN 'win' THEN 1 END) AS wins, count(*) - count(CASE result WHEN 'win' THEN 1 END) AS losses,
  {sql.fx("count(CASE result WHEN 'win' THEN 1 END)/count(*)*100")} AS win_rate FROM cl {keep} GROUP BY {c}"""


@query("ag_dim_stats", f"WITH {_LOG}, {_CLOSED} " + " UNION ALL ".join(_dim_sql(d) for d in _DIM_COLUMNS))
def ag_dim_stats(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.trade_log(spark, sf)
    parts = [
        tradelog.by_dimension(log, c, _at(), keep_null=label == "pair").select(F.lit(label).alias("dimension"), F.col(c).alias("value"), "total", "wins", "losses", "win_rate")
        for label, c in _DIM_COLUMNS.items()
    ]
    return present(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_O = "OVER (ORDER BY opened_at, id ROWS UNBOUNDED PRECEDING)"


@query("ag_max_drawdown", f"""WITH {_LOG}, g AS (SELECT *, sum(ln(CASE result WHEN 'win' THEN 1 + 0.01*abs(actual_rr) ELSE 0.99 END)) {_O} AS g FROM log WHERE status = 'closed'
  AND opened_at >= TIMESTAMP '{NOW}' - INTERVAL 400 DAY), p AS (SELECT *, greatest(max(g) {_O}, 0) AS peak FROM g)
SELECT {sql.fx('(1 - exp(-max(peak - g)))*100', 4)} AS max_drawdown, {sql.fx('(1 - exp(arg_max(g - peak, (opened_at, id))))*100', 4)} AS current_drawdown, {sql.fx('exp(max(peak))*10000', 4)} AS peak_equity FROM p""")
def ag_max_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return present(tradelog.drawdown(tables.trade_log(spark, sf), _at(), days=400), digits=4)


_REC = ("symbol", "direction", "~entry", "~stop_loss", "~tp1", "status", "result", "@opened_at", "@closed_at", "strategy_used", "~confidence", "score")


@query("ag_open_trades", f"WITH {_LOG} SELECT {sql.out('id', *_REC, digits=4)} FROM log WHERE status = 'open'")
def ag_open_trades(spark: SparkSession, sf: str) -> DataFrame:
    return present(tradelog.open_trades(tables.trade_log(spark, sf)), "id", *tradelog.RECENT_COLUMNS, digits=4)


@query("ag_recent_trades", f"WITH {_LOG} SELECT {sql.out('id', *_REC, digits=4)} FROM log ORDER BY opened_at DESC, id LIMIT 10")
def ag_recent_trades(spark: SparkSession, sf: str) -> DataFrame:
    return present(tradelog.recent_trades(tables.trade_log(spark, sf)), digits=4)


@query("ag_trades_today", f"""WITH {_LOG}, d AS (SELECT * FROM log WHERE CAST(opened_at AS DATE) = DATE '1999-03-15')
SELECT session, count(*) AS trades FROM d GROUP BY session UNION ALL SELECT 'ALL', count(*) FROM d""")
def ag_trades_today(spark: SparkSession, sf: str) -> DataFrame:
    return present(tradelog.trades_on(tables.trade_log(spark, sf), F.lit("1999-03-15").cast("date")))




@query("tl_upsert", f"""WITH {_LOG}, u AS (SELECT * FROM log WHERE status = 'closed')
SELECT id, symbol, 'closed' AS status, result, {sql.fx('actual_rr')} AS actual_rr, {sql.tx('opened_at')} AS opened_at FROM u
UNION ALL SELECT id, symbol, status, result, NULL, {sql.tx('opened_at')} FROM log WHERE status = 'open'""")
def tl_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade is first written as open; closed ones come again with a higher version."""
    log = tables.trade_log(spark, sf)
    first = log.withColumns({
        "status": F.lit("open"), "result": F.lit(None).cast("string"), "actual_rr": F.lit(None).cast("double"), "version": F.lit(1),
    })
    later = log.filter(F.col("status") == "closed").withColumn("version", F.lit(2))
    return present(tradelog.upsert(first, later), "id", "symbol", "status", "result", "actual_rr", "opened_at")


@query("tl_changes", f"""WITH {_LOG} SELECT id, status, result, {sql.fx('actual_rr')} AS actual_rr FROM log""")
def tl_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Column updates by id: a full outer join that also adds unknown ids."""
    log = tables.trade_log(spark, sf)
    known = log.filter(F.col("status") == "open").select("id", "status", "result", "actual_rr")
    changes = log.filter(F.col("status") == "closed").select("id", "status", "result", "actual_rr")
    return present(tradelog.apply_changes(known, changes, ["status", "result", "actual_rr"]))


@query("tl_monitor", f"""WITH {sql.event_bars('1h')}, {_FB_LIVE}, px AS (SELECT event_type AS symbol, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY event_type),
t AS (SELECT f.*, p.price, CASE direction WHEN 'buy' THEN 1 ELSE -1 END AS sg FROM fb f JOIN px p ON p.symbol = f.symbol),
m AS (SELECT *, CASE WHEN sg*(price - tp1) >= 0 THEN 1 WHEN sg*(price - tp2) >= 0 THEN 2 WHEN sg*(price - tp3) >= 0 THEN 3 END AS new_tp, sg*(price - stop_loss) <= 0 AS stopped FROM t)
SELECT symbol, ix, direction, new_tp, CASE WHEN stopped THEN 'closed' ELSE 'open' END AS status, CASE WHEN stopped THEN 'loss' END AS result,
  {sql.fx('CASE WHEN stopped THEN -1.0 END')} AS actual_rr, CASE WHEN new_tp = 1 THEN 1 ELSE 0 END AS be_moved FROM m""")
def tl_monitor(spark: SparkSession, sf: str) -> DataFrame:
    fresh = fb_setups(spark, sf).withColumns({**{f"tp{k}_hit": F.lit(0) for k in (1, 2, 3)}, "be_moved": F.lit(0)})
    out = tradelog.monitor(fresh, tables.ticks(spark, sf), tie=["event_id"])
    return present(out, "symbol", "ix", "direction", "new_tp", "status", "result", "actual_rr", "be_moved")


def _pass(k: int, src: str) -> str:
    """CTE with the first close after ``since_ix`` beyond target k or the stop of trades at level k - 1, and what it does."""
    stop = "stop_loss" if k == 1 else "entry"
    return f"""h{k} AS (SELECT s.*, CASE WHEN level = {k - 1} AND closed_ix IS NULL THEN (SELECT min(b.ix) FROM bars b WHERE b.symbol = s.symbol AND b.ix > s.since_ix
    AND (s.sg*(b.close - s.tp{k}) >= 0 OR s.sg*(b.close - s.{stop}) <= 0)) END AS hit FROM {src} s),
p{k} AS (SELECT h.* EXCLUDE (since_ix, level, closed_ix, hit), coalesce(hit, since_ix) AS since_ix, CASE WHEN sg*(b.close - tp{k}) >= 0 THEN {k} ELSE level END AS level,
    CASE WHEN hit IS NOT NULL AND ({k} = 3 OR sg*(b.close - tp{k}) < 0) THEN hit ELSE closed_ix END AS closed_ix FROM h{k} h LEFT JOIN bars b ON b.symbol = h.symbol AND b.ix = h.hit)"""


@query("tl_monitor_path", f"""WITH {sql.event_bars('1h')}, {_FB_LIVE},
p0 AS (SELECT symbol, ix, direction, entry, stop_loss, tp1, tp2, tp3, CASE direction WHEN 'buy' THEN 1 ELSE -1 END AS sg, ix AS since_ix, 0 AS level, CAST(NULL AS BIGINT) AS closed_ix FROM fb),
{_pass(1, 'p0')}, {_pass(2, 'p1')}, {_pass(3, 'p2')}
SELECT symbol, ix, direction, level, closed_ix, CASE WHEN closed_ix IS NULL THEN 'open' ELSE 'closed' END AS status, CASE WHEN closed_ix IS NOT NULL THEN CASE WHEN level > 0 THEN 'win' ELSE 'loss' END END AS result,
  {sql.fx('CASE WHEN level = 3 THEN abs(tp3 - entry)/nullif(abs(entry - stop_loss), 0) WHEN closed_ix IS NOT NULL THEN CASE WHEN level > 0 THEN 0.0 ELSE -1.0 END END')} AS actual_rr FROM p3""")
def tl_monitor_path(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade followed through all later closes: targets in turn, the moved stop, and how it ended."""
    prices = cut(tables.indexed(spark, sf).select("symbol", "tf", "ix", F.col("close").alias("price")))
    out = tradelog.monitor_path(cut(fb_setups(spark, sf)), prices)
    return present(out, "symbol", "ix", "direction", "level", "closed_ix", "status", "result", "actual_rr")


# --- two sources -----------------------------------------------------------------------------

_HALF = f"""{sql.event_bars('1d', 'da', 'event_id % 2 = 0')}, {sql.event_bars('1d', 'db', 'event_id % 2 = 1')}, {sql.event_bars('1h', 'hb', 'event_id % 2 = 1')},
syms AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'nowhere'),
a1 AS (SELECT symbol, count(*) AS a_rows, min(ts) AS a_from, max(ts) AS a_to FROM da GROUP BY symbol), b1 AS (SELECT symbol, count(*) AS b_rows FROM hb GROUP BY symbol),
c1 AS (SELECT da.symbol, count(*) AS common_days, avg(abs(da.close - db.close)/nullif(db.close, 0)*100) AS avg_diff_pct, max(abs(da.close - db.close)/nullif(db.close, 0)*100) AS max_diff_pct
  FROM da JOIN db ON da.symbol = db.symbol AND da.ts = db.ts GROUP BY da.symbol),
xv AS (SELECT s.symbol, a_rows, b_rows, strftime(a_from, '%Y-%m-%d') AS a_from, strftime(a_to, '%Y-%m-%d') AS a_to, common_days, avg_diff_pct, max_diff_pct,
  CASE WHEN a_rows IS NULL OR b_rows IS NULL THEN 'INCOMPLETE_DATA' WHEN common_days IS NULL THEN 'NO_OVERLAP' WHEN avg_diff_pct < 0.1 THEN 'PASS' WHEN avg_diff_pct < 0.5 THEN 'WARNING' ELSE 'FAIL' END AS status
  FROM syms s LEFT JOIN a1 ON a1.symbol = s.symbol LEFT JOIN b1 ON b1.symbol = s.symbol LEFT JOIN c1 ON c1.symbol = s.symbol)"""


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    ticks = tables.ticks(spark, sf)
    daily = bars_from_ticks(ticks.filter(F.col("event_id") % 2 == 0), "1d", tie=["event_id"])
    hourly = bars_from_ticks(ticks.filter(F.col("event_id") % 2 == 1), "1h", tie=["event_id"])
    symbols = ticks.select("symbol").distinct().unionByName(spark.range(1).select(F.lit("nowhere").alias("symbol")))
    return quality.cross_validate(symbols, daily, hourly)


@query("xval_sources", f"WITH {_HALF} SELECT symbol, a_rows, b_rows, a_from, a_to, common_days, {sql.fx('avg_diff_pct')} AS avg_diff_pct, {sql.fx('max_diff_pct')} AS max_diff_pct, status FROM xv")
def xval_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with even numbers as the daily source, the others as the hourly one."""
    return present(_validated(spark, sf), "symbol", "a_rows", "b_rows", "a_from", "a_to", "common_days", "avg_diff_pct", "max_diff_pct", "status")


@query("xval_report", f"WITH {_HALF} SELECT CASE WHEN status IN ('PASS', 'WARNING', 'FAIL') THEN status ELSE 'INCOMPLETE' END AS status, count(*) AS symbols FROM xv GROUP BY 1")
def xval_report(spark: SparkSession, sf: str) -> DataFrame:
    return present(quality.status_report(_validated(spark, sf)))


