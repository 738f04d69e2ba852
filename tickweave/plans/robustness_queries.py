"""Queries on regimes of trades, folds, stress, resampling and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators import indicators as ind
from tickweave.operators import regime, robustness, stats
from tickweave.operators.frames import block_of, in_frames
from tickweave.plans import research, sql
from tickweave.plans.catalogue import present, query
from tickweave.plans.trade_queries import FB_DAILY, GAPS, fb_daily, gap_sql
from tickweave.plans.zone_queries import RESEARCH_REGIME
from tickweave.session import cut
from tickweave.sources import tables

SIMS, REMOVALS = 10000, 1000
_BY = ["symbol"]


def regimes_daily(bars: DataFrame) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return regime.add_research_regime(ind.add_atr_sma(df, w), w)
    return in_frames(bars, build, before=80)


def tagged(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    bars = tables.indexed_daily(spark, sf) if bars is None else bars
    return regime.as_of(fb_daily(spark, sf, bars), regimes_daily(bars))


# Trades happen at any time of the day and regimes come from 4-hour bars, so most lookups fall between bars; none starts inside a 4-hour slot.
_ASOF = f"""{sql.event_bars('4h')}, {sql.atr_sma()}, {RESEARCH_REGIME},
tk AS (SELECT event_id, event_type AS symbol, ts FROM events)"""


@query("rg_asof", f"""WITH {_ASOF} SELECT t.event_id, t.symbol, {sql.tx('t.ts')} AS ts, coalesce(r.regime, 'UNKNOWN') AS regime FROM tk t
ASOF LEFT JOIN reg r ON r.symbol = t.symbol AND r.ts <= t.ts""")
def rg_asof(spark: SparkSession, sf: str) -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return regime.add_research_regime(ind.add_atr_sma(df, w), w)
    bars = in_frames(tables.indexed(spark, sf, "4h"), build, before=80)
    ticks = tables.ticks(spark, sf).select(F.col("event_id"), "symbol", F.lit("4h").alias("tf"), "ts")
    return present(regime.as_of_slots(ticks, bars, 4 * 3600), "event_id", "symbol", "ts", "regime")


@query("rg_asof_midnight", f"""WITH {sql.event_bars('4h')}, {sql.atr_sma()}, {RESEARCH_REGIME}, tk AS (SELECT event_id, event_type AS symbol, ts, date_trunc('day', ts) AS day FROM events)
SELECT t.event_id, coalesce(r.regime, 'UNKNOWN') AS regime FROM tk t ASOF LEFT JOIN reg r ON r.symbol = t.symbol AND r.ts <= t.day""")
def rg_asof_midnight(spark: SparkSession, sf: str) -> DataFrame:
    """The published rule looks up midnight of the day, so trades within a day see the day before."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return regime.add_research_regime(ind.add_atr_sma(df, w), w)
    bars = in_frames(tables.indexed(spark, sf, "4h"), build, before=80)
    ticks = tables.ticks(spark, sf).select("event_id", "symbol", F.lit("4h").alias("tf"), "ts")
    return present(regime.as_of_slots(ticks, bars, 86400, at=F.date_trunc("day", "ts")), "event_id", "regime")


TAGGED = f"{FB_DAILY}, {RESEARCH_REGIME}, tg AS (SELECT t.*, r.regime FROM trades t JOIN reg r ON r.symbol = t.symbol AND r.ix = t.ix)"
_PLAIN = ("total_trades", "wins", "losses", "~pf", "~wr", "~avg_r", "~sharpe", "~gross_profit", "~gross_loss")


@query("rg_stats", f"WITH {TAGGED}, {sql.stats('tg', 'symbol, regime')} SELECT {sql.out('symbol', 'regime', *_PLAIN)} FROM st WHERE total_trades >= 5")
def rg_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.plain_stats(tagged(spark, sf), ["symbol", "regime"]).filter(F.col("total_trades") >= 5)
    return present(out)


@query("rg_composition", f"WITH {TAGGED} SELECT regime, count(*) AS trades FROM tg GROUP BY regime")
def rg_composition(spark: SparkSession, sf: str) -> DataFrame:
    return present(regime.composition(tagged(spark, sf)))


# --- grid, folds, stress ---------------------------------------------------------------------

_GRID = f"""{sql.daily_bars()}, {sql.pairs()}, {sql.atr_sma()}, {GAPS}, pg(min_gap) AS (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)),
ps(sl_atr) AS (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE)), ph(max_hold) AS (VALUES (3), (5), (10)),
k0 AS (SELECT m.*, min_gap FROM m JOIN pg ON gap_atr >= min_gap QUALIFY row_number() OVER (PARTITION BY symbol, friday_ix, min_gap ORDER BY ix) = 1),
k AS (SELECT k0.*, sl_atr, max_hold FROM k0 CROSS JOIN ps CROSS JOIN ph), {gap_sql('k', 'max_hold', 'sl_atr', by='min_gap, sl_atr, max_hold')},
{sql.stats('gt', 'symbol, min_gap, sl_atr, max_hold', order='ix', periods='52.0')}"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    trades = research.gap_grid_trades(tables.indexed_daily(spark, sf), tables.stand_in_pairs(spark))
    by = ["symbol", "min_gap", "sl_atr", "max_hold"]
    return stats.trade_stats(trades, by, order=("ix",), periods=stats.WEEKS)


@query("rb_grid_sweep", f"WITH {_GRID} SELECT {sql.out('symbol', '~min_gap', '~sl_atr', 'max_hold', *sql.STATS_OUT)} FROM st WHERE total_trades >= 10")
def rb_grid_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return present(_grid(spark, sf).filter(F.col("total_trades") >= 10))


@query("rb_grid_best", f"""WITH {_GRID} SELECT {sql.out('symbol', '~min_gap', '~sl_atr', 'max_hold', '~pf')} FROM st WHERE total_trades >= 10
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {sql.fx('pf', 9)} DESC NULLS LAST, min_gap, sl_atr, max_hold) <= 5""")
def rb_grid_best(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from tickweave.functions.numbers import fix
    grid = _grid(spark, sf).filter(F.col("total_trades") >= 10)
    order = Window.partitionBy("symbol").orderBy(fix(F.col("pf"), 9).desc_nulls_last(), "min_gap", "sl_atr", "max_hold")
    best = grid.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 5)
    return present(best, "symbol", "min_gap", "sl_atr", "max_hold", "pf")


@query("rb_walk_forward", f"""WITH {FB_DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS no, count(*) OVER (PARTITION BY symbol) // 6 AS size FROM trades),
f AS (SELECT *, no // size AS fold FROM n WHERE no // size <= 5), {sql.stats('f', 'symbol, fold')}
SELECT a.symbol, CAST(a.fold + 1 AS BIGINT) AS fold, a.total_trades AS train_trades, b.total_trades AS test_trades, {sql.fx('a.pf')} AS train_pf, {sql.fx('a.wr')} AS train_wr, {sql.fx('b.pf')} AS test_pf,
  {sql.fx('b.wr')} AS test_wr, {sql.fx('b.avg_r')} AS test_avg_r, {sql.fx('b.pf/nullif(a.pf, 0)')} AS degradation FROM st a JOIN st b ON a.symbol = b.symbol AND b.fold = a.fold + 1""")
def rb_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.walk_forward(cut(fb_daily(spark, sf)), _BY, ["ts"], block_of()))


FOLDS = (("Fold 1", "1999-01-01", "1999-12-31"), ("Fold 2", "1999-07-01", "2000-12-31"))
_FOLD_SQL = sql.values(list(FOLDS), "fo", "fold, a, b")


@query("rb_date_folds", f"""WITH {FB_DAILY}, {_FOLD_SQL}, f AS (SELECT t.*, fold FROM trades t JOIN fo ON t.ts >= CAST(a AS TIMESTAMP) AND t.ts < CAST(b AS TIMESTAMP) + INTERVAL 1 DAY), {sql.stats('f', 'symbol, fold')}
SELECT {sql.out('symbol', 'fold', *_PLAIN)} FROM st""")
def rb_date_folds(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.date_folds(fb_daily(spark, sf), FOLDS, _BY))


@query("rb_spread_stress", f"""WITH {FB_DAILY}, mu(mult) AS (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)),
s AS (SELECT t.symbol, t.ts, mult, net_pnl_r - p.spread_pips*p.pip_size*(mult - 1)/risk AS x FROM trades t JOIN pairs p ON p.symbol = t.symbol CROSS JOIN mu), {sql.stats('s', 'symbol, mult', pnl='x')}
SELECT {sql.out('symbol', '~mult', *_PLAIN)} FROM st""")
def rb_spread_stress(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.spread_stress(fb_daily(spark, sf), _BY))


# --- resampling ------------------------------------------------------------------------------

def _draws(sims: int, where: str = "net_pnl_r IS NOT NULL", least: int = 10, src: str = "trades", name: str = "dz") -> str:
    """CTEs with one row for each trade and replicate and its random number z; the arithmetic of ``robustness.draw_number``."""
    p = robustness.PRIME
    key = f"('0x' || substr(md5('42|' || symbol || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || no), 1, 8))::BIGINT % {p - 1} + 1"
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY net_pnl_r) AS no FROM {src} WHERE {where}),
{name}_t AS (SELECT symbol, ts, no, net_pnl_r AS x, {key} AS a, count(*) OVER (PARTITION BY symbol) AS n FROM {name}_o),
{name}_r AS (SELECT rep, (b*b + rep + 1) % {p} AS b FROM (SELECT range AS rep, (range + 1)*48271 % {p} AS b FROM range({sims}))),
{name}_x AS (SELECT symbol, ts, no, x, n, rep, a, b, (a*b % {p})*(a*b % {p}) AS xx FROM {name}_t CROSS JOIN {name}_r WHERE n >= {least}),
{name} AS (SELECT symbol, ts, no, x, n, rep, (((xx + a) % {p})*((xx + a) % {p}) + b) % {p} AS z FROM {name}_x)"""


_WEIGHT = " + ".join(f"CAST(z >= {t} AS INTEGER)" for t in robustness.OCCURRENCES)
_BOOT = f"""{_draws(SIMS, name='bz')}, bw AS (SELECT *, CAST({_WEIGHT} AS DOUBLE) AS w FROM bz),
bs AS (SELECT symbol, rep, sum(w*greatest(x, 0.0)) AS win, sum(w*greatest(-x, 0.0)) AS loss, sum(w*x) AS total, sum(CASE WHEN x > 0 THEN w ELSE 0 END) AS wins, sum(w) AS size FROM bw GROUP BY symbol, rep),
bp AS (SELECT symbol, CASE WHEN loss > 0 THEN win/loss ELSE 10.0 END AS pf, total/nullif(size, 0) AS avg_r, wins/nullif(size, 0) AS wr FROM bs WHERE size > 0),
boot AS (SELECT symbol, count(*) AS n_simulations, avg(pf) AS pf_mean, quantile_cont(pf, 0.5) AS pf_median, quantile_cont(pf, 0.01) AS pf_p1, quantile_cont(pf, 0.05) AS pf_p5,
  quantile_cont(pf, 0.95) AS pf_p95, quantile_cont(pf, 0.99) AS pf_p99, avg(CASE WHEN pf < 1 THEN 1.0 ELSE 0.0 END)*100 AS pf_below_1_pct, avg(avg_r) AS avg_r_mean,
  quantile_cont(avg_r, 0.05) AS avg_r_p5, quantile_cont(avg_r, 0.95) AS avg_r_p95, avg(wr) AS wr_mean, quantile_cont(wr, 0.05) AS wr_p5 FROM bp GROUP BY symbol)"""
_PERM = f"""{_draws(SIMS, name='pz')}, pc AS (SELECT symbol, rep, sum(ln(1 + x*0.01)) OVER (PARTITION BY symbol, rep ORDER BY z, ts, no ROWS UNBOUNDED PRECEDING) AS cum,
  row_number() OVER (PARTITION BY symbol, rep ORDER BY z, ts, no) AS k, n FROM pz),
pk AS (SELECT *, greatest(0.0, max(cum) OVER (PARTITION BY symbol, rep ORDER BY k ROWS UNBOUNDED PRECEDING)) AS peak FROM pc),
pd AS (SELECT symbol, rep, exp(max(CASE WHEN k = n THEN cum END))*1000.0 AS money, (1 - exp(-max(peak - cum)))*100 AS dd FROM pk GROUP BY symbol, rep),
perm AS (SELECT symbol, count(*) AS n_simulations, 0.0 AS prob_ruin, avg(money) AS mean_final, quantile_cont(money, 0.5) AS median_final, quantile_cont(money, 0.05) AS p5_final,
  quantile_cont(money, 0.95) AS p95_final, avg(dd) AS mean_max_dd_pct, quantile_cont(dd, 0.95) AS p95_max_dd_pct, quantile_cont(dd, 0.99) AS p99_max_dd_pct,
  avg(CASE WHEN money > 1000 THEN 1.0 ELSE 0.0 END)*100 AS still_profitable_pct FROM pd GROUP BY symbol)"""
_REMOVE = f"""{_draws(REMOVALS, 'net_pnl_r > 0', 1, name='rz')}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, rep ORDER BY z, ts, no) AS k FROM rz), sh(share) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)),
rg AS (SELECT symbol, share, rep, max(greatest(1, CAST(floor(n*share) AS BIGINT))) AS n_removed, sum(CASE WHEN k <= greatest(1, floor(n*share)) THEN x END) AS gone FROM rk CROSS JOIN sh GROUP BY symbol, share, rep),
rt AS (SELECT symbol, sum(greatest(net_pnl_r, 0.0)) AS w, sum(greatest(-net_pnl_r, 0.0)) AS l FROM trades GROUP BY symbol),
rp AS (SELECT symbol, share, n_removed, CASE WHEN l > 0 THEN (w - gone)/l ELSE 0.0 END AS pf FROM rg JOIN rt USING (symbol)),
gone AS (SELECT symbol, share, avg(pf) AS mean_pf, quantile_cont(pf, 0.5) AS median_pf, quantile_cont(pf, 0.05) AS p5_pf, avg(CASE WHEN pf < 1 THEN 1.0 ELSE 0.0 END)*100 AS pf_below_1_pct,
  min(n_removed) AS n_removed FROM rp GROUP BY symbol, share)"""
_BOOT_OUT = ("n_simulations", *(f"~{c}" for c in ("pf_mean", "pf_median", "pf_p1", "pf_p5", "pf_p95", "pf_p99", "pf_below_1_pct", "avg_r_mean", "avg_r_p5", "avg_r_p95", "wr_mean", "wr_p5")))
_PERM_OUT = ("n_simulations", *(f"~{c}" for c in ("prob_ruin", "mean_final", "median_final", "p5_final", "p95_final", "mean_max_dd_pct", "p95_max_dd_pct", "p99_max_dd_pct", "still_profitable_pct")))


@query("rb_bootstrap", f"WITH {FB_DAILY}, {_BOOT} SELECT {sql.out('symbol', *_BOOT_OUT)} FROM boot")
def rb_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.bootstrap(cut(fb_daily(spark, sf)), _BY, ["ts"], sims=SIMS))


@query("rb_permutation_dd", f"WITH {FB_DAILY}, {_PERM} SELECT {sql.out('symbol', *_PERM_OUT)} FROM perm")
def rb_permutation_dd(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.permutation_drawdown(cut(fb_daily(spark, sf)), _BY, ["ts"], sims=SIMS))


@query("rb_trade_removal", f"WITH {FB_DAILY}, {_REMOVE} SELECT {sql.out('symbol', '~share', '~mean_pf', '~median_pf', '~p5_pf', '~pf_below_1_pct', 'n_removed')} FROM gone")
def rb_trade_removal(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.trade_removal(cut(fb_daily(spark, sf)), _BY, ["ts"], sims=REMOVALS))


def _long(src: str, test: str, *metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT symbol, {test} AS test, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {src}" for m in metrics)


_SHORT = ("total_trades", "pf", "wr", "avg_r")
_SUITE = f"""{TAGGED}, {sql.stats('tg', 'symbol', name='s_all')}, yr AS (SELECT *, year(ts) AS y FROM tg), {sql.stats('yr', 'symbol, y', name='s_year')},
wn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS no, count(*) OVER (PARTITION BY symbol) AS held FROM tg),
wf AS (SELECT *, no // (held // 6) AS fold FROM wn WHERE held >= 20 AND no // (held // 6) <= 5), {sql.stats('wf', 'symbol, fold', name='s_fold')},
wo AS (SELECT a.symbol, CAST(a.fold + 1 AS BIGINT) AS fold, a.pf AS train_pf, b.pf AS test_pf, b.pf/nullif(a.pf, 0) AS degradation FROM s_fold a JOIN s_fold b ON a.symbol = b.symbol AND b.fold = a.fold + 1
  WHERE a.total_trades >= 5 AND b.total_trades >= 5), mu(mult) AS (VALUES (1), (2), (3), (5)),
st AS (SELECT t.symbol, t.ts, mult, net_pnl_r - coalesce(p.spread_pips*p.pip_size*(mult - 1)/nullif(risk, 0), 0) AS x FROM tg t JOIN pairs p ON p.symbol = t.symbol CROSS JOIN mu), {sql.stats('st', 'symbol, mult', pnl='x', name='s_mult')},
{sql.stats('tg', 'symbol, regime', name='s_regime')}, {sql.stats('tg', 'symbol, direction', name='s_side')}, {_PERM}, {_BOOT}, {_REMOVE},
suite AS ({_long('s_all', "'baseline'", 'total_trades', 'pf', 'wr', 'avg_r', 'mdd_r', 'sharpe')} UNION ALL {_long('s_year', "'year:' || y", *_SHORT)}
  UNION ALL {_long('wo', "'walk_forward:' || fold", 'train_pf', 'test_pf', 'degradation')} UNION ALL {_long('s_mult', "'spread:' || mult", *_SHORT)}
  UNION ALL {_long('perm', "'permutation'", 'prob_ruin', 'mean_max_dd_pct', 'p95_max_dd_pct', 'p99_max_dd_pct', 'median_final')}
  UNION ALL {_long('boot', "'bootstrap'", 'pf_mean', 'pf_p5', 'pf_p95', 'pf_below_1_pct', 'avg_r_mean')}
  UNION ALL {_long('gone', "'removal:' || CAST(round(share*100) AS INTEGER)", 'mean_pf', 'p5_pf', 'pf_below_1_pct', 'n_removed')}
  UNION ALL {_long('s_regime', "'regime:' || regime", *_SHORT)} UNION ALL {_long('s_side', "'direction:' || direction", *_SHORT)})"""


def _suite(spark: SparkSession, sf: str) -> DataFrame:
    return robustness.suite(cut(tagged(spark, sf)), _BY, slice_expr=block_of(), sims=SIMS, removal_sims=REMOVALS)


@query("rb_suite", f"WITH {_SUITE} SELECT {sql.out('symbol', 'test', 'metric', '~value')} FROM suite")
def rb_suite(spark: SparkSession, sf: str) -> DataFrame:
    return present(_suite(spark, sf))


def _pick(test: str, metric: str) -> str:
    return f"max(CASE WHEN test = '{test}' AND metric = '{metric}' THEN value END)"


@query("rb_verdict", f"""WITH {_SUITE}, fg AS (SELECT symbol, {_pick('baseline', 'pf')} AS pf, min(CASE WHEN test LIKE 'walk_forward:%' AND metric = 'test_pf' THEN value END) AS wf_min,
  avg(CASE WHEN test LIKE 'walk_forward:%' AND metric = 'test_pf' THEN value END) AS wf_avg, {_pick('spread:3', 'pf')} AS s3, {_pick('permutation', 'prob_ruin')} AS ruin,
  {_pick('permutation', 'p95_max_dd_pct')} AS dd, {_pick('bootstrap', 'pf_p5')} AS p5, {_pick('removal:10', 'pf_below_1_pct')} AS rem FROM suite GROUP BY symbol),
ck AS (SELECT symbol, coalesce(pf > 1.2, false) AS a, coalesce(wf_min > 1.0 AND wf_avg > 1.0, false) AS b, coalesce(s3 > 1.0, false) AS c, coalesce(ruin < 0.05 AND dd < 30, false) AS d,
  coalesce(p5 > 0.9, false) AS e, coalesce(rem < 50, false) AS f FROM fg),
vd AS (SELECT symbol, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) + CAST(f AS INTEGER) AS score,
  concat_ws(', ', CASE WHEN a THEN 'PF>1.2' ELSE 'PF<=1.2' END, CASE WHEN b THEN 'WF+' ELSE 'WF-' END, CASE WHEN c THEN 'Spread+' ELSE 'Spread-' END, CASE WHEN d THEN 'MC+' ELSE 'MC-' END,
    CASE WHEN e THEN 'Bootstrap+' ELSE 'Bootstrap-' END, CASE WHEN f THEN 'Removal+' ELSE 'Removal-' END) AS details FROM ck)
SELECT symbol, score, details, CASE WHEN score >= 5 THEN 'PASS' WHEN score >= 3 THEN 'MARGINAL' ELSE 'FAIL' END || ' (' || score || '/6): ' || details AS verdict FROM vd""")
def rb_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return present(robustness.verdict(_suite(spark, sf), _BY))


# --- two strategies --------------------------------------------------------------------------

_TOP, _LOW = sql.prev_extreme("max(high)", 10), sql.prev_extreme("min(low)", 10)
_SMC = f"""sp0 AS (SELECT *, high > {_TOP} AND close > {_TOP} AS up, low < {_LOW} AND close < {_LOW} AS down, max(ix) OVER (PARTITION BY symbol) AS nix FROM reg),
sp AS (SELECT * REPLACE (coalesce(atr, close*0.005) AS atr), 1 AS signal FROM sp0 WHERE up AND regime IN ('TRENDING', 'HIGH_VOL', 'MIXED') AND ix <= nix - 3
  UNION ALL SELECT * REPLACE (coalesce(atr, close*0.005) AS atr), -1 AS signal FROM sp0 WHERE down AND regime IN ('TRENDING', 'HIGH_VOL', 'MIXED') AND ix <= nix - 3),
{sql.barrier_trades('sp', name='smc', warm_up=25, by='regime')}"""


def smc_daily(spark: SparkSession, sf: str, bars: DataFrame | None = None) -> DataFrame:
    return research.smc_proxy_trades(tables.indexed_daily(spark, sf) if bars is None else bars, tables.stand_in_pairs(spark))


@query("sig_smc_proxy", f"WITH {TAGGED}, {_SMC} SELECT symbol, {sql.tx('ts')} AS ts, direction, regime, exit_reason, {sql.out('~entry_price', '~net_pnl_r')} FROM smc")
def sig_smc_proxy(spark: SparkSession, sf: str) -> DataFrame:
    return present(smc_daily(spark, sf), "symbol", "ts", "direction", "regime", "exit_reason", "entry_price", "net_pnl_r")


@query("rb_overlap", f"""WITH {TAGGED}, {_SMC}, fa AS (SELECT symbol, date_trunc('month', ts) AS day, direction FROM trades), sa AS (SELECT symbol, date_trunc('month', ts) AS day, direction FROM smc)
SELECT f.symbol, strftime(f.day, '%Y-%m-%d') AS day, count(CASE WHEN f.direction <> s.direction THEN 1 END) AS conflicts FROM fa f JOIN sa s ON f.symbol = s.symbol AND f.day = s.day GROUP BY f.symbol, f.day""")
def rb_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Daily series rarely trade twice a day, so trades are compared by month here."""
    month, bars = F.date_trunc("month", "ts"), tables.indexed_daily(spark, sf)
    days = robustness.overlaps(fb_daily(spark, sf, bars).withColumn("ts", month), smc_daily(spark, sf, bars).withColumn("ts", month))
    return present(days, "symbol", "day", "conflicts")


@query("rb_overlap_summary", f"""WITH {TAGGED}, {_SMC}, fa AS (SELECT symbol, CAST(ts AS DATE) AS day, direction FROM trades), sa AS (SELECT symbol, CAST(ts AS DATE) AS day, direction FROM smc),
d AS (SELECT f.symbol, f.day, count(CASE WHEN f.direction <> s.direction THEN 1 END) AS c FROM fa f JOIN sa s ON f.symbol = s.symbol AND f.day = s.day GROUP BY f.symbol, f.day)
SELECT CAST(sum(c) AS BIGINT) AS conflict_count, count(*) AS common_days, {sql.fx('sum(c)*100.0/count(*)')} AS conflict_pct FROM d""")
def rb_overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    bars = tables.indexed_daily(spark, sf)
    return present(robustness.overlap_summary(robustness.overlaps(fb_daily(spark, sf, bars), smc_daily(spark, sf, bars))))


@query("rb_regime_portfolio", f"""WITH {TAGGED}, {_SMC}, po AS (SELECT 'portfolio' AS name, symbol, ts, ix, direction, 'false_breakout' AS source, net_pnl_r FROM tg WHERE regime IN ('RANGING', 'LOW_VOL', 'MIXED')
  UNION ALL SELECT 'portfolio', symbol, ts, ix, direction, 'smc_proxy', net_pnl_r FROM smc WHERE regime IN ('TRENDING', 'HIGH_VOL')),
{sql.stats('po', 'name', order='source, symbol, ix, direction')}, sh AS (SELECT count(CASE source WHEN 'false_breakout' THEN 1 END)/count(*)*100 AS fb_share FROM po)
SELECT {sql.out(*sql.STATS_OUT)}, {sql.fx('fb_share')} AS fb_share FROM st CROSS JOIN sh""")
def rb_regime_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """One account over both strategies, first all false breakouts, then all breakouts, symbol by symbol."""
    bars = tables.indexed_daily(spark, sf)
    both = cut(robustness.regime_portfolio(tagged(spark, sf, bars), smc_daily(spark, sf, bars))).withColumn("name", F.lit("portfolio"))
    out = stats.trade_stats(both, ["name"], order=("source", "symbol", "ix", "direction"))
    share = both.agg((F.avg((F.col("source") == "false_breakout").cast("double")) * 100).alias("fb_share"), F.lit("portfolio").alias("name"))
    return present(out.join(share, "name").drop("name"))
