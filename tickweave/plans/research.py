"""Composed plans: bars to labelled trades, shared by the queries and by users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators import greedy, labels, regime, risk, signals
from tickweave.operators import indicators as ind
from tickweave.operators.crossing import first_cross
from tickweave.operators.frames import BLOCK_ROWS, in_frames


def false_breakout_trades(
    bars: DataFrame, pairs: DataFrame, lookback: int = 10, entry_lag: int = 1, max_hold: int = 24,
    warm_up: int = 15, close_exit_at: str = "entry", ewm_atr: bool = False, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Indexed bars to false-breakout trades with gross and net results, in one exchange.

    ``entry_lag`` 1 enters at the bar after the break although the signal needs the bar after that;
    3 enters only once the signal is known.
    """
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_core(df, w, ()) if ewm_atr else ind.add_atr_sma(df, w)
        df = df.withColumn("signal", signals.false_breakout(lookback)(w))
        return labels.add_entry(df, w, entry_lag, max_hold)

    before = ind.core_margin(()) if ewm_atr else max(lookback, 15)
    framed = in_frames(bars, build, before=before, after=entry_lag + max_hold, rows=rows)
    trades = labels.barrier_trades(framed, warm_up=warm_up, close_exit_at=close_exit_at)
    trades = trades.withColumns({"strategy": F.lit("false_breakout"), "available_ix": F.col("ix") + 2})
    return labels.net_of_costs(risk.with_costs(trades, pairs), F.col("cost_pips"))


def strategy_trades(
    bars: DataFrame, strategies: dict, pairs: DataFrame | None = None, entry_lag: int = 1, max_hold: int = 24,
    rr: float = 1.5, rows: int = BLOCK_ROWS, votes: dict | None = None, wanted: tuple[str, ...] = (),
) -> DataFrame:
    """Every strategy on every series as one long table of labelled trades, in one exchange.

    A condition on a column that is not known yet makes no signal. With ``votes`` the strategies are
    combinations of members of ``strategies``.
    """
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_research(df, w)
        df = signals.add_votes(df, w, votes, strategies) if votes else signals.add_signals(df, w, strategies)
        return labels.add_entry(df, w, entry_lag, max_hold)

    framed = in_frames(bars, build, before=ind.core_margin() + 64, after=entry_lag + max_hold, rows=rows)
    keep = ["symbol", "tf", "ts", "ix", "open", "close", "atr", "_entry", "_fut", *wanted]
    long = framed.filter(F.size("signals") > 0).select(*keep, F.inline("signals"))
    trades = labels.win_loss(labels.barrier_trades(long, warm_up=0, rr=rr))
    if pairs is None:
        return trades
    return labels.net_of_costs(risk.with_costs(trades, pairs), F.col("cost_pips"))


def gap_candidates(bars: DataFrame, max_hold: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Daily bars with atr and, on Mondays, the bars a gap trade can live through (the Monday included)."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_atr_sma(df, w).withColumns(labels.future(w, 0, max_hold))
        return df.withColumn("_fut", F.when(F.weekday("ts") == 0, F.col("_fut")))

    return in_frames(bars, build, before=15, after=max_hold, rows=rows)


def label_gaps(mondays: DataFrame, pairs: DataFrame, sl_atr: Column | float, max_hold: Column | int) -> DataFrame:
    """Gap trades faded to the Friday close; the target also counts when only the close reaches it."""
    sl_atr = sl_atr if isinstance(sl_atr, Column) else F.lit(float(sl_atr))
    max_hold = max_hold if isinstance(max_hold, Column) else F.lit(max_hold)
    side = F.col("signal")
    # The last bar of a series opens no trade.
    rows = mondays.filter(F.size("_fut") > 1).withColumns({
        "entry_price": F.col("open"), "sl": F.col("open") - side * F.col("atr") * sl_atr, "tp": F.col("friday_close"),
        "_live": F.slice("_fut", F.lit(1), max_hold + 1),
    })
    x = labels.first_touch(F.col("_live"), side, F.col("sl"), F.col("tp"), F.col("close"), tp_on_close=True, time_exit_from=1)
    rows = rows.withColumn("_x", x).select("*", "_x.exit_ix", "_x.exit_ts", "_x.exit_price", "_x.exit_reason").withColumns({
        "direction": F.when(side > 0, "buy").otherwise("sell"), "risk": F.abs(F.col("entry_price") - F.col("sl")), "year": F.year("ts"),
        "strategy": F.lit("monday_gap"),
    })
    out = labels.with_r(rows, side).drop("_fut", "_live", "_x")
    return labels.net_of_costs(risk.with_costs(out, pairs), F.col("cost_pips"))


def gap_trades(
    bars: DataFrame, pairs: DataFrame, min_gap_atr: float | None = 0.3, min_gap_pct: float | None = None,
    sl_atr: float = 1.0, max_hold: int = 5,
) -> DataFrame:
    mondays = signals.monday_gap(gap_candidates(bars, max_hold), min_gap_atr, min_gap_pct)
    return label_gaps(mondays, pairs, sl_atr, max_hold)


# Parameter grids of the two gap rules (smallest gap, stop in ATRs, longest hold).
ATR_GRID = ((0.2, 0.3, 0.4, 0.5), (0.8, 1.0, 1.2, 1.5), (3, 5, 10))
PCT_GRID = ((0.05, 0.10, 0.15, 0.25), (1.0, 1.5, 2.0), (3, 5, 10))


def gap_grid_trades(bars: DataFrame, pairs: DataFrame, grid=ATR_GRID, size: str = "gap_atr") -> DataFrame:
    """Trades of every parameter combination from one pass over the bars.

    Each Monday meets each combination (a fixed number), then the first qualifying Monday per Friday and
    combination is kept.
    """
    gaps, stops, holds = grid
    base = signals.monday_gap(gap_candidates(bars, max(holds)), None, None, first_only=False)
    grown = (
        base.withColumn("min_gap", F.explode(F.array(*[F.lit(g) for g in gaps])))
        .filter(F.col(size) >= F.col("min_gap"))
    )
    first = F.row_number().over(Window.partitionBy("symbol", "tf", "min_gap", "friday_ix").orderBy("ix"))
    kept = grown.withColumn("_r", first).filter(F.col("_r") == 1).drop("_r")
    kept = kept.withColumn("sl_atr", F.explode(F.array(*[F.lit(s) for s in stops])))
    kept = kept.withColumn("max_hold", F.explode(F.array(*[F.lit(h) for h in holds])))
    return label_gaps(kept, pairs, F.col("sl_atr"), F.col("max_hold"))


def percent_exit_trades(
    bars: DataFrame, strategy, gain_pct: float = 1.0, loss_pct: float = 0.5, warm_up: int = 50, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Enter at the close, leave at the first close beyond a gain or loss in percent, one trade at a time.

    The exit may be arbitrarily late, so it is found by the level search; ``bars`` is read several times.
    Bullish and bearish signals are separate accounts.
    """
    fired = in_frames(bars, lambda df, w: df.withColumn("signal", strategy(w)), before=64, after=2, rows=rows)
    fired = fired.filter((F.col("signal") != 0) & (F.col("ix") >= warm_up))
    up = F.when(F.col("signal") > 0, 1 + gain_pct / 100).otherwise(1 + loss_pct / 100)
    down = F.when(F.col("signal") > 0, 1 - loss_pct / 100).otherwise(1 - gain_pct / 100)
    events = fired.select(
        "symbol", "tf", "ts", "ix", "signal", F.col("close").alias("entry"), (F.col("close") * up).alias("up"), (F.col("close") * down).alias("down")
    )
    closed = first_cross(events, bars.select("symbol", "tf", "ix", "close"), out="exit_ix", strict=False)
    closed = closed.withColumn("direction", F.when(F.col("signal") > 0, "bullish").otherwise("bearish"))
    taken = greedy.non_overlapping(closed, ["symbol", "tf", "direction"], rows=rows).filter(F.col("exit_ix").isNotNull())
    exits = bars.select("symbol", "tf", F.col("ix").alias("exit_ix"), F.col("close").alias("exit_price"))
    out = taken.join(exits, ["symbol", "tf", "exit_ix"])
    move = F.try_divide(F.col("signal") * (F.col("exit_price") - F.col("entry")), F.col("entry"))
    return out.withColumn("pnl_pct", move * 100)


def smc_proxy_trades(bars: DataFrame, pairs: DataFrame, max_hold: int = 24, warm_up: int = 25, rows: int = BLOCK_ROWS) -> DataFrame:
    """Breakouts that close beyond the extreme, only in moving or mixed regimes; both sides may fire on a bar.

    Needs three further bars. Result in units of risk after costs; regime per bar is kept.
    """
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = regime.add_research_regime(ind.add_atr_sma(df, w), w)
        df = df.withColumns({"_sides": signals.smc_proxy_sides(w), "_ahead": F.lead("ix", 3).over(w)})
        return labels.add_entry(df, w, 1, max_hold)

    framed = in_frames(bars, build, before=80, after=1 + max_hold, rows=rows)
    framed = framed.filter(F.col("regime").isin("TRENDING", "HIGH_VOL", "MIXED") & F.col("_ahead").isNotNull())
    fired = framed.withColumn("signal", F.explode("_sides")).drop("_sides", "_ahead")
    trades = labels.barrier_trades(fired.withColumn("atr", F.coalesce("atr", F.col("close") * 0.005)), warm_up=warm_up)
    trades = trades.withColumn("strategy", F.lit("smc_proxy"))
    return labels.net_of_costs(risk.with_costs(trades, pairs), F.col("cost_pips"))
