"""Outcome of a signal: which barrier later bars touch first.

The bars a trade can live through are gathered by one bounded window in the same frame that made
the signal, so labelling adds no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators.frames import KEYS


def future(w: WindowSpec, first: int, last: int, out: str = "_fut") -> dict[str, Column]:
    """Bars ``first`` to ``last`` ahead of the current one, in order."""
    bar = F.struct("ix", "ts", "high", "low", "close")
    return {out: F.collect_list(bar).over(w.rowsBetween(first, last))}


def first_touch(
    fut: Column, side: Column, sl: Column, tp: Column, unresolved_price: Column,
    tp_on_close: bool = False, sl_first: bool = True, time_exit_from: int = 0,
) -> Column:
    """Struct (exit_ix, exit_ts, exit_price, exit_reason) of the first bar that touches a barrier.

    A bar touching both counts as the stop unless ``sl_first`` is off. Without a touch the trade ends
    at the last bar's close (TIME_EXIT), or at ``unresolved_price`` (CLOSE_EXIT) when no more than
    ``time_exit_from`` bars followed.
    """
    def stop(b: Column) -> Column:
        return F.when(side > 0, b["low"] <= sl).otherwise(b["high"] >= sl)

    def target(b: Column) -> Column:
        plain = F.when(side > 0, b["high"] >= tp).otherwise(b["low"] <= tp)
        if not tp_on_close:
            return plain
        return plain | F.when(side > 0, b["close"] >= tp).otherwise(b["close"] <= tp)

    hit = F.get(F.filter(fut, lambda b: stop(b) | target(b)), F.lit(0))
    last = F.get(fut, F.size(fut) - 1)
    stopped = stop(hit) if sl_first else ~target(hit)

    def result(ix: Column, ts: Column, price: Column, reason: str) -> Column:
        return F.struct(
            ix.alias("exit_ix"), ts.alias("exit_ts"), price.alias("exit_price"), F.lit(reason).alias("exit_reason")
        )

    none = F.lit(None)
    return (
        F.when(hit.isNotNull() & stopped, result(hit["ix"], hit["ts"], sl, "SL"))
        .when(hit.isNotNull(), result(hit["ix"], hit["ts"], tp, "TP"))
        .when(F.size(fut) > time_exit_from, result(last["ix"], last["ts"], last["close"], "TIME_EXIT"))
        .otherwise(result(none.cast("long"), none.cast("timestamp"), unresolved_price, "CLOSE_EXIT"))
    )


def add_entry(df: DataFrame, w: WindowSpec, entry_lag: int = 1, max_hold: int = 24) -> DataFrame:
    """Entry price ``entry_lag`` bars ahead and the bars after it. Margin: entry_lag + max_hold ahead."""
    return df.withColumns({
        "_entry": F.lead("open", entry_lag).over(w),
        **future(w, entry_lag + 1, entry_lag + max_hold),
    })


def barrier_trades(
    df: DataFrame, signal: str = "signal", rr: float = 1.5, sl_atr: float = 1.5,
    warm_up: int = 15, close_exit_at: str = "entry", sl_first: bool = True,
) -> DataFrame:
    """One trade per signal row of a frame prepared by ``add_entry``; needs ``atr`` (0.5 % of price if null).

    ``close_exit_at`` names the price of a trade without a later bar: ``entry`` or the signal's ``close``.
    """
    side = F.col(signal)
    rows = df.filter((side != 0) & (F.col("ix") >= warm_up) & F.col("_entry").isNotNull())
    dist = F.coalesce(F.col("atr"), F.col("_entry") * 0.005) * sl_atr
    rows = rows.withColumns({
        "entry_price": F.col("_entry"),
        "sl": F.col("_entry") - side * dist,
        "tp": F.col("_entry") + side * dist * rr,
    })
    fallback = F.col("_entry") if close_exit_at == "entry" else F.col("close")
    rows = rows.withColumn("_x", first_touch(F.col("_fut"), side, F.col("sl"), F.col("tp"), fallback, sl_first=sl_first))
    out = rows.withColumns({
        "direction": F.when(side > 0, "buy").otherwise("sell"),
        "exit_ix": F.col("_x.exit_ix"),
        "exit_ts": F.col("_x.exit_ts"),
        "exit_price": F.col("_x.exit_price"),
        "exit_reason": F.col("_x.exit_reason"),
        "risk": F.abs(F.col("entry_price") - F.col("sl")),
        "rr": F.try_divide(F.abs(F.col("tp") - F.col("entry_price")), F.abs(F.col("entry_price") - F.col("sl"))),
        "year": F.year("ts"),
    })
    return with_r(out, side).drop("_fut", "_entry", "_x")


def with_r(trades: DataFrame, side: Column) -> DataFrame:
    """Gross result in units of risk; no risk gives 0."""
    raw = side * (F.col("exit_price") - F.col("entry_price"))
    return trades.withColumn("pnl_r", F.coalesce(F.try_divide(raw, F.col("risk")), F.lit(0.0)))


def net_of_costs(trades: DataFrame, cost: Column) -> DataFrame:
    """Result in units of risk after a cost in price units."""
    net = F.col("pnl_r") - F.coalesce(F.try_divide(cost, F.col("risk")), F.lit(0.0))
    return trades.withColumn("net_pnl_r", net)


def win_loss(trades: DataFrame) -> DataFrame:
    """``win`` at the target, ``loss`` at the stop, ``open`` when neither was touched."""
    reason = F.col("exit_reason")
    return trades.withColumn("result", F.when(reason == "TP", "win").when(reason == "SL", "loss").otherwise("open"))


def multi_target(
    fut: Column, side: Column, sl: Column, tps: Sequence[Column], max_hold: int | None, sl_first: bool = True,
) -> Column:
    """Struct (exit_ix, result, level) for three targets checked from the farthest.

    ``level`` is 3, 2, 1 for targets, -1 for the stop, 0 for leaving at the close after ``max_hold``
    bars (None: stay open).
    """
    def stop(b: Column) -> Column:
        return F.when(side > 0, b["low"] <= sl).otherwise(b["high"] >= sl)

    def reached(b: Column, tp: Column) -> Column:
        return F.when(side > 0, b["high"] >= tp).otherwise(b["low"] <= tp)

    hit = F.get(F.filter(fut, lambda b: stop(b) | reached(b, tps[0]) | reached(b, tps[1]) | reached(b, tps[2])), F.lit(0))

    def result(ix: Column, name: str, level: int) -> Column:
        return F.struct(ix.alias("exit_ix"), F.lit(name).alias("result"), F.lit(level).alias("level"))

    stopped = result(hit["ix"], "loss", -1)
    out = F.when(hit.isNotNull() & stop(hit), stopped) if sl_first else None
    for k in (3, 2, 1):
        cond = hit.isNotNull() & reached(hit, tps[k - 1])
        value = result(hit["ix"], f"win_tp{k}", k)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if not sl_first:
        out = out.when(hit.isNotNull(), stopped)
    last = F.get(fut, F.size(fut) - 1)
    if max_hold is not None:
        out = out.when(F.size(fut) >= max_hold, result(last["ix"], "exit", 0))
    return out.otherwise(result(F.lit(None).cast("long"), "open", 0))


def forward_return(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Return of the next bar and whether it went the candle's way. Margin: 1 ahead."""
    nxt = F.try_divide(F.lead("close", 1).over(w), F.col("close")) - 1
    up = F.col("close") > F.col("open")
    df = df.withColumn("fwd_return", nxt)
    return df.withColumn("direction_hit", F.when(up, F.col("fwd_return") > 0).otherwise(F.col("fwd_return") < 0))


TRADE_KEYS = (*KEYS, "strategy")
