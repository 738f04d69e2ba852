"""Reports on a log of trades, its upkeep, and one pass of trade monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators import stats
from tickweave.operators.crossing import first_cross
from tickweave.operators.frames import BLOCK_ROWS, KEYS
from tickweave.session import cut

RECENT_COLUMNS = (
    "symbol", "direction", "entry", "stop_loss", "tp1", "status", "result", "opened_at", "closed_at",
    "strategy_used", "confidence", "score",
)


def since(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Closed trades opened in the last ``days`` days before ``now``."""
    return log.filter((F.col("status") == "closed") & (F.col("opened_at") >= now - F.make_dt_interval(F.lit(days))))


def performance(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Trades, wins, losses, win rate, mean ratio of winners and the session with most wins (ties by name)."""
    closed = since(log, now, days).withColumn("session", F.coalesce("session", F.lit("unknown")))
    win = F.col("result") == "win"
    rr = F.when(win & (F.col("actual_rr") != 0), F.col("actual_rr"))
    per = closed.groupBy("session").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(win, 1)).alias("w"), F.sum(rr).alias("rr"), F.count(rr).alias("nrr")
    )
    best = F.min_by("session", F.when(F.col("w") > 0, F.struct(-F.col("w"), F.col("session"))))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_trades"), F.coalesce(F.sum("w"), F.lit(0)).alias("wins"),
        F.coalesce(F.sum("n") - F.sum("w"), F.lit(0)).alias("losses"),
        F.coalesce(F.try_divide(F.sum("w") * 100.0, F.sum("n")), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide(F.sum("rr"), F.sum("nrr")), F.lit(0.0)).alias("avg_rr"),
        F.coalesce(best, F.lit("N/A")).alias("best_session"),
    )


def by_dimension(log: DataFrame, dim: str, now: Column, days: int = 30, keep_null: bool = False) -> DataFrame:
    """Wins, losses and win rate per value of a column."""
    closed = since(log, now, days)
    if not keep_null:
        closed = closed.filter(F.col(dim).isNotNull())
    win = F.col("result") == "win"
    return closed.groupBy(dim).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(win, 1)).alias("wins"),
        (F.count(F.lit(1)) - F.count(F.when(win, 1))).alias("losses"),
    ).withColumn("win_rate", F.col("wins") / F.col("total") * 100)


def drawdown(log: DataFrame, now: Column, days: int = 30, start: float = 10000.0, risk_pct: float = 1.0) -> DataFrame:
    """Largest and current drawdown and peak of an account that took every closed trade in order of opening.

    Wins grow the balance by ``risk_pct`` percent times their ratio, everything else loses ``risk_pct``
    percent. The log is cut into pieces of its order; the few numbers of each are combined at the end.
    """
    closed = since(log, now, days)
    factor = F.when(F.col("result") == "win", F.abs("actual_rr")).otherwise(-1.0)
    g = stats.log_growth(factor, risk_pct)
    one = closed.withColumn("_all", F.lit(1))
    parts = stats._drawdown_parts(one, ["_all"], g, ["opened_at", "id"], {})
    parts = stats._join_drawdown(parts, ["_all"], start=0.0)
    peak = F.greatest(F.max(F.col("_off") + F.col("_hi")), F.lit(0.0))
    return parts.agg(
        ((1 - F.exp(-F.max("_drop"))) * 100).alias("max_drawdown"),
        ((1 - F.exp(F.sum("_sum") - peak)) * 100).alias("current_drawdown"),
        (F.exp(peak) * start).alias("peak_equity"),
    )


def open_trades(log: DataFrame) -> DataFrame:
    """Open trades; their order is left to the reader."""
    return log.filter(F.col("status") == "open")


def recent_trades(log: DataFrame, n: int = 10) -> DataFrame:
    """Latest ``n`` trades; sort and limit keep only ``n`` rows per partition."""
    return log.orderBy(F.col("opened_at").desc(), F.col("id")).limit(n).select("id", *RECENT_COLUMNS)


def trades_on(log: DataFrame, day: Column) -> DataFrame:
    """Trades opened on a UTC day, per session and in all."""
    counts = log.filter(F.to_date("opened_at") == day).rollup("session").agg(
        F.count(F.lit(1)).alias("trades"), F.grouping("session").alias("_all")
    )
    return counts.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.coalesce("session", F.lit("(none)"))).alias("session"), "trades")


def upsert(log: DataFrame, updates: DataFrame, version: str = "version", key: str = "id") -> DataFrame:
    """Log after updates: the row with the highest version per id wins as a whole.

    Rows are combined before the shuffle, so a hot id is no problem.
    """
    cols = [c for c in log.columns if c != key]
    both = log.unionByName(updates)
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version)).alias("_r")).select(key, "_r.*")


def apply_changes(log: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Overwrite the given columns where a change has a value; unknown ids become new rows."""
    change = changes.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = log.join(change, key, "full_outer")
    return joined.withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns}).drop(*[f"_n_{c}" for c in columns])


def monitor(trades: DataFrame, prices: DataFrame, compat: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """One pass over open trades at the latest price of their symbol; ``tie`` orders prices of one time.

    At most one new target is marked per pass; the first moves the stop to the entry. The third target
    closes the trade with its ratio and a stop closes it at 0 or -1; with ``compat`` only the original
    stop closes a trade.
    """
    last = prices.groupBy("symbol").agg(F.max_by("price", F.struct("ts", *tie)).alias("price"))
    t = trades.join(last, "symbol", "left")
    buy = F.col("direction") == "buy"
    px = F.col("price")

    def reached(k: int) -> Column:
        target = F.col(f"tp{k}")
        return F.coalesce((F.col(f"tp{k}_hit") == 0) & F.when(buy, px >= target).otherwise(px <= target), F.lit(False))

    new = F.when(reached(1), 1).when(reached(2), 2).when(reached(3), 3)
    stop = F.col("stop_loss") if compat else F.when(F.col("be_moved") == 1, F.col("entry")).otherwise(F.col("stop_loss"))
    t = t.withColumns({"new_tp": new, "_stop": F.coalesce(F.when(buy, px <= stop).otherwise(px >= stop), F.lit(False))})
    full = F.lit(False) if compat else F.coalesce(F.col("new_tp") == 3, F.lit(False))
    ratio3 = F.try_divide(F.abs(F.col("tp3") - F.col("entry")), F.abs(F.col("entry") - F.col("stop_loss")))
    closing = full | F.col("_stop")
    moved = (F.col("be_moved") == 1) | (F.col("new_tp") == 1)
    safe = F.coalesce(F.col("be_moved") == 1, F.lit(False)) | F.coalesce(F.col("new_tp") == 1, F.lit(False))
    return t.withColumns({
        "status": F.when(closing, "closed").otherwise("open"),
        "result": F.when(full | (F.col("_stop") & safe), "win").when(F.col("_stop"), "loss"),
        "actual_rr": F.when(full, ratio3).when(F.col("_stop") & safe, 0.0).when(F.col("_stop"), -1.0),
        **{f"tp{k}_hit": F.when(F.col("new_tp") == k, 1).otherwise(F.col(f"tp{k}_hit")) for k in (1, 2, 3)},
        "be_moved": F.when(F.coalesce(moved, F.lit(False)), 1).otherwise(F.col("be_moved")),
    }).drop("_stop")


def monitor_path(trades: DataFrame, prices: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """What repeated passes over the whole price path make of each trade: ``level`` (targets reached), ``closed_ix``, status,
    result and actual_rr.

    Trades (symbol, tf, ix, direction, entry, stop_loss, tp1 to tp3) are watched from the price after ``ix``; prices are
    (symbol, tf, ix, price). Between targets only two prices matter, the next target and the stop, which is the entry once
    the first target is reached; so the passes are three searches for the first price beyond either. A null target is never
    reached, and neither is a null stop. Both are read three times: pass written tables.
    """
    path, buy = prices.select(*KEYS, "ix", "price"), F.col("direction") == "buy"
    at_price = path.withColumnsRenamed({"ix": "_hit", "price": "_px"})
    live = trades.withColumns({"_start": F.col("ix"), "level": F.lit(0), "closed_ix": F.lit(None).cast("long")})
    for k in (1, 2, 3):
        target, stop = F.col(f"tp{k}"), F.col("stop_loss") if k == 1 else F.col("entry")
        open_still = (F.col("level") == k - 1) & F.col("closed_ix").isNull()
        live = live.withColumns({
            "up": F.when(open_still, F.when(buy, target).otherwise(stop)), "down": F.when(open_still, F.when(buy, stop).otherwise(target)),
        })
        live = cut(first_cross(live, path, high="price", low="price", out="_hit", strict=False, rows=rows))
        live = live.join(at_price, [*KEYS, "_hit"], "left")
        won = F.coalesce(F.when(buy, F.col("_px") >= target).otherwise(F.col("_px") <= target), F.lit(False))
        live = live.withColumns({
            "level": F.when(won, k).otherwise(F.col("level")),
            "closed_ix": F.when(F.col("_hit").isNotNull() & (~won | F.lit(k == 3)), F.col("_hit")).otherwise(F.col("closed_ix")),
            "ix": F.coalesce("_hit", "ix"),
        }).drop("_hit", "_px", "up", "down")
    closed, full = F.col("closed_ix").isNotNull(), F.col("level") == 3
    ratio3 = F.try_divide(F.abs(F.col("tp3") - F.col("entry")), F.abs(F.col("entry") - F.col("stop_loss")))
    return live.withColumns({
        "ix": F.col("_start"), "status": F.when(closed, "closed").otherwise("open"),
        "result": F.when(closed, F.when(F.col("level") > 0, "win").otherwise("loss")),
        "actual_rr": F.when(full, ratio3).when(closed, F.when(F.col("level") > 0, 0.0).otherwise(-1.0)),
    }).drop("_start")
