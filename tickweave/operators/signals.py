"""Signal generators: a column in {-1, 0, 1} per bar, built from a frame and its window.

A strategy is a function ``(window) -> Column`` over research columns. ``signal_table`` runs any
number of them in one pass and returns the long form (symbol, tf, ts, ix, strategy, signal).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators import indicators as ind
from tickweave.operators import scan
from tickweave.operators.frames import BLOCK_ROWS, KEYS, block_of, in_frames, running
from tickweave.operators.streaks import streak_signals
from tickweave.session import cut

Strategy = Callable[[WindowSpec], Column]


def pick(up: Column, down: Column, up_first: bool = True) -> Column:
    """1 / -1 / 0 from two conditions; an unknown condition counts as false."""
    if up_first:
        return F.when(up, 1).when(down, -1).otherwise(0)
    return F.when(down, -1).when(up, 1).otherwise(0)


def entered(state: Column, w: WindowSpec) -> Column:
    """The state holds now and did not hold on the previous bar."""
    now = F.coalesce(state, F.lit(False))
    return now & ~F.coalesce(F.lag(now, 1).over(w), F.lit(False))


# --- false breakout --------------------------------------------------------------------------

def false_breakout(lookback: int = 10) -> Strategy:
    """Beyond the previous extreme now, closed back inside two bars later; a buy overrides a sell."""

    def signal(w: WindowSpec) -> Column:
        top = ind.previous_extreme(F.max, "high", lookback, w)
        bottom = ind.previous_extreme(F.min, "low", lookback, w)
        later = F.lead("close", 2).over(w)
        return pick((F.col("low") < bottom) & (later > bottom), (F.col("high") > top) & (later < top))

    return signal


def add_false_breakout_setups(
    df: DataFrame, w: WindowSpec, lookback: int = 10, sl: float = 1.0, tps: Sequence[float] = (1.5, 2.5, 3.5),
) -> DataFrame:
    """One row per completed trap with prices and confidence. Margin: lookback back, 2 ahead.

    The pattern is known two bars after the break (``available_ix``). Sell and buy can both complete.
    """
    df = df.withColumns({
        "_top": ind.previous_extreme(F.max, "high", lookback, w),
        "_bottom": ind.previous_extreme(F.min, "low", lookback, w),
        "_later": F.lead("close", 2).over(w),
        "_entry": F.lead("open", 1).over(w),
    })

    sell = (F.col("high") > F.col("_top")) & (F.col("_later") < F.col("_top"))
    buy = (F.col("low") < F.col("_bottom")) & (F.col("_later") > F.col("_bottom"))
    sides = F.array_compact(F.array(F.when(sell, F.lit(-1)), F.when(buy, F.lit(1))))
    up, entry, atr = F.col("_side") > 0, F.col("entry"), F.col("atr_value")
    df = df.withColumn("_side", F.explode(sides)).withColumnRenamed("_entry", "entry")
    df = df.withColumns({
        "direction": F.when(up, "buy").otherwise("sell"),
        "available_ix": F.col("ix") + 2,
        "atr_value": F.coalesce(F.col("atr"), F.col("entry") * 0.005),
        "_level": F.when(up, F.col("_bottom")).otherwise(F.col("_top")),
        "_gap": F.when(up, F.col("_bottom") - F.col("low")).otherwise(F.col("high") - F.col("_top")),
    })
    df = df.withColumns({
        "stop_loss": entry - F.col("_side") * atr * sl,
        **{f"tp{k}": entry + F.col("_side") * atr * m for k, m in enumerate(tps, 1)},
        "gap_atr_ratio": F.when(atr > 0, F.greatest(F.lit(0.0), F.try_divide(F.col("_gap"), atr))).otherwise(0.0),
    })
    text = f"FB %s: %s broke {lookback}-bar swing %s @ %.5f but closed back %s (gap %.1fx ATR)"
    return df.withColumns({
        "confidence": F.least(F.lit(50.0) + F.col("gap_atr_ratio") * 12.5, F.lit(75.0)),
        "reason": F.format_string(
            text, F.initcap("direction"), F.col("symbol"), F.when(up, "low").otherwise("high"), F.col("_level"),
            F.when(up, "above").otherwise("below"), F.col("gap_atr_ratio"),
        ),
    }).drop("_top", "_bottom", "_later", "_side", "_level", "_gap")


def pick_best(setups: DataFrame, keys: Sequence[str] = (*KEYS, "ix")) -> DataFrame:
    """Setup with the highest confidence per bar; on a tie the sell is kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("direction").desc()))
    return setups.withColumn("_r", rank).filter(F.col("_r") == 1).drop("_r")


# --- rule strategies -------------------------------------------------------------------------

def ma_cross(fast: int, slow: int) -> Strategy:
    def signal(w: WindowSpec) -> Column:
        f, s = F.col(f"ema_{fast}"), F.col(f"ema_{slow}")
        pf, ps = F.lag(f, 1).over(w), F.lag(s, 1).over(w)
        return pick((pf <= ps) & (f > s), (pf >= ps) & (f < s))
    return signal


def rsi_extreme(low: float, high: float) -> Strategy:
    return lambda w: pick(F.col("rsi") < low, F.col("rsi") > high)


def rsi_divergence(n: int = 10, warm_up: int = 20) -> Strategy:
    """New extreme of the close over the previous ``n`` bars that the RSI does not confirm."""
    def signal(w: WindowSpec) -> Column:
        c, r, past = F.col("close"), F.col("rsi"), w.rowsBetween(-n, -1)
        up = (c < F.min("close").over(past)) & (r > F.min("rsi").over(past))
        down = (c > F.max("close").over(past)) & (r < F.max("rsi").over(past))
        ready = F.col("ix") >= warm_up
        return pick(ready & up, ready & down)
    return signal


def bollinger(w: WindowSpec) -> Column:
    return pick(F.col("close") <= F.col("bb_lower"), F.col("close") >= F.col("bb_upper"), up_first=False)


def breakout(lookback: int) -> Strategy:
    def signal(w: WindowSpec) -> Column:
        top = ind.previous_extreme(F.max, "high", lookback, w)
        bottom = ind.previous_extreme(F.min, "low", lookback, w)
        return pick(F.col("close") > top, F.col("close") < bottom, up_first=False)
    return signal


def volume_spike(times: float) -> Strategy:
    def signal(w: WindowSpec) -> Column:
        spike = F.col("rvol") >= times
        return pick(spike & (F.col("close") > F.col("open")), spike & (F.col("close") < F.col("open")))
    return signal


def session_entry(start: int, end: int) -> Strategy:
    return lambda w: F.when((F.hour("ts") >= start) & (F.hour("ts") < end), 1).otherwise(0)


def _aligned(side: int) -> Column:
    e9, e21, e50, e200 = (F.col(f"ema_{s}") for s in (9, 21, 50, 200))
    if side > 0:
        return (e9 > e21) & (e21 > e50) & (F.col("close") > e200)
    return (e9 < e21) & (e21 < e50) & (F.col("close") < e200)


def ema_align(w: WindowSpec) -> Column:
    return pick(_aligned(1), _aligned(-1))


def ema_align_change(w: WindowSpec) -> Column:
    return pick(entered(_aligned(1), w), entered(_aligned(-1), w))


def ema_rsi(w: WindowSpec) -> Column:
    up = (F.col("close") > F.col("ema_9")) & (F.col("rsi") > 50)
    down = (F.col("close") < F.col("ema_9")) & (F.col("rsi") < 50)
    return pick(entered(up, w), entered(down, w))


def bb_walk(run: int = 3) -> Strategy:
    """At least ``run`` closes in a row on or outside a band, faded; needs no longer memory than ``run``."""
    def signal(w: WindowSpec) -> Column:
        def streak(state: Column) -> Column:
            held = F.coalesce(state, F.lit(False)).cast("int")
            return F.sum(held).over(w.rowsBetween(-(run - 1), 0)) == run
        return pick(streak(F.col("close") <= F.col("bb_lower")), streak(F.col("close") >= F.col("bb_upper")))
    return signal


def volume_disconnect(w: WindowSpec) -> Column:
    """Large volume, small body: follow the sign of the last return."""
    span = F.col("high") - F.col("low")
    body = F.try_divide(F.abs(F.col("close") - F.col("open")), span)
    quiet = (F.col("rvol") >= 2.0) & (body < 0.3)
    change = F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - 1
    return pick(quiet & (change > 0), quiet & (change < 0))


def smc_proxy_sides(w: WindowSpec, lookback: int = 10) -> Column:
    """Closes beyond the previous extreme, as an array because both sides may hold."""
    top = ind.previous_extreme(F.max, "high", lookback, w)
    bottom = ind.previous_extreme(F.min, "low", lookback, w)
    up = (F.col("high") > top) & (F.col("close") > top)
    down = (F.col("low") < bottom) & (F.col("close") < bottom)
    return F.array_compact(F.array(F.when(up, F.lit(1)), F.when(down, F.lit(-1))))


# --- registry --------------------------------------------------------------------------------

# The strategies compared with each other.
STRATEGIES: dict[str, Strategy] = {
    "ma_9_21": ma_cross(9, 21),
    "ma_21_50": ma_cross(21, 50),
    "ma_50_200": ma_cross(50, 200),
    "rsi_30_70": rsi_extreme(30, 70),
    "rsi_25_75": rsi_extreme(25, 75),
    "rsi_20_80": rsi_extreme(20, 80),
    "rsi_divergence": rsi_divergence(),
    "bollinger_bounce": bollinger,
    "breakout_10": breakout(10),
    "breakout_20": breakout(20),
    "breakout_50": breakout(50),
    "vol_1.5x": volume_spike(1.5),
    "vol_2x": volume_spike(2.0),
    "london_session": session_entry(7, 12),
    "ny_session": session_entry(12, 21),
    "overlap_session": session_entry(12, 16),
    "ema_alignment": ema_align,
}
FRESH: dict[str, Strategy] = {
    "ema_rsi": ema_rsi,
    "bb_walk": bb_walk(),
    "vol_disc": volume_disconnect,
    "false_bo": false_breakout(),
}
VOTE_POOL = ("ma_9_21", "ma_21_50", "rsi_30_70", "bollinger_bounce", "breakout_20", "vol_1.5x", "ema_alignment")
BY_DAY = (
    "ma_9_21", "ma_21_50", "ma_50_200", "breakout_10", "breakout_20", "breakout_50",
    "rsi_20_80", "rsi_25_75", "rsi_30_70", "ema_alignment",
)


def add_signals(df: DataFrame, w: WindowSpec, strategies: dict[str, Strategy]) -> DataFrame:
    """One array column ``signals`` of (strategy, signal) for the strategies that fire on a bar."""
    named = {f"_sig_{k}": build(w) for k, build in enumerate(strategies.values())}
    df = df.withColumns(named)
    fired = [
        F.when(F.col(c) != 0, F.struct(F.lit(name).alias("strategy"), F.col(c).cast("int").alias("signal")))
        for c, name in zip(named, strategies)
    ]
    return df.withColumn("signals", F.array_compact(F.array(*fired))).drop(*named)


def to_long(df: DataFrame, keep: Sequence[str] = (*KEYS, "ts", "ix")) -> DataFrame:
    return df.select(*keep, F.inline("signals"))


def votes(n: int, min_agree: int = 2, pool: Sequence[str] = VOTE_POOL) -> dict[str, tuple[tuple[str, ...], int]]:
    """Every combination of ``n`` strategies of the pool, named ``a + b (+ c)``."""
    return {" + ".join(c): (c, min_agree) for c in combinations(pool, n)}


def add_votes(df: DataFrame, w: WindowSpec, combos: dict[str, tuple[tuple[str, ...], int]], pool: dict[str, Strategy] | None = None) -> DataFrame:
    """Agreement of several strategies as further strategies: ``min_agree`` bulls, else bears."""
    pool = pool or STRATEGIES
    members = sorted({m for c, _ in combos.values() for m in c})
    cols = {m: f"_m_{k}" for k, m in enumerate(members)}
    df = df.withColumns({cols[m]: pool[m](w) for m in members})
    fired = []
    for name, (parts, agree) in combos.items():
        bulls = sum((F.when(F.col(cols[m]) == 1, 1).otherwise(0) for m in parts), F.lit(0))
        bears = sum((F.when(F.col(cols[m]) == -1, 1).otherwise(0) for m in parts), F.lit(0))
        signal = pick(bulls >= agree, bears >= agree)
        fired.append(F.when(signal != 0, F.struct(F.lit(name).alias("strategy"), signal.cast("int").alias("signal"))))
    return df.withColumn("signals", F.array_compact(F.array(*fired))).drop(*cols.values())


def pandas_strategy(
    bars: DataFrame, name: str, func: Callable[[pd.DataFrame], pd.Series], before: int, after: int = 0, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A user's pandas strategy: ``func`` gets one block of bars with its margin, in time order.

    The user states how many bars the function looks back and ahead, so a symbol is never one group.
    """
    schema = T.StructType(
        [f for f in bars.schema.fields if f.name in (*KEYS, "ts", "ix")]
        + [T.StructField("_blk", T.LongType()), T.StructField("_sub", T.LongType()),
           T.StructField("strategy", T.StringType()), T.StructField("signal", T.IntegerType())]
    )

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("ix").reset_index(drop=True)
        values = func(block).astype("int32")
        return block.assign(strategy=name, signal=values)[[f.name for f in schema.fields]]

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.groupBy(*KEYS, "_blk").applyInPandas(run, schema)

    return in_frames(bars, build, before, after, rows=rows).filter(F.col("signal") != 0)


# --- stateful generators ---------------------------------------------------------------------

def vshape(bars: DataFrame, run: int = 3, atr_mult: float = 1.5, rows: int = BLOCK_ROWS, fan: int = scan.FAN) -> DataFrame:
    """Fade a streak of ``run`` or more same-sign returns that moved over ``atr_mult`` ATR, then start over.

    A change of sign or a zero return starts a new streak whatever came before. ``bars`` is read twice: pass a written table.
    """
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("close", 1).over(w)
        change = F.try_divide(F.col("close"), prev) - 1
        df = df.withColumns({"_ret": change, "move": F.abs(change) * prev})
        df = df.withColumn("_sign", F.when(F.col("_ret") > 0, 1).otherwise(-1))
        # A zero return opens a streak of sign -1 with no move, as a fresh start does.
        start = (F.col("_ret") == 0) | F.lag("_ret", 1).over(w).isNull() | (F.col("_sign") != F.lag("_sign", 1).over(w))
        return df.withColumns({"start": start, "signal": -F.col("_sign"), "least": F.col("atr") * atr_mult})

    marked = in_frames(bars, build, before=2, rows=rows).filter(F.col("_ret").isNotNull())
    found = streak_signals(cut(marked.select(*KEYS, "ix", "ts", "start", "move", "least", "signal")), run, rows, fan)
    return found.select(*KEYS, "ts", "ix", F.lit("vshape").alias("strategy"), "signal")


def monday_gap(
    bars: DataFrame, min_gap_atr: float | None = 0.3, min_gap_pct: float | None = None,
    warm_up: int = 20, rows: int = BLOCK_ROWS, first_only: bool = True,
) -> DataFrame:
    """Mondays that open away from the last Friday close, faded back to it.

    Only the first qualifying Monday after each last-seen Friday counts (all with ``first_only=False``).
    Needs ``atr``.
    """
    weekday = F.weekday("ts")
    usable = bars.filter(F.col("ix") >= warm_up)
    friday = F.when(weekday == 4, F.struct(F.col("close"), F.col("ix").alias("fix")))
    tagged = running(usable, {"_friday": ("last", friday)}, ["ix"], block_of(rows=rows))
    gap = F.col("open") - F.col("friday_close")
    mondays = (
        tagged.filter((weekday == 0) & F.col("_friday").isNotNull() & (F.col("atr") > 0))
        .withColumns({"friday_close": F.col("_friday.close"), "friday_ix": F.col("_friday.fix")})
        .withColumns({
            "gap_atr": F.try_divide(F.abs(gap), F.col("atr")),
            "gap_pct": F.try_divide(F.abs(gap), F.col("friday_close")) * 100,
            "gap_type": F.when(gap > 0, "up").otherwise("down"),
            "signal": F.when(gap > 0, -1).otherwise(1),
        })
        .drop("_friday")
    )
    if min_gap_atr is not None:
        mondays = mondays.filter(F.col("gap_atr") >= min_gap_atr)
    if min_gap_pct is not None:
        mondays = mondays.filter(F.col("gap_pct") >= min_gap_pct)
    if not first_only:
        return mondays
    first = F.row_number().over(Window.partitionBy(*KEYS, "friday_ix").orderBy("ix"))
    return mondays.withColumn("_r", first).filter(F.col("_r") == 1).drop("_r")
