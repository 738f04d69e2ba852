"""Indicators per bar.

Each ``add_*`` function takes a frame and its window (see ``frames.in_frames``) and states in
``MARGIN`` how many earlier rows it can see, so several of them can share one exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickweave.operators.frames import BLOCK_ROWS, KEYS, SUB_ROWS, in_frames

EMA_SPANS = (9, 21, 50, 200)


def rolling(agg, value: Column | str, n: int, w: WindowSpec, nulls: int = 0) -> Column:
    """Trailing aggregate over ``n`` rows, null until ``n`` rows exist (``nulls``: leading nulls of the input)."""
    return F.when(F.col("ix") >= n - 1 + nulls, agg(value).over(w.rowsBetween(-(n - 1), 0)))


def previous_extreme(agg, value: str, n: int, w: WindowSpec) -> Column:
    """Extreme of the ``n`` rows before the current one, null until there are ``n``."""
    return F.when(F.col("ix") >= n, agg(value).over(w.rowsBetween(-n, -1)))


def true_range(w: WindowSpec, first: bool = True) -> Column:
    """True range; the first bar has high - low, or null with ``first=False``."""
    h, l = F.col("high"), F.col("low")
    prev = F.lag("close", 1).over(w)
    tr = F.greatest(h - l, F.abs(h - prev), F.abs(l - prev))
    return tr if first else F.when(prev.isNotNull(), tr)


def add_atr_sma(df: DataFrame, w: WindowSpec, n: int = 14, first: bool = False, out: str = "atr") -> DataFrame:
    """Simple-mean ATR. Margin: n rows back."""
    df = df.withColumn("_tr", true_range(w, first))
    return df.withColumn(out, rolling(F.avg, "_tr", n, w, 0 if first else 1)).drop("_tr")


def add_rsi_sma(df: DataFrame, w: WindowSpec, n: int = 14, out: str = "rsi") -> DataFrame:
    """Simple-mean RSI; no loss gives 100, no move at all gives null. Margin: n rows back."""
    change = F.coalesce(F.col("close") - F.lag("close", 1).over(w), F.lit(0.0))
    df = df.withColumn("_gain", F.greatest(change, F.lit(0.0))).withColumn("_loss", F.greatest(-change, F.lit(0.0)))
    gain, loss = rolling(F.avg, "_gain", n, w), rolling(F.avg, "_loss", n, w)
    df = df.withColumns({"_mg": gain, "_ml": loss})
    rsi = F.when(F.col("_ml") > 0, 100 - 100 / (1 + F.try_divide(F.col("_mg"), F.col("_ml")))).when(F.col("_mg") > 0, 100.0)
    return df.withColumn(out, rsi).drop("_gain", "_loss", "_mg", "_ml")


def add_bollinger(df: DataFrame, w: WindowSpec, n: int = 20, width: float = 2.0) -> DataFrame:
    """Band of ``width`` sample deviations around the mean. Margin: n - 1 rows back."""
    df = df.withColumns({
        "bb_mid": rolling(F.avg, "close", n, w),
        "_std": rolling(F.stddev_samp, "close", n, w),
    })
    df = df.withColumns({
        "bb_upper": F.col("bb_mid") + width * F.col("_std"),
        "bb_lower": F.col("bb_mid") - width * F.col("_std"),
    })
    return df.withColumn("bb_width", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid"))).drop("_std")


def add_volume(df: DataFrame, w: WindowSpec, n: int = 20, fill: float | None = None) -> DataFrame:
    """Mean volume and volume relative to it; ``fill`` replaces an undefined ratio. Margin: n - 1 rows back."""
    df = df.withColumn("volume_sma", rolling(F.avg, "volume", n, w))
    rvol = F.try_divide(F.col("volume"), F.col("volume_sma"))
    return df.withColumn("rvol", rvol if fill is None else F.coalesce(rvol, F.lit(fill)))


def add_returns(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Relative change over 1, 4 and 24 bars. Margin: 24 rows back."""
    close = F.col("close")
    steps = {"return_1h": 1, "return_4h": 4, "return_1d": 24}
    return df.withColumns({name: F.try_divide(close, F.lag("close", k).over(w)) - 1 for name, k in steps.items()})


def add_volatility_hour(df: DataFrame) -> DataFrame:
    """ATR in percent of the price, and the hour. No margin."""
    return df.withColumns({"volatility": F.try_divide(F.col("atr"), F.col("close")) * 100, "hour": F.hour("ts")})


def add_extrema(df: DataFrame, w: WindowSpec, n: int = 10) -> DataFrame:
    """Highest high and lowest low of the previous ``n`` bars. Margin: n rows back."""
    return df.withColumns({
        f"prev_high_{n}": previous_extreme(F.max, "high", n, w),
        f"prev_low_{n}": previous_extreme(F.min, "low", n, w),
    })


def add_centered_extrema(df: DataFrame, w: WindowSpec, n: int = 20) -> DataFrame:
    """Extremes of the ``n`` bars around the current one: n/2 before, n/2 - 1 after (looks ahead)."""
    frame = w.rowsBetween(-(n // 2), n // 2 - 1)
    full = F.count(F.lit(1)).over(frame) == n
    return df.withColumns({
        "swing_high": F.when(full, F.max("high").over(frame)),
        "swing_low": F.when(full, F.min("low").over(frame)),
    })


# --- exponential means -----------------------------------------------------------------------

def ewm_terms(span: int) -> int:
    """Sub-blocks after which an exponential mean has forgotten its past to double precision."""
    if span <= 1:
        return 1
    keep = 1.0 - 2.0 / (span + 1)
    return max(1, math.ceil(math.log(1e-18) / (SUB_ROWS * math.log(keep))))


def ewm_margin(*spans: int) -> int:
    """Rows back an exponential mean of these spans needs; a whole number of sub-blocks."""
    return SUB_ROWS * max(ewm_terms(s) for s in spans)


def add_ewm(df: DataFrame, w: WindowSpec, specs: dict[str, tuple[Column, int, int]], keys=KEYS) -> DataFrame:
    """Exponential means ``out -> (value, span, start)``; ``start`` is the first non-null position.

    y(t) = d y(t-1) + (1-d) x(t) with y(start) = x(start). Inside a sub-block of ``SUB_ROWS`` rows it
    is a running sum of x scaled by d^-j; the value carried into a sub-block is a short sum of the
    ends of earlier sub-blocks, because d^SUB_ROWS is tiny. No row sees more than ``ewm_margin`` rows.
    """
    j = F.col("ix") % SUB_ROWS
    inner = Window.partitionBy(*keys, "_blk", "_sub").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    local, carried, final = {}, {}, {}
    for out, (value, span, start) in specs.items():
        if span <= 1:  # a mean of one row is the value itself
            final[out] = F.when(F.col("ix") >= start, value)
            continue
        alpha = 2.0 / (span + 1)
        keep = 1.0 - alpha
        weight = F.when(F.col("ix") == start, 1.0).when(F.col("ix") < start, 0.0).otherwise(alpha)
        scaled = F.coalesce(value, F.lit(0.0)) * weight * F.pow(F.lit(keep), -j)
        local[f"_e_{out}"] = F.sum(scaled).over(inner) * F.pow(F.lit(keep), j)
        before = F.lit(0.0)
        for t in range(ewm_terms(span)):
            end = F.coalesce(F.lag(f"_e_{out}", 1 + SUB_ROWS * t).over(w), F.lit(0.0))
            before = before + end * F.lit(keep ** (SUB_ROWS * t))
        carried[f"_k_{out}"] = F.when(j == 0, before)
        final[out] = F.when(
            F.col("ix") >= start,
            F.col(f"_e_{out}") + F.coalesce(F.first(f"_k_{out}").over(inner), F.lit(0.0)) * F.pow(F.lit(keep), j + 1),
        )
    out = df.withColumns(local).withColumns(carried).withColumns(final)
    return out.drop(*local, *carried)


def add_core(df: DataFrame, w: WindowSpec, spans: tuple[int, ...] = EMA_SPANS, n: int = 14) -> DataFrame:
    """Exponential ATR, RSI and EMAs of the close in one pass. Margin: ``core_margin``."""
    change = F.col("close") - F.lag("close", 1).over(w)
    df = df.withColumns({"_tr": true_range(w), "_chg": change})
    specs = {
        "atr": (F.col("_tr"), n, 0),
        "_gain": (F.greatest(F.col("_chg"), F.lit(0.0)), n, 1),
        "_loss": (F.greatest(-F.col("_chg"), F.lit(0.0)), n, 1),
    }
    specs |= {f"ema_{s}": (F.col("close"), s, 0) for s in spans}
    df = add_ewm(df, w, specs)
    rsi = 100 - 100 / (1 + F.try_divide(F.col("_gain"), F.col("_loss")))
    return df.withColumn("rsi", rsi).drop("_tr", "_chg", "_gain", "_loss")


def core_margin(spans: tuple[int, ...] = EMA_SPANS, n: int = 14) -> int:
    return ewm_margin(n, *spans) + SUB_ROWS


def add_research(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Every research column; rows with any null are dropped by ``research_bars`` only."""
    df = add_core(df, w)
    df = add_bollinger(df, w)
    df = add_volume(df, w, fill=1.0)
    return add_volatility_hour(add_returns(df, w))


def live_bars(bars: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Indexed bars with the live columns: atr, rsi, ema_fast/slow/trend (21/50/200), volume_sma, rvol.

    Rows without atr, rsi or trend mean are dropped; ``ix`` keeps counting raw bars.
    """
    spans = (21, 50, 200)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return add_volume(add_core(df, w, spans), w)

    out = in_frames(bars, build, before=core_margin(spans), rows=rows)
    names = {"ema_21": "ema_fast", "ema_50": "ema_slow", "ema_200": "ema_trend"}
    return out.withColumnsRenamed(names).dropna(subset=["atr", "rsi", "ema_trend"])


def research_bars(bars: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Indexed bars with every research column; rows with a null are dropped."""
    return in_frames(bars, add_research, before=core_margin(), rows=rows).dropna()
