"""Confluence of indicators, the score of a setup and the choice between strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions.calendar import session_points
from tickweave.functions.numbers import fix
from tickweave.operators.frames import KEYS
from tickweave.operators.zones import kind_of

# Highest points per category and the limits a signal has to reach.
WEIGHTS = {
    "market_structure": 5, "entry_zone": 4, "indicators": 3,
    "strategy_confluence": 3, "session_timing": 3, "news_clear": 2,
}
MIN_SCORE = 11
MIN_CONFIDENCE = 55.0
FALSE_BREAKOUT_SCORE = 14
FALSE_BREAKOUT_MIN_CONFIDENCE = 50.0


def add_rsi_divergence(df: DataFrame, w: WindowSpec, n: int = 10) -> DataFrame:
    """``div_buy``/``div_sell``: new extreme of the close within ``n`` bars that the RSI does not confirm.

    Margin: n - 1 rows back.
    """
    past = w.rowsBetween(-(n - 1), -1)
    ready = F.col("ix") >= n - 1
    no = F.lit(False)
    return df.withColumns({
        "div_buy": F.coalesce(ready & (F.col("close") < F.min("close").over(past)) & (F.col("rsi") > F.min("rsi").over(past)), no),
        "div_sell": F.coalesce(ready & (F.col("close") > F.max("close").over(past)) & (F.col("rsi") < F.max("rsi").over(past)), no),
    })


def assess_indicators(df: DataFrame) -> DataFrame:
    """Labels per row and direction from rsi, ema_fast/slow/trend, rvol and the divergence flags."""
    buy = F.col("direction") == "buy"
    rsi, close = F.col("rsi"), F.col("close")
    fast, slow, trend = F.col("ema_fast"), F.col("ema_slow"), F.col("ema_trend")
    rsi_signal = F.when(
        buy, F.when(rsi.between(40, 65), "bullish").when(rsi < 70, "neutral").otherwise("bearish")
    ).otherwise(F.when(rsi.between(35, 60), "bearish").when(rsi > 30, "neutral").otherwise("bullish"))
    bias = F.when((fast > slow) & (close > trend), "bullish").when((fast < slow) & (close < trend), "bearish").otherwise("mixed")
    details = {"rsi": (rsi, 2), "ema_fast": (fast, 5), "ema_slow": (slow, 5), "ema_trend": (trend, 5), "rvol": (F.coalesce("rvol", F.lit(1.0)), 2)}
    return df.withColumns({
        "rsi_signal": rsi_signal,
        "rsi_divergence": F.when(buy, F.col("div_buy")).otherwise(F.col("div_sell")),
        "ema_bias": bias,
        "above_trend_ema": close > trend,
        "volume_elevated": F.coalesce(F.col("rvol") >= 1.2, F.lit(False)),
        "details": F.create_map(*[x for name, (c, d) in details.items() for x in (F.lit(name), fix(c, d))]),
    })


def _points(cond: Column, n: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)


def score(df: DataFrame, news_clear: Column | bool = True, news_configured: bool = False) -> DataFrame:
    """Six capped categories, their total, confidence in percent, and whether the signal passes.

    Needs direction, trend, bos/choch_direction, price_zone, ob_strength (null without a block), has_fvg,
    fib_confluence, confirmation, session and the columns of ``assess_indicators``. News points need a
    configured news source.
    """
    kind = kind_of(F.col("direction"))
    buy = F.col("direction") == "buy"
    right_half = F.when(buy, "discount").otherwise("premium")
    strength = F.col("ob_strength")
    clear = news_clear if isinstance(news_clear, Column) else F.lit(news_clear)
    raw = {
        "market_structure": _points(F.col("trend") == kind, 2) + _points(F.col("bos_direction") == kind, 2)
        + _points(F.col("choch_direction") == kind, 1) + _points(F.col("price_zone") == right_half, 1),
        "entry_zone": F.when(strength.isNull(), 0).when(strength >= 2, 2).otherwise(1) + _points(F.col("has_fvg"), 1)
        + _points(F.col("fib_confluence"), 1) + _points(F.col("confirmation") != "none", 1),
        "indicators": _points(F.col("rsi_signal") == kind, 1) + _points(F.col("rsi_divergence"), 1)
        + _points(F.col("ema_bias") == kind, 1) + _points(F.col("volume_elevated"), 1),
        "strategy_confluence": F.lit(0),
        "session_timing": session_points(F.col("session")),
        "news_clear": F.when(clear & F.lit(news_configured), WEIGHTS["news_clear"]).otherwise(0),
    }
    capped = {f"pts_{name}": F.least(points, F.lit(WEIGHTS[name])).cast("int") for name, points in raw.items()}
    df = df.withColumns(capped)
    most = sum(WEIGHTS.values())
    total = sum((F.col(c) for c in capped), F.lit(0))
    df = df.withColumns({"total": total.cast("int"), "max_possible": F.lit(most)})
    df = df.withColumn("confidence_pct", fix(F.col("total") / most * 100, 1))
    enough, sure = F.col("total") >= MIN_SCORE, F.col("confidence_pct") >= MIN_CONFIDENCE
    reject = (
        F.when(enough & sure, "")
        .when(~enough, F.format_string(f"Score %d/{most} below threshold ({MIN_SCORE})", F.col("total")))
        .otherwise(F.format_string(f"Confidence %.1f%% below minimum ({MIN_CONFIDENCE}%%)", F.col("confidence_pct")))
    )
    breakdown = F.create_map(*[x for name in WEIGHTS for x in (F.lit(name), F.col(f"pts_{name}"))])
    return df.withColumns({"passed": enough & sure, "reject_reason": reject, "breakdown": breakdown})


# --- vector score ----------------------------------------------------------------------------

def add_composite(df: DataFrame, directional: bool = True) -> DataFrame:
    """Score from the structure flags of every bar.

    As published the two totals are the same number, because flags of both directions are added; with
    ``directional`` each total counts only its own flags. Needs vector flags, ema_21/50, rvol, session.
    """
    def side(s: str, other: str) -> dict[str, Column]:
        def flag(name: str, n: int) -> Column:
            own = _points(F.col(f"{name}_{s}"), n)
            return own if directional else own + _points(F.col(f"{name}_{other}"), n)
        engulf = _points(F.col(f"{s}_engulf"), 1)
        ema = _points(F.col("ema_21") > F.col("ema_50") if s == "bull" else F.col("ema_21") < F.col("ema_50"), 1)
        if not directional:
            engulf = engulf + _points(F.col(f"{other}_engulf"), 1)
            ema = _points(F.col("ema_21") != F.col("ema_50"), 1)
        return {
            "ms": F.least(flag("trend", 2) + flag("bos", 2) + flag("choch", 1), F.lit(5)),
            "ez": F.least(flag("entry", 2) + engulf, F.lit(4)),
            "ind": F.least(ema + _points(F.col("rvol") > 1.5, 1), F.lit(3)),
        }

    rest = session_points(F.col("session")) + F.lit(2)
    buy, sell = side("bull", "bear"), side("bear", "bull")
    return df.withColumns({
        **{f"{k}_buy": v for k, v in buy.items()}, **{f"{k}_sell": v for k, v in sell.items()},
        "total_buy": sum(buy.values(), rest), "total_sell": sum(sell.values(), rest),
    })


# --- routing ---------------------------------------------------------------------------------

def route(smc: DataFrame, fb: DataFrame, regime: DataFrame, keys=KEYS) -> DataFrame:
    """One signal per key: structure signals in moving markets, false breakouts in quiet ones.

    In any other regime the higher confidence wins and structure signals win ties; a lone signal is
    taken in every regime. Both inputs hold one row per key with the same columns besides the keys.
    """
    cols = [c for c in smc.columns if c not in keys]
    left = smc.select(*keys, F.struct(*cols).alias("_smc"))
    right = fb.select(*keys, F.struct(*cols).alias("_fb"))
    both = left.join(right, list(keys), "full_outer").join(regime.select(*keys, "regime"), list(keys), "left")
    s, f = F.col("_smc"), F.col("_fb")
    take_smc = (
        F.when(f.isNull(), True).when(s.isNull(), False)
        .when(F.col("regime").isin("VOLATILE", "TRENDING"), True).when(F.col("regime").isin("RANGING", "QUIET"), False)
        .otherwise(s["confidence"] >= f["confidence"])
    )
    return both.withColumn("_c", F.when(take_smc, s).otherwise(f)).select(*keys, "regime", "_c.*")
