"""The scan that a live service runs: setups at the last bar, scored, sized and routed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickweave.functions import calendar as cal
from tickweave.functions.candles import confirmation
from tickweave.operators import indicators as ind
from tickweave.operators import open_zones, regime, risk, rules, scoring, signals, structure, zones
from tickweave.operators.frames import KEYS, in_frames, tail_rows
from tickweave.session import cut

MIN_BARS = 50


def entry_setups(bars: DataFrame) -> DataFrame:
    """Indexed bars with atr (read several times: pass a written table) to the setups at each last bar."""
    snap = structure.snapshot(bars, extra=["atr"])
    last = snap.select(*KEYS, "atr")
    snap = snap.withColumn("fib_confluence", zones.fib_confluence(F.col("close"), zones.swing_fib(F.col("highs"), F.col("lows"))))
    snap = snap.join(zones.candle_check(bars), [*KEYS], "left").drop("highs", "lows")
    setups = zones.both_directions(snap)
    checked = F.when(F.col("direction") == "buy", F.col("confirm_buy")).otherwise(F.col("confirm_sell"))
    setups = setups.withColumn("confirmation", F.coalesce(checked, F.lit("none")))
    return zones.build_entry(zones.match_zones(setups, zones.order_blocks(bars), zones.fair_value_gaps(bars, last)))


def scored_history(bars: DataFrame, assess: Callable[[DataFrame], DataFrame], news_configured: bool = True) -> DataFrame:
    """Score of every bar and direction from what is known at that bar, open order blocks and gaps included."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"confirm_buy": confirmation(w, 1), "confirm_sell": confirmation(w, -1)})

    assessed = cut(assess(bars))
    zone = open_zones.zones_as_of(assessed.filter("direction = 'buy'")).select(*KEYS, "ix", "direction", "ob_strength", F.col("fvg_ix").isNotNull().alias("has_fvg"))
    pit = structure.point_in_time(cut(in_frames(bars, build, before=2)))
    pit = pit.withColumn("fib_confluence", zones.fib_confluence(F.col("close"), zones.swing_fib(F.col("highs"), F.col("lows"))))
    known = pit.select(
        *KEYS, "ix", "trend", "price_zone", "bos_direction", "choch_direction", "fib_confluence", "confirm_buy", "confirm_sell"
    )
    both = assessed.join(known, [*KEYS, "ix"]).join(zone, [*KEYS, "ix", "direction"]).withColumns({
        "confirmation": F.when(F.col("direction") == "buy", F.col("confirm_buy")).otherwise(F.col("confirm_sell")),
        "session": cal.session_of(F.col("ts")),
    })
    return scoring.score(both, news_configured=news_configured)


def scan(
    bars: DataFrame, balance: float = 10000.0, risk_pct: float = 1.0, news_configured: bool = False,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Signal of each series at its last bar; ``blocked`` lists series (symbol, tf) that may not trade now."""
    spans = (21, 50, 200)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = ind.add_volume(ind.add_core(df, w, spans), w)
        return regime.add_live_regime(scoring.add_rsi_divergence(df, w), w)

    rich = in_frames(bars, build, before=ind.core_margin(spans) + 64)
    # Read a dozen times below, so it is written once instead of being derived from ticks each time.
    rich = cut(rich.withColumnsRenamed({"ema_21": "ema_fast", "ema_50": "ema_slow", "ema_200": "ema_trend"}))
    now_cols = ("ts", "ix", "close", "rsi", "rvol", "ema_fast", "ema_slow", "ema_trend", "div_buy", "div_sell", "regime")
    now = structure.last_bars(rich, *now_cols).filter(F.col("ix") >= MIN_BARS - 1)
    now = now.filter(cal.session_of(F.col("ts")).isin(*cal.ALLOWED_SESSIONS))
    if blocked is not None:
        now = now.join(blocked.select(*KEYS), [*KEYS], "left_anti")
    setups = entry_setups(rich).filter(rules.trend_prefilter(F.col("direction"), F.col("trend"), F.col("choch_direction")))
    setups = setups.drop("ts", "ix", "close").join(now, [*KEYS]).withColumns({
        "session": cal.session_of(F.col("ts")), "ob_strength": F.col("ob.strength"), "has_fvg": F.col("fvg").isNotNull(),
    })
    scored = scoring.score(scoring.assess_indicators(setups), news_configured=news_configured).filter("passed")
    sized = risk.risk_profile(scored, F.lit(balance), F.lit(risk_pct)).filter("valid")
    common = ("direction", "entry", "stop_loss", "tp1", "tp2", "tp3", "confidence", "score", "position_size", "reason", "strategy")
    smc = sized.withColumns({
        "confidence": F.col("confidence_pct"), "score": F.col("total"), "strategy": F.lit("smc_8gate"),
    })
    smc = signals_best(smc, ascending_direction=True).select(*KEYS, *common)

    # A trap is complete only on the third bar from the end, so the last 14 bars hold all it needs.
    tail = tail_rows(rich, 14, F.col("ix").desc())
    fb = in_frames(tail, lambda df, w: signals.add_false_breakout_setups(df, w), before=10, after=2)
    fb = fb.join(now.select(*KEYS, F.col("ix").alias("_now")), [*KEYS]).filter(F.col("available_ix") == F.col("_now"))
    fb = risk.risk_profile(signals.pick_best(fb), F.lit(balance), F.lit(risk_pct))
    fb = fb.filter(F.col("valid") & (F.col("confidence") >= scoring.FALSE_BREAKOUT_MIN_CONFIDENCE)).withColumns({
        "score": F.lit(scoring.FALSE_BREAKOUT_SCORE), "strategy": F.lit("false_breakout"),
    }).select(*KEYS, *common)
    return scoring.route(smc, fb, now.select(*KEYS, "regime"))


def signals_best(df: DataFrame, ascending_direction: bool) -> DataFrame:
    """Highest confidence per series; on a tie the buy (ascending) or the sell is kept."""
    order = F.col("direction").asc() if ascending_direction else F.col("direction").desc()
    return tail_rows(df, 1, [F.col("confidence").desc(), order])
