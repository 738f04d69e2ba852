"""Position size, risk profile and trading costs as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.numbers import fix
from tickweave.sources import dims


def position_size(balance: Column, risk_pct: Column, entry: Column, stop: Column) -> Column:
    """Lots for a share of the balance; prices over 100 count whole units, others ten-thousandths."""
    distance = F.abs(entry - stop)
    per_lot = F.when(entry > 100, distance * 100).otherwise(distance * 10000 * 10)
    lots = balance * (risk_pct / 100) / F.when(distance != 0, per_lot)
    return F.when(distance == 0, F.lit(0.0)).otherwise(fix(F.greatest(F.lit(0.01), F.least(lots, F.lit(100.0))), 2))


def risk_profile(
    df: DataFrame, balance: Column, risk_pct: Column, min_rr: float = 1.5,
    entry: str = "entry", stop: str = "stop_loss", tps: Sequence[str] = ("tp1", "tp2", "tp3"),
) -> DataFrame:
    """Reward/risk per target, lots, amount at risk and whether the first ratio is good enough."""
    risk = F.abs(F.col(entry) - F.col(stop))
    some = F.when(risk != 0, risk)
    ratios = {f"rr_tp{k}": F.coalesce(fix(F.abs(F.col(tp) - F.col(entry)) / some, 2), F.lit(0.0)) for k, tp in enumerate(tps, 1)}
    df = df.withColumns(ratios)
    valid = (risk != 0) & (F.col("rr_tp1") >= min_rr)
    return df.withColumns({
        "valid": valid,
        "position_size": F.when(valid, position_size(balance, risk_pct, F.col(entry), F.col(stop))).otherwise(0.0),
        "risk_amount": F.when(valid, fix(balance * risk_pct / 100, 2)).otherwise(0.0),
    })


def with_costs(df: DataFrame, pairs: DataFrame, spread_mult: Column | float = 1.0) -> DataFrame:
    """Round-trip cost in price units: ``cost_pips`` (spread + commission + slippage) and ``cost_px``.

    Unknown symbols take the default spread and pip size.
    """
    out = dims.with_dimension(
        df, pairs.select("symbol", "spread_pips", "pip_size", "spread_px", "slippage_px"), "symbol",
        {
            "spread_pips": F.lit(dims.DEFAULT_SPREAD_PIPS), "pip_size": F.lit(dims.DEFAULT_PIP_SIZE),
            "spread_px": F.lit(dims.DEFAULT_SPREAD_PX), "slippage_px": F.lit(dims.DEFAULT_SLIPPAGE_PX),
        },
    )
    mult = spread_mult if isinstance(spread_mult, Column) else F.lit(float(spread_mult))
    pip = F.col("pip_size")
    return out.withColumns({
        "cost_pips": F.col("spread_pips") * pip * mult + pip * 0.5 + pip * 0.5,
        "cost_px": F.col("spread_px") + F.col("slippage_px"),
    })
