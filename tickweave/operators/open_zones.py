"""Order blocks and gaps as of every bar: the open zone that holds the close, from what is known at that bar.

A zone is an interval of bars: born when its last candle closes, dead when a later bar closes beyond it (order block) or
trades through it (gap). Order blocks look back a few bars. Gaps live arbitrarily long: their death is found by ``first_cross``,
and which of them are among the newest ``keep`` that are tall enough depends on the range at the bar, so a block of bars is
entered with the gaps that can still matter - those with fewer than ``keep`` newer ones at least as tall - found by ``scan``.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators import scan
from tickweave.operators.crossing import first_cross
from tickweave.operators.frames import BLOCK_ROWS, KEYS, in_frames
from tickweave.session import cut

#: Columns of a gap in a block's table: bar, +1 bullish or -1 bearish, top, bottom, bar of death (infinite while open).
GAP = 5
ZONES = ("ob_top", "ob_bottom", "ob_strength", "ob_ix", "fvg_top", "fvg_bottom", "fvg_ix")


def gaps(bars: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Every three-candle gap with its birth and death: (symbol, tf, ix, side, top, bottom, death)."""
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({"_h2": F.lag("high", 2).over(w), "_l2": F.lag("low", 2).over(w)})

    bull, bear = F.col("_h2") < F.col("low"), F.col("_l2") > F.col("high")
    found = in_frames(bars.select(*KEYS, "ix", "high", "low"), build, before=2, rows=rows).filter(bull | bear).select(
        *KEYS, "ix", F.when(bull, 1.0).otherwise(-1.0).alias("side"), F.when(bull, F.col("low")).otherwise(F.col("_l2")).alias("top"),
        F.when(bull, F.col("_h2")).otherwise(F.col("high")).alias("bottom"))
    marked = found.withColumns({"up": F.when(F.col("side") < 0, F.col("top")), "down": F.when(F.col("side") > 0, F.col("bottom"))})
    return first_cross(cut(marked), bars, high="high", low="low", out="death", strict=False, rows=rows).drop("up", "down")


def skyband(table: np.ndarray, keep: int) -> np.ndarray:
    """Gaps (oldest first) with fewer than ``keep`` newer ones that are at least as tall: no bar can ever choose another."""
    tall, heights, out = table[:, 2] - table[:, 3], [], []
    for k in range(len(table) - 1, -1, -1):
        if len(heights) - bisect_left(heights, tall[k]) < keep:
            out.append(k)
        insort(heights, tall[k])
        if len(heights) > keep:
            heights.pop(0)  # only the tallest ``keep`` decide
    return table[out[::-1]]


def _in_zone(price: np.ndarray, top: np.ndarray, bottom: np.ndarray, buffer: float = 0.002) -> np.ndarray:
    margin = (top - bottom) * buffer + top * 0.0001
    return (price >= bottom - margin) & (price <= top + margin)


def _before(values: np.ndarray, j: int) -> np.ndarray:
    """Values j rows earlier."""
    return np.r_[np.full(min(j, len(values)), np.nan), values[: max(0, len(values) - j)]]


def _blocks(bars: dict[str, np.ndarray], lookback: int, impulse_bars: int) -> dict[int, np.ndarray]:
    """Per direction (top, bottom, strength, ix) of the strongest open order block at each row, newest on ties."""
    o, h, l, c, atr, ix = (bars[x] for x in ("open", "high", "low", "close", "atr", "ix"))
    best = {side: np.full((4, len(c)), np.nan) for side in (1, -1)}
    up = down = low_close = high_close = np.full(len(c), np.nan)
    for j in range(1, min(lookback, len(c))):
        # extremes of the closes and of the first bars after the candle j rows back, up to this row
        low_close, high_close = np.fmin(low_close, _before(c, j - 1)), np.fmax(high_close, _before(c, j - 1))
        if j <= impulse_bars:
            up, down = np.fmax(up, _before(h, j - 1)), np.fmin(down, _before(l, j - 1))
        else:
            up, down = _span(h, j, impulse_bars, np.fmax), _span(l, j, impulse_bars, np.fmin)
        oo, hh, ll, cc = (_before(x, j) for x in (o, h, l, c))
        bull = oo > cc
        impulse = np.where(bull, up - ll, hh - down)
        top, bottom = np.where(bull, oo, hh), np.where(bull, ll, oo)
        with np.errstate(divide="ignore", invalid="ignore"):
            strength = np.floor(np.where(atr == 0, 3.0, np.minimum(3.0, impulse / atr)) * 100.0 + 0.5) / 100.0
        good = (_before(ix, j) >= 3) & (oo != cc) & (np.abs(cc - oo) >= atr * 0.1) & (impulse >= atr * 2)
        good &= np.where(bull, ~(low_close < ll), ~(high_close > hh)) & _in_zone(c, top, bottom)
        for side, at in best.items():
            take = good & (bull == (side > 0)) & ~(strength <= at[2])
            at[:, take] = np.stack([top, bottom, strength, _before(ix, j)])[:, take]
    return best


def _span(values: np.ndarray, j: int, n: int, pick: np.ufunc) -> np.ndarray:
    """Extreme of the ``n`` rows after the one j rows back."""
    out = _before(values, j - 1)
    for k in range(2, n + 1):
        out = pick(out, _before(values, j - k))
    return out


def _gaps(bars: dict[str, np.ndarray], known: np.ndarray, keep: int, min_atr: float) -> dict[int, np.ndarray]:
    """Per direction (top, bottom, ix) of the newest open gap among the newest ``keep`` tall enough at each row."""
    c, atr, ix = bars["close"], bars["atr"], bars["ix"]
    best = {side: np.full((3, len(c)), np.nan) for side in (1, -1)}
    at = np.searchsorted(known[:, 0], ix, side="right") - 1
    met, rows = np.zeros(len(c), np.int64), np.flatnonzero(at >= 0)
    while len(rows):
        gap = known[at[rows]]
        tall = gap[:, 2] - gap[:, 3] >= atr[rows] * min_atr
        met[rows] += tall
        held = tall & (met[rows] <= keep) & (gap[:, 4] > ix[rows]) & _in_zone(c[rows], gap[:, 2], gap[:, 3])
        for side, found in best.items():
            take = held & (gap[:, 1] == side) & np.isnan(found[2, rows])
            found[:, rows[take]] = gap[take][:, [2, 3, 0]].T
        at[rows] -= 1
        rows = rows[(at[rows] >= 0) & (met[rows] < keep) & (np.isnan(best[1][2, rows]) | np.isnan(best[-1][2, rows]))]
    return best


def zones_as_of(
    bars: DataFrame, lookback: int = 20, impulse_bars: int = 5, keep: int = 20, min_atr: float = 0.3, rows: int = BLOCK_ROWS, fan: int = scan.FAN,
) -> DataFrame:
    """(symbol, tf, ts, ix, direction and the columns of ZONES) for every bar and direction; null where no open zone holds the close.

    Needs indexed bars with atr, read three times: pass a written table. Only what is known at a bar counts, with the range
    of that bar, as ``order_blocks`` and ``fair_value_gaps`` would say on the bars up to it.
    """
    keys, rows = list(KEYS), max(rows, lookback)
    home = F.floor(F.col("ix") / rows)
    bars = bars.select(*keys, "ts", "ix", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "atr")])
    fields = [f for f in bars.schema.fields if f.name in keys]
    blk, table = T.StructField("_blk", T.LongType()), T.BinaryType()

    def listed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ix")
        every = part[["ix", "side", "top", "bottom", "death"]].to_numpy(np.float64, na_value=np.inf)
        return part.iloc[:1].assign(_own=[scan.to_bytes(every)], _effect=[scan.to_bytes(skyband(every, keep))])[[*keys, "_blk", "_own", "_effect"]]

    found = gaps(bars, rows).withColumn("_blk", home).groupBy(*keys, "_blk").applyInPandas(listed, T.StructType([*fields, blk, T.StructField("_own", table), T.StructField("_effect", table)]))
    empty = F.lit(b"")
    each = cut(bars.select(*keys, home.alias("_blk")).distinct().join(found, [*keys, "_blk"], "left").withColumns({c: F.coalesce(c, empty) for c in ("_own", "_effect")}))

    def merged(a: bytes, b: bytes) -> bytes:
        return scan.to_bytes(skyband(np.concatenate([scan.from_bytes(a, GAP), scan.from_bytes(b, GAP)]), keep))

    states = scan.entered(each, keys, merged, merged, b"", fan)
    known = each.join(states, [*keys, "_blk"]).select(*keys, "_blk", F.concat("_state", "_own").alias("_known"))
    known = known.toDF(*known.columns)  # names of its own beside those of the bars it comes from
    copies = F.array_compact(F.array(home, F.when(F.col("ix") % rows >= rows - lookback, home + 1)))
    framed = bars.withColumn("_blk", F.explode(copies))
    zone = T.StructType([*[f for f in bars.schema.fields if f.name in (*keys, "ts", "ix")], T.StructField("direction", T.StringType()), *[T.StructField(c, T.LongType() if c.endswith("ix") else T.DoubleType()) for c in ZONES]])

    def evaluate(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or known.empty:
            kinds = {T.TimestampType(): "datetime64[ns]", T.LongType(): "Int64", T.DoubleType(): "float64"}
            return pd.DataFrame({f.name: pd.Series([], dtype=kinds.get(f.dataType, "object")) for f in zone.fields})
        frame = frame.sort_values("ix")
        at = {c: frame[c].to_numpy(np.float64, na_value=np.nan) for c in ("open", "high", "low", "close", "atr", "ix")}
        blocks, open_gaps = _blocks(at, lookback, impulse_bars), _gaps(at, scan.from_bytes(known["_known"].iloc[0], GAP), keep, min_atr)
        own = (frame["ix"] // rows == frame["_blk"]).to_numpy()
        out = []
        for name, side in (("buy", 1), ("sell", -1)):
            values = dict(zip(ZONES, [*blocks[side], *open_gaps[side]]))
            out.append(frame[[*keys, "ts", "ix"]].assign(direction=name, **{c: _whole(v) if c.endswith("ix") else v for c, v in values.items()})[own])
        return pd.concat(out)[zone.names]

    return framed.groupBy(*keys, "_blk").cogroup(known.groupBy(*keys, "_blk")).applyInPandas(evaluate, zone)


def _whole(values: np.ndarray) -> pd.arrays.IntegerArray:
    none = np.isnan(values)
    return pd.arrays.IntegerArray(np.where(none, 0, values).astype(np.int64), none)
