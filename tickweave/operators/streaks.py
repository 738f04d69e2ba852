"""Signals inside streaks: a streak fires once it is long enough and has moved far enough, and then starts over.

What a block of bars needs of the past is the number of bars and the move since the last start or signal. A block with a start
in it leaves a state of its own. A block that lies within one streak is a function of that state: which bar fires first
depends on how far the streak has come, and the state it leaves depends on that bar. Such functions of neighbouring blocks
are composed in a tree (``scan``), so a streak may be arbitrarily long.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators import scan
from tickweave.operators.crossing import first_beyond
from tickweave.operators.frames import BLOCK_ROWS, KEYS

#: Rows of a block's function: (bars, reach, bars left, move left): it fires at its bar ``bars`` if the streak then has enough
#: bars and its move before the block is over -reach; the last row says what happens without (bars of the block, its move
#: added to the state), or, as the only row with no bars, the state the block leaves whatever came before.
WIDTH = 4


def _apply(state: np.ndarray, rows: np.ndarray, run: int) -> np.ndarray:
    """State (bars up to ``run``, move) after a block."""
    if rows[-1, 0] == 0:
        return rows[-1, 2:]
    fires = rows[:-1]
    hit = np.flatnonzero((state[0] + fires[:, 0] >= run) & (fires[:, 1] > -state[1]))
    if len(hit):
        return fires[hit[0], 2:]
    return np.array([min(run, state[0] + rows[-1, 0]), state[1] + rows[-1, 1]])


def _composed(run: int):
    def fold(first: bytes, second: bytes) -> bytes:
        a, b = scan.from_bytes(first, WIDTH), scan.from_bytes(second, WIDTH)
        if b[-1, 0] == 0:
            return second
        if a[-1, 0] == 0:
            return scan.to_bytes(np.r_[0.0, 0.0, _apply(a[-1, 2:], b, run)][None])
        length, move = a[-1, :2]
        fires = a[:-1].copy()
        for k, row in enumerate(fires):
            fires[k, 2:] = _apply(row[2:], b, run)
        later = b[:-1] + [length, move, 0, 0]
        rows = _reachable(np.concatenate([fires, later]), run)
        return scan.to_bytes(np.concatenate([rows, [[length + b[-1, 0], move + b[-1, 1], 0, 0]]]))

    return fold


def _reachable(rows: np.ndarray, run: int) -> np.ndarray:
    """Rows that can be the first to fire, those with one outcome in a row as one."""
    late = rows[:, 0] >= run
    before = np.maximum.accumulate(np.r_[-np.inf, np.where(late, rows[:, 1], -np.inf)])[:-1]
    rows = rows[~late | (rows[:, 1] > before)]
    same = np.r_[(rows[1:, 2:] == rows[:-1, 2:]).all(axis=1) & (rows[:-1, 0] >= run), False]
    return rows[~same]


def _effect(start: np.ndarray, move: np.ndarray, least: np.ndarray, run: int) -> bytes:
    """Function of a block with these bars."""
    breaks = np.flatnonzero(start)
    if len(breaks):
        at = breaks[-1]
        n, moved, _ = _walk((0, 0.0), start[at:], move[at:], least[at:], run)
        return scan.to_bytes(np.array([[0.0, 0.0, min(n, run), moved]]))
    total = np.cumsum(move)
    reach, size = total - least, len(move)
    after = first_beyond(reach, np.full(size, np.inf), np.arange(size) + run, total, np.full(size, -np.inf))
    left = np.stack([np.minimum(size - 1 - np.arange(size), run), total[-1] - total], axis=1).astype(float)
    for k in range(size - 1, -1, -1):
        if after[k] >= 0:
            left[k] = left[after[k]]
    rows = np.column_stack([np.arange(1.0, size + 1), reach, left])
    rows = _reachable(rows[np.isfinite(reach)], run)
    return scan.to_bytes(np.concatenate([rows, [[size, total[-1], 0, 0]]]))


def _walk(state: Sequence[float], start: np.ndarray, move: np.ndarray, least: np.ndarray, run: int) -> tuple[int, float, list[int]]:
    """State after some bars and the places that fired."""
    n, moved, fired = int(state[0]), float(state[1]), []
    for k, (new, m, t) in enumerate(zip(start.tolist(), move.tolist(), least.tolist())):
        if new:
            n, moved = 0, 0.0
        n, moved = n + 1, moved + m
        if n >= run and moved > t:
            fired.append(k)
            n, moved = 0, 0.0
    return n, moved, fired


def streak_signals(marked: DataFrame, run: int, rows: int = BLOCK_ROWS, fan: int = scan.FAN, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows that fire, of bars (keys, ix, ts, start, move, least, signal): a streak begins where ``start`` is true, and
    fires when it has ``run`` bars and moved more than ``least`` (null: never) since it began or fired last."""
    keys = list(keys)
    df = marked.select(*keys, "ix", "ts", "start", "move", F.coalesce("least", F.lit(float("inf"))).alias("least"), "signal", F.floor(F.col("ix") / rows).alias("_blk"))
    fields = [f for f in df.schema.fields if f.name in keys]
    effect = T.StructType([*fields, T.StructField("_blk", T.LongType()), T.StructField("_effect", T.BinaryType())])
    out = T.StructType([f for f in df.schema.fields if f.name in (*keys, "ix", "ts", "signal")])

    def columns(part: pd.DataFrame) -> list[np.ndarray]:
        return [part["start"].to_numpy(bool), part["move"].to_numpy(float), part["least"].to_numpy(float)]

    def function(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ix")
        return part.iloc[:1].assign(_effect=[_effect(*columns(part), run)])[effect.names]

    def fired(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ix")
        *_, at = _walk(scan.from_bytes(part["_state"].iloc[0], 2)[0], *columns(part), run)
        return part.iloc[at][out.names]

    step = lambda state, rows: scan.to_bytes(_apply(scan.from_bytes(state, 2)[0], scan.from_bytes(rows, WIDTH), run)[None])
    states = scan.entered(df.groupBy(*keys, "_blk").applyInPandas(function, effect), keys, _composed(run), step, scan.to_bytes(np.zeros((1, 2))), fan)
    return df.join(states, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(fired, out)
