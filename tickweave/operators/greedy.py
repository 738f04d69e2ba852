"""One open trade at a time: the greedy choice along a series, in parallel.

Whether a candidate is taken depends on all earlier ones, but only through one number: the bar until
which the account is busy. A block of candidates therefore acts on that number as a step function.
Blocks compute their functions independently, functions of neighbouring blocks are composed in a tree
(``scan``), and each block then replays from the number it was entered with. Neighbouring steps with one
result are one step, so composed functions stay short unless trades hardly ever end on a common bar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators import scan
from tickweave.operators.frames import BLOCK_ROWS

NEVER = 2**62
FREE = -1


def _block_steps(ix: np.ndarray, busy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step function of a block: entering busy until e < upper[k] (first such k) leaves busy until out[k]."""
    n = len(ix)
    nxt = np.searchsorted(ix, busy, side="right")
    out = busy.copy()
    for i in range(n - 1, -1, -1):
        if nxt[i] < n:
            out[i] = out[nxt[i]]
    return _runs(ix, out)


def _runs(upper: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last_of_run = np.append(out[1:] != out[:-1], True)
    return upper[last_of_run], out[last_of_run]


def _after(busy: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Busy until, after a block with these steps (upper, out)."""
    k = np.searchsorted(steps[:, 0], busy, side="right")
    return np.where(k < len(steps), np.append(steps[:, 1], 0.0)[k], busy)


def _composed(first: bytes, second: bytes) -> bytes:
    """Step function of a block followed by a later one."""
    a, b = scan.from_bytes(first, 2), scan.from_bytes(second, 2)
    upper, out = np.r_[a[:, 0], b[:, 0]], np.r_[_after(a[:, 1], b), b[:, 1]]
    return scan.to_bytes(np.stack(_runs(upper, out), axis=1))


def _moved(busy: bytes, steps: bytes) -> bytes:
    return scan.to_bytes(_after(scan.from_bytes(busy, 1)[0], scan.from_bytes(steps, 2)))


def _replay(ix: np.ndarray, busy: np.ndarray, entered: int) -> np.ndarray:
    taken = np.zeros(len(ix), dtype=bool)
    i = int(np.searchsorted(ix, entered, side="right"))
    while i < len(ix):
        taken[i] = True
        i = int(np.searchsorted(ix, busy[i], side="right"))
    return taken


def non_overlapping(
    trades: DataFrame, keys: Sequence[str], ix: str = "ix", exit_ix: str = "exit_ix",
    tie: Sequence[str] = (), rows: int = BLOCK_ROWS, fan: int = scan.FAN,
) -> DataFrame:
    """Trades taken when the next may start only after the bar on which the last one ended.

    A trade without an exit keeps the account busy to the end of the series. Of several candidates on
    one bar the first by ``tie`` is taken.
    """
    keys = list(keys)
    blocked = trades.withColumn("_blk", F.floor(F.col(ix) / rows)).withColumn(
        "_busy", F.greatest(F.coalesce(F.col(exit_ix), F.lit(NEVER)), F.col(ix)).cast("long")
    )
    key_fields = [f for f in blocked.schema.fields if f.name in keys]
    long = T.LongType()
    step_schema = T.StructType([*key_fields, T.StructField("_blk", long), T.StructField("_effect", T.BinaryType())])

    def steps(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([ix, *tie])
        found = _block_steps(block[ix].to_numpy(), block["_busy"].to_numpy())
        return block.iloc[:1].assign(_effect=[scan.to_bytes(np.stack(found, axis=1))])[step_schema.names]

    slim = blocked.select(*keys, "_blk", ix, "_busy", *[c for c in tie if c not in keys])
    effects = slim.groupBy(*keys, "_blk").applyInPandas(steps, step_schema)
    entered = scan.entered(effects, keys, _composed, _moved, scan.to_bytes(np.array([FREE])), fan)
    joined = slim.join(entered, [*keys, "_blk"])
    taken_schema = T.StructType([*key_fields, *[f for f in slim.schema.fields if f.name in (ix, *tie) and f.name not in keys]])

    def select(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([ix, *tie])
        keep = _replay(block[ix].to_numpy(), block["_busy"].to_numpy(), int(scan.from_bytes(block["_state"].iloc[0], 1)[0, 0]))
        return block.loc[keep, taken_schema.names]

    taken = joined.groupBy(*keys, "_blk").applyInPandas(select, taken_schema)
    return trades.join(taken, [*taken_schema.names], "left_semi")
