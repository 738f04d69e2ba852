"""What comes before each block of a long series, when blocks act on a state one after the other.

A block's effect is a value of its own (a function on the state, or a part of it). Effects of ``fan`` consecutive blocks are
folded into one, level by level, until a series has one; on the way back down each block gets the state it is entered with.
No task handles more than ``fan`` effects of a series, however long the series is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.session import cut

FAN = 64


def to_bytes(table: np.ndarray) -> bytes:
    return np.ascontiguousarray(table, np.float64).tobytes()


def from_bytes(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def entered(
    effects: DataFrame, keys: Sequence[str], fold: Callable[[bytes, bytes], bytes], step: Callable[[bytes, bytes], bytes], start: bytes, fan: int = FAN,
) -> DataFrame:
    """(keys, _blk, _state): the state each block is entered with, from effects (keys, _blk, _effect).

    ``fold(a, b)`` is the effect of a and then b; ``step(state, effect)`` the state after it; ``start`` is the state at the
    start of a series. Blocks without an effect may be missing.
    """
    keys, blk = list(keys), T.StructField("_blk", T.LongType())
    fields = [f for f in effects.schema.fields if f.name in keys]
    up = T.StructType([*fields, blk, T.StructField("_effect", T.BinaryType())])
    down = T.StructType([*fields, blk, T.StructField("_state", T.BinaryType())])
    parent = F.floor(F.col("_blk") / fan)
    levels = [cut(effects.select(*keys, F.col("_blk").cast("long").alias("_blk"), "_effect"))]
    most = levels[0].agg(F.max("_blk")).first()[0] or 0

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_blk")
        head = part.iloc[:1].copy()
        return head.assign(_blk=head["_blk"] // fan, _effect=[reduce(fold, part["_effect"])])[up.names]

    def states(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_blk")
        state, out = part["_state"].iloc[0], []
        for effect in part["_effect"]:
            out.append(state)
            state = step(state, effect)
        return part.assign(_state=out)[down.names]

    while most >= fan:
        levels.append(cut(levels[-1].groupBy(*keys, parent.alias("_up")).applyInPandas(folded, up)))
        most //= fan
    top = levels.pop()
    out = top.withColumn("_state", F.lit(start)).groupBy(*keys).applyInPandas(states, down)
    while levels:
        above = out.select(*keys, F.col("_blk").alias("_up"), "_state")
        out = levels.pop().withColumn("_up", parent).join(above, [*keys, "_up"]).groupBy(*keys, "_up").applyInPandas(states, down)
    return out
