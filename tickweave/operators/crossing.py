"""First later row whose value passes a threshold, for thresholds that may be met arbitrarily late.

A plain range join pairs every event with every later row. Here rows are cut into blocks of positions. In its own block each
event climbs a pyramid of maxima and minima to the first part that contains a passing value and descends to the row, all
events of a block at once. Settled events leave at that point. The few that are left look among the extremes of the later
blocks of their range, then among the extremes of later ranges, and descend again. Every step deals events by their own block
(or by found block and slot), so that a series with most of the rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.operators.frames import BLOCK_ROWS, KEYS
from tickweave.session import cut

FAN = 256


def first_beyond(hi: np.ndarray, lo: np.ndarray, start: np.ndarray, up: np.ndarray, down: np.ndarray, strict: bool = True) -> np.ndarray:
    """For each threshold pair the first place from ``start`` on with hi beyond ``up`` or lo below ``down``; -1 without one."""
    his, los = [np.append(hi, -np.inf)], [np.append(lo, np.inf)]
    while len(his[-1]) > 1:
        if len(his[-1]) % 2:
            his[-1], los[-1] = np.append(his[-1], -np.inf), np.append(los[-1], np.inf)
        his.append(his[-1].reshape(-1, 2).max(axis=1))
        los.append(los[-1].reshape(-1, 2).min(axis=1))

    def passes(k: int, at: np.ndarray, who: np.ndarray) -> np.ndarray:
        h, l = his[k][at], los[k][at]
        return (h > up[who]) | (l < down[who]) if strict else (h >= up[who]) | (l <= down[who])

    at, level = np.minimum(start, len(hi)).astype(np.int64), np.full(len(start), -1)
    for k in range(len(his)):
        who = np.flatnonzero(level < 0)
        who = who[(at[who] % 2 == 1) | (k == len(his) - 1)]
        who = who[at[who] < len(his[k])]
        hit = passes(k, at[who], who)
        level[who[hit]] = k
        on = level < 0
        at[on] = (at[on] + 1) // 2  # an even place is the left half of its parent, an odd one is done
    for k in range(len(his) - 1, 0, -1):
        who = np.flatnonzero(level == k)
        at[who] *= 2
        level[who] = k - 1
        at[who] += ~passes(k - 1, at[who], who)
    return np.where(level < 0, -1, at)


def _parts(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """Runs of rows of one group in a sorted partition, and whether the group is a new one."""
    last = None
    for pdf in batches:
        keys = pdf[by]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            key = tuple(keys.iloc[a])
            yield key != last, pdf.iloc[a:b]
            last = key


def _searcher(by: list[str], out: list[str], strict: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per group: nodes come first and are held, events follow and are answered as they come."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for new, part in _parts(batches, by):
            held = [] if new else held
            events = part["_event"].to_numpy(bool)
            held.append(part.loc[~events, ["_at", "_hi", "_lo"]])
            asked = part.loc[events]
            if len(asked):
                held = [pd.concat(held, ignore_index=True)]
                at, hi, lo = (held[0][c].to_numpy() for c in ("_at", "_hi", "_lo"))
                start = np.searchsorted(at, asked["_at"].to_numpy(), side="right")
                place = first_beyond(hi, lo, start, asked["_hi"].to_numpy(), asked["_lo"].to_numpy(), strict)
                found = pd.array(np.append(at, 0)[place], dtype="Int64")
                found[place < 0] = pd.NA
                yield asked.assign(_found=found)[out]

    return run


def _search(nodes: DataFrame, events: DataFrame, by: Sequence[str], strict: bool) -> DataFrame:
    """Events (_at, _hi, _lo and others) with ``_found``: the first node of their group beyond ``_at`` that passes."""
    by, nodes = list(by), nodes.select(*by, "_at", "_hi", "_lo", F.lit(False).alias("_event"))
    both = nodes.unionByName(events.withColumn("_event", F.lit(True)), allowMissingColumns=True)
    sorted_rows = both.repartition(*by).sortWithinPartitions(*by, "_event", "_at")
    schema = T.StructType([*[f for f in both.schema.fields if f.name != "_event"], T.StructField("_found", T.LongType())])
    return sorted_rows.mapInPandas(_searcher(by, schema.names, strict), schema)


def first_cross(
    events: DataFrame, series: DataFrame, high: str = "close", low: str = "close", up: str = "up", down: str = "down",
    out: str = "cross_ix", strict: bool = True, rows: int = BLOCK_ROWS, fan: int = FAN, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``out``: the first ``ix`` after the event's own with ``high`` beyond ``up`` or ``low`` below ``down``.

    A null threshold turns that side off; null and NaN values pass nothing; no passing row gives null. ``series`` is read up
    to three times and ``events`` twice, so pass written tables rather than long plans.
    """
    keys, block = list(keys), F.floor(F.col("ix") / rows)
    limit = {"_hi": F.coalesce(up, F.lit(float("inf"))), "_lo": F.coalesce(down, F.lit(float("-inf")))}
    asked = events.filter(F.coalesce(up, down).isNotNull()).select(*keys, F.col("ix").alias("_at"), *[c.cast("double").alias(n) for n, c in limit.items()], block.alias("_blk")).distinct()
    point = lambda c, none: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(none))
    bars = series.select(*keys, block.alias("_blk"), F.col("ix").alias("_at"), point(high, float("-inf")).alias("_hi"), point(low, float("inf")).alias("_lo"))
    near = cut(_search(bars, asked, [*keys, "_blk"], strict))
    done = near.filter(F.col("_found").isNotNull())

    blocks = bars.groupBy(*keys, "_blk").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    ends = blocks.groupBy(*keys).agg(F.max("_blk").alias("_end"))
    rest = near.filter(F.col("_found").isNull()).drop("_found").join(ends, keys).filter(F.col("_blk") < F.col("_end")).drop("_end")
    if not rest.isEmpty():
        done = done.unionByName(_far(cut(rest), bars, cut(blocks), keys, strict, rows, fan))
    found = done.select(*keys, F.col("_at").alias("ix"), "_hi", "_lo", F.col("_found").alias(out))
    return events.withColumns({n: c.cast("double") for n, c in limit.items()}).join(found, [*keys, "ix", "_hi", "_lo"], "left").drop("_hi", "_lo")


def _far(rest: DataFrame, bars: DataFrame, blocks: DataFrame, keys: list[str], strict: bool, rows: int, fan: int) -> DataFrame:
    """Events that pass nothing in their own block, looked for in later blocks."""
    span = F.floor(F.col("_blk") / fan)
    own = rest.select(*keys, "_blk").distinct().withColumn("_span", span)
    level = blocks.select(*keys, F.col("_blk").alias("_n"), span.alias("_span"), "_hi", "_lo")
    row = F.col("_at").alias("_row")

    # later blocks of the own range, given to each block that asks
    nodes = own.join(level, [*keys, "_span"]).filter(F.col("_n") > F.col("_blk")).withColumnRenamed("_n", "_at")
    events = rest.select(*keys, "_blk", row, F.col("_blk").alias("_at"), "_hi", "_lo")
    first = cut(_search(nodes, events, [*keys, "_blk"], strict).drop("_at"))

    # later ranges, then the blocks of the found range
    spans = level.groupBy(*keys, F.col("_span").alias("_at")).agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    nodes = own.join(spans, keys).filter(F.col("_at") > F.col("_span"))
    events = first.filter(F.col("_found").isNull()).select(*keys, "_blk", "_row", F.floor(F.col("_blk") / fan).alias("_at"), "_hi", "_lo")
    second = cut(_search(nodes, events, [*keys, "_blk"], strict).drop("_at").filter(F.col("_found").isNotNull()).withColumnRenamed("_found", "_span"))
    nodes = second.select(*keys, "_blk", "_span").distinct().join(level, [*keys, "_span"]).withColumnRenamed("_n", "_at")
    events = second.withColumn("_at", F.lit(-1).cast("long"))
    second = _search(nodes, events, [*keys, "_blk", "_span"], strict).drop("_at", "_span")

    # the rows of the found block, given to each slot of the events that found it
    hits = cut(first.unionByName(second).filter(F.col("_found").isNotNull()).withColumn("_blk", F.col("_found")).drop("_found"))
    slots = hits.groupBy(*keys, "_blk").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_slots"))
    events = hits.join(slots, [*keys, "_blk"]).withColumn("_slot", F.pmod(F.xxhash64("_row", "_hi", "_lo"), F.col("_slots"))).drop("_slots").withColumn("_at", F.lit(-1).cast("long"))
    nodes = bars.join(slots, [*keys, "_blk"]).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1))).drop("_slots")
    return _search(nodes, events, [*keys, "_blk", "_slot"], strict).withColumn("_at", F.col("_row")).drop("_row", "_slot")
