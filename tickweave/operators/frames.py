"""Skew-safe building blocks for ordered work on long series.

A window over ``partitionBy(symbol)`` sends a whole symbol to one task, and one symbol may hold a
third of all rows. Everything ordered in this library is therefore built from four pieces:

``dense_index``   position of a row in its series, from per-slice counts plus a prefix sum over the
                  small slice table;
``in_frames``     bounded windows: the series is cut into equal blocks of positions, each block is
                  given the few rows before and after it that its windows can see, and every window
                  of one call shares that single exchange and sort;
``running``       unbounded sums, extrema and last-known values: local part per block, then a carry
                  from the one-row-per-block summary;
``tail_rows``     the last rows of each series through a rank filter, which Spark turns into a
                  per-partition top-k before the shuffle.

The per-key summary tables hold one row per block. For bars their length is bounded by the calendar:
(time covered) / (bar length x rows per block).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol", "tf")
BLOCK_ROWS = 32768
SLICE_ROWS = 4096
SUB_ROWS = 512

# Length of each bar size in seconds.
TF_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800,
    "1h": 3600, "4h": 14400, "1d": 86400,
}

Build = Callable[[DataFrame, WindowSpec], DataFrame]


def tf_seconds(tf: Column) -> Column:
    out = F.lit(3600)
    for name, seconds in TF_SECONDS.items():
        out = F.when(tf == name, F.lit(seconds)).otherwise(out)
    return out


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_expr: Column,
    out: str = "ix",
) -> DataFrame:
    """Add the 0-based position of each row within ``keys``; ``slice_expr`` must grow with ``order``."""
    part = [*keys, "_slice"]
    sliced = df.withColumn("_slice", slice_expr)
    counts = sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*part).orderBy(*order)
    return (
        sliced.withColumn("_rn", F.row_number().over(local))
        .join(offsets, part)
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_slice", "_rn", "_off")
    )


def index_bars(bars: DataFrame, keys: Sequence[str] = KEYS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Position of each bar in its series; a slice covers the time of ``slice_rows`` bars."""
    seconds = tf_seconds(F.col("tf")) * F.lit(slice_rows)
    return dense_index(bars, keys, ["ts"], F.floor(F.unix_timestamp("ts") / seconds))


def in_frames(
    df: DataFrame,
    build: Build,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = KEYS,
    ix: str = "ix",
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``build(frame, window)`` on blocks of positions with ``before``/``after`` rows of margin.

    Windows inside ``build`` may look back at most ``before`` rows in total and ahead at most
    ``after`` rows. Blocks depend on position only, so a hot key is spread over as many tasks as it
    has blocks.
    """
    rows = math.ceil(max(rows, before, after, 1) / SUB_ROWS) * SUB_ROWS if before >= SUB_ROWS else max(rows, before, after, 1)
    pos = F.col(ix) % rows
    home = F.floor(F.col(ix) / rows)
    copies = [F.struct(home.alias("b"))]
    if after:
        copies.append(F.when((pos < after) & (home > 0), F.struct((home - 1).alias("b"))))
    if before:
        copies.append(F.when(pos >= rows - before, F.struct((home + 1).alias("b"))))
    if len(copies) > 1:
        frame = (
            df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
            .withColumn("_blk", F.col("_copy.b"))
            .drop("_copy")
        )
    else:
        frame = df.withColumn("_blk", home)
    # Ordering by sub-block first lets windows per sub-block share the same sort.
    frame = frame.withColumn("_sub", F.floor(F.col(ix) / SUB_ROWS))
    window = Window.partitionBy(*keys, "_blk").orderBy("_sub", ix)
    out = build(frame, window)
    return out.filter(F.floor(F.col(ix) / rows) == F.col("_blk")).drop("_blk", "_sub")


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    order: Sequence[str],
    block: Column,
    keys: Sequence[str] = KEYS,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` (last non-null) columns over the whole series of a key.

    ``reverse`` runs from the end of the series; ``exclusive`` leaves the current row out.
    """
    part = [*keys, "_blk"]
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    blocked = df.withColumn("_blk", block)
    for name, (_, expr) in specs.items():
        blocked = blocked.withColumn(f"_v_{name}", expr)
    local = (
        Window.partitionBy(*part)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    carry_window = (
        Window.partitionBy(*keys)
        .orderBy(direction("_blk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    position = F.struct(*[F.col(c) for c in order])
    totals, carries, locals_, merged = [], [], {}, {}
    for name, (kind, _) in specs.items():
        value, carried = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            totals.append(pick(value, F.when(value.isNotNull(), position)).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(carry_window).alias(f"_c_{name}"))
            locals_[f"_l_{name}"] = F.last(value, ignorenulls=True).over(local)
            merged[name] = F.coalesce(F.col(f"_l_{name}"), carried)
            continue
        agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        totals.append(agg(value).alias(f"_t_{name}"))
        carries.append(agg(f"_t_{name}").over(carry_window).alias(f"_c_{name}"))
        locals_[f"_l_{name}"] = agg(value).over(local)
        if kind == "sum":
            both = F.coalesce(carried, F.lit(0)) + F.coalesce(F.col(f"_l_{name}"), F.lit(0))
            merged[name] = F.when(carried.isNotNull() | F.col(f"_l_{name}").isNotNull(), both)
        else:
            merged[name] = (F.greatest if kind == "max" else F.least)(F.col(f"_l_{name}"), carried)
    summary = blocked.groupBy(*part).agg(*totals).select(*part, *carries)
    out = blocked.withColumns(locals_).join(summary, part).withColumns(merged)
    helpers = [f"_{p}_{name}" for name in specs for p in "vlc"]
    return out.drop("_blk", *helpers)


def block_of(ix: str = "ix", rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(ix) / rows)


def tail_rows(df: DataFrame, n: int, order: Column | Sequence[Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """The first ``n`` rows per key in the given order (pass descending columns for the last rows)."""
    cols = order if isinstance(order, (list, tuple)) else [order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*cols))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
