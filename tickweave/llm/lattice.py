"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed, cosine verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.common import groups
from tickweave.llm.components import components
from tickweave.session import cut

#: Tables, probed neighbours, and the length of a projected unit in lattice units. Two vectors of cosine 0.9 meet in one
#: table with probability 0.8, and in none with 6e-5.
TABLES, PROBES, CELL, SEED = 6, 4, 2.0, 11
SIMILAR = 0.9
#: Rows of a bucket that one block holds; larger buckets are compared block by block.
BLOCK_ROWS = 1024


def _checkered(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum: round, and mend an odd sum where rounding cost most."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: of the even-sum whole points and the same shifted by one half, the closer."""
    whole, half = _checkered(x), _checkered(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    return np.array(out + [np.array(s) for s in product((0.5, -0.5), repeat=8) if np.prod(s) > 0])


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """Own lattice cell of each projected point and its nearest neighbouring ones: (points, 1 + probes, 8)."""
    steps, home = _shortest(), decode(x)
    # nearest neighbours by |off - step|: their steps agree most with the offset within the cell, as all are equally long
    near = np.argpartition(-(x - home) @ steps.T, probes, axis=1)[:, :probes] if probes else np.empty((len(x), 0), int)
    return np.concatenate([home[:, None], home[:, None] + steps[near]], axis=1)


def unscaled(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision times the power of two that brings their largest component near one: no rounding, and
    neither overflow nor underflow of squares."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _hashed(tables: int, probes: int, cell: float, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        multiplier = np.random.default_rng(seed).integers(1, 1 << 62, 8, dtype=np.int64) | 1
        for pdf in batches:
            size = pdf.v.str.len()
            for width, rows in pdf.groupby(size):
                v = unscaled(np.stack(rows.v.to_numpy()))
                v /= np.linalg.norm(v, axis=1)[:, None]
                for t in range(tables):
                    rng = np.random.default_rng([seed, t, width])
                    x = v @ rng.normal(size=(width, 8)) / cell + 2 * rng.random(8)
                    points = (2 * cells(x, probes)).astype(np.int64)
                    keys = (points * multiplier).sum(axis=2) * np.int64(2 * t + 1) + np.int64(width)
                    for k in range(1 + probes):
                        yield pd.DataFrame({"bucket": keys[:, k], "home": k == 0, "id": rows.id.to_numpy(), "v": rows.v.to_numpy()})

    return run


def _linked(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for g in groups(batches, "bucket", "i", "j"):
            left, right = g.left.to_numpy(), ~g.left.to_numpy()
            if not left.any() or not right.any():
                continue
            v = unscaled(np.stack(g.v.to_numpy()))
            norm = np.sqrt((v * v).sum(axis=1))
            ids = g.id.to_numpy()
            cosine = (v[left] @ v[right].T) / np.outer(norm[left], norm[right])
            a, b = np.nonzero(cosine >= least)
            a, b = ids[left][a], ids[right][b]
            on = a != b
            found.append(pd.DataFrame({"a": np.minimum(a, b)[on], "b": np.maximum(a, b)[on]}))
            held += on.sum()
            if held > 50_000:
                yield pd.concat(found).drop_duplicates()
                found, held = [], 0
        if found:
            yield pd.concat(found).drop_duplicates()

    return run


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, not zero, all components finite."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, least: float = SIMILAR, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, seed: int = SEED) -> DataFrame:
    """Pairs (a, b), a < b, of the ids of different vectors (id, v) with a cosine of at least ``least`` that share a cell.

    A vector meets those whose own cell is its own or one of its probed neighbours. Buckets are dealt in pairs of blocks of
    BLOCK_ROWS rows, each of which is one matrix product in its task, so a hot bucket spreads and no pairs are written but links.
    """
    kind = vectors.schema["v"].dataType.simpleString()
    hashed = cut(vectors.select("id", "v").mapInPandas(_hashed(tables, probes, cell, seed), f"bucket long, home boolean, id long, v {kind}"))
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("every"), F.sum(F.col("home").cast("int")).alias("homes")).filter("homes >= 1 and every >= 2")
    sizes = sizes.select("bucket", F.ceil(F.col("every") / BLOCK_ROWS).cast("int").alias("n_left"), F.ceil(F.col("homes") / BLOCK_ROWS).cast("int").alias("n_right"))
    rows = hashed.join(sizes, "bucket")
    i, j = F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_left")).cast("int"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("n_right")).cast("int")
    left = rows.select("bucket", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"), F.lit(True).alias("left"), "id", "v")
    right = rows.filter("home").select("bucket", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("left"), "id", "v")
    dealt = left.unionByName(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInPandas(_linked(least), "a long, b long").distinct()


def near_duplicates(rows: DataFrame, least: float = SIMILAR, **settings) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row (vec_id, embedding), whatever its other columns.

    Equal vectors are one node with a count, which enters the links of its neighbours; links between equal rows count, too.
    Vectors without a direction (null, zero, with null or non-finite components) link with nothing. Vectors of different
    lengths never link. Rows that share a vec_id are rows of their own in n_links and one node in components. Empty tables
    give empty results.
    """
    single = rows.schema["embedding"].dataType == T.ArrayType(T.FloatType(), rows.schema["embedding"].dataType.containsNull)
    kind = "float" if single else "double"  # single precision stays as it is until a task widens it: half the bytes to move
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    good = base.filter(usable(F.col("v")))
    # -0.0 and 0.0 are one component value
    key = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    nodes = cut(good.withColumn("v", key).groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).filter("id is not null"))
    pairs = cut(links(nodes, least, **settings))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(nodes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("beside"))
    found = components(pairs).withColumnRenamed("id", "a")
    told = nodes.select(F.col("id").alias("a"), "v", "copies").join(beside, "a", "left").join(found, "a", "left")
    told = told.select("v", (F.coalesce("beside", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "a").alias("c"))
    every = base.withColumn("v", F.when(usable(F.col("v")), key))
    out = every.join(told, "v", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
