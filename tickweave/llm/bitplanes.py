"""Centroid clustering on packed bit planes.

A component x becomes the integer floor(64 * x). Plane j of a vector is one 64-bit word that holds bit j of its 64 components
(two's complement, the highest plane counts negatively), so that

    v . c  =  sum over planes i of v and j of c of  weight(i) * weight(j) * popcount(V_i & C_j)

is an exact dot product, and with both squared lengths an exact squared distance. Vectors are packed once and written; each
round reads the planes, sends k rows of integer sums a task and changes k centroids. Nothing else reaches the driver.

Defined results: vectors that are null, do not have 64 components, or hold a null or non-finite one are left out; integers
beyond +-LIMIT count as +-LIMIT, so that distances fit a long; a sum beyond a long counts as the largest long. Rows with one
vec_id are separate vectors; a null vec_id hashes as the empty text. With fewer vectors than centroids each vector starts one;
an empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.session import cut

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Largest integer of a component: squared distances stay below 2^62.
LIMIT = 1 << 27
LONGEST = (1 << 63) - 1


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of double components as integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)


def pack(q: np.ndarray) -> np.ndarray:
    """Bit planes (n, planes) of integer vectors (n, 64), as few planes as the largest magnitude needs."""
    most = max(int(q.max(initial=0)), ~int(q.min(initial=0)))
    bits = np.stack([(q >> j) & 1 for j in range(most.bit_length() + 1)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(planes: int) -> np.ndarray:
    """Value of a set bit in each plane."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def unpacked(planes: np.ndarray) -> np.ndarray:
    """Bits (n, planes, 64) of packed vectors."""
    octets = np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), planes.shape[1], 8)
    return np.unpackbits(octets, axis=2, bitorder="little")


def dots(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products (n, k) of packed vectors and packed centroids by weighted AND-popcounts."""
    out = np.zeros((len(v), len(c)), np.int64)
    for i, wi in enumerate(weights(v.shape[1])):
        for j, wj in enumerate(weights(c.shape[1])):
            out += wi * wj * np.bitwise_count(v[:, i, None] & c[None, :, j]).astype(np.int64)
    return out


def nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance."""
    far = norms[:, None] - 2 * dots(v, pack(centroids)) + (centroids * centroids).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(v)), best]


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            q = quantised(np.array(pdf["v"].tolist(), np.float64))
            planes = pack(q)
            yield pd.DataFrame({"ident": pdf["ident"], "planes": [row.tobytes() for row in planes], "norm": (q * q).sum(axis=1)})


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of a batch with one number of planes, and their planes."""
    for pdf in batches:
        for _, part in pdf.groupby(pdf["planes"].str.len(), sort=False):
            yield part, np.frombuffer(b"".join(part["planes"]), "<u8").reshape(len(part), -1)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for part, planes in _alike(batches):
            best, _ = nearest(planes, part["norm"].to_numpy(), centroids)
            bits, w = unpacked(planes), weights(planes.shape[1])
            for k in np.unique(best):
                mine = bits[best == k]
                n[k] += len(mine)
                sums[k] += w @ mine.sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": list(sums[some])})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, planes in _alike(batches):
            best, far = nearest(planes, part["norm"].to_numpy(), centroids)
            yield pd.DataFrame({"ident": part["ident"], "cluster": best.astype(np.int32), "distance": far})

    return run


def packed_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ident, planes, norm) of the vectors that can be clustered; ids travel as text, so that none is rounded."""
    rows = vectors.select(F.col(ident).cast("string").alias("ident"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("v") == DIMS) & ~odd).mapInPandas(_packed, "ident string, planes binary, norm long")


def first_centroids(packed: DataFrame, k: int = CENTROIDS, seed: str = "1") -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:id``, in that order; equal ids by their planes."""
    rows = packed.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("ident", F.lit(""))), 256).alias("h"), "planes").orderBy("h", "planes").limit(k).collect()
    out = [weights(len(r.planes) // 8) @ unpacked(np.frombuffer(bytes(r.planes), "<u8")[None])[0].astype(np.int64) for r in rows]
    return np.array(out, np.int64).reshape(-1, DIMS)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the exact mean of their vectors, as before where they have none."""
    parts = packed.select("planes", "norm").mapInPandas(_sums(centroids), "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = centroids.copy()
    for r in cells.collect():  # k * 64 rows
        out[r["cluster"], r["dim"]] = r["s"] // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "1", ident: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Assignment (vec_id, cluster, distance) of each vector after the given rounds, and the final centroids (k, 64)."""
    packed = cut(packed_vectors(vectors, ident, vector))
    centroids = first_centroids(packed, k, seed)
    kind = vectors.select(ident).schema[0].dataType
    if not len(centroids):
        return packed.sparkSession.createDataFrame([], f"vec_id {kind.simpleString()}, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    assigned = packed.mapInPandas(_assigned(centroids), "ident string, cluster int, distance long")
    return cut(assigned.select(F.col("ident").cast(kind).alias("vec_id"), "cluster", "distance")), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assignments with the distance summed over the cluster and over all, and the digest of the final centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    total, clip = sum((r["s"] for r in sums), Decimal(0)), lambda x: min(int(x), LONGEST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(r["cluster"], clip(r["s"]), clip(total), digest[r["cluster"]]) for r in sums]
    small = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
