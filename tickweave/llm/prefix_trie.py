"""Prefix trie of conversations, with count-min screening.

A turn is known by its place in the conversation, role and text; the digest of a prefix is the xor of two 64-bit hashes over its
turns, so a prefix of any length comes from running xors over blocks of turns and a carry from one row a block. Texts are
hashed where they lie; what is shuffled is a row of numbers a turn.

Screening: a count-min sketch (ROWS rows of counters that stop at two) takes the digests of all prefixes. It never counts too
few, so an estimate of one proves that a prefix occurs once. Such a node needs no grouping: it is written where its row lies.
Only prefixes that may be shared are shuffled and grouped exactly, by depth and 128 bits of digest. The sketch is made by task
and merged in pieces of SLICE counters; its size follows the number of prefixes up to MOST_CELLS a row, so that 4 MB a row is
the most that is sent to workers. With more prefixes than that it proves less and more is grouped; results do not change.

Sums over subtrees need no walk. A node is represented by its smallest member c; from some depth r(c) on, c represents all its
own prefixes. With r(c), the text before r(c) and whether c ends in a childless node, a node's children, leaves and saved text
are sums over its members, taken in one aggregation that combines before the shuffle.

Defined results: turns are ordered by turn (null first), then role, then md5 of the text; null roles and texts are empty;
repeated rows are repeated turns; rows without a conv_id belong to no conversation; an empty table has no nodes. Columns other than
the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.session import cut

#: Contract: turns are taken from the first conversation of each HEAD_SPAN ids, up to HEAD_TURNS - 1 of them.
HEAD_SPAN, HEAD_TURNS = 100, 6
#: Turns of a conversation that one running window takes.
BLOCK = 1024
#: The sketch: rows, least and most counters a row, counters a piece.
ROWS, LEAST_CELLS, MOST_CELLS, SLICE = 3, 1 << 16, 1 << 25, 1 << 16
#: Ids whose ends are joined in one string before a node's digest takes them, as a power of two.
ENDS_SHIFT = 10
NODE = ("depth", "x", "y")


def _hashes(at: Column) -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64(at, "role", "key").alias("hx"), F.xxhash64(F.lit(1), "key", "role", at).alias("hy")]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, role, key, chars) of every turn: its place from 1 on, balanced whatever a conversation weighs."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text).alias("key"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", "turn", "role", "key"]
    ranged = cut(rows.repartitionByRange(*order).withColumn("piece", F.spark_partition_id()))
    within = F.row_number().over(W.partitionBy("conv_id", "piece").orderBy("turn", "role", "key"))
    count = ranged.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = count.select("conv_id", "piece", (F.sum("n").over(W.partitionBy("conv_id").orderBy("piece")) - F.col("n")).alias("before"))
    return ranged.withColumn("w", within).join(before, ["conv_id", "piece"]).select("conv_id", (F.col("before") + F.col("w")).alias("at"), "role", "key", "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the rebuilt conversations and (conv_id, n): their lengths, 0 included."""
    first = F.col("conv_id") - F.col("conv_id") % HEAD_SPAN
    heads = rows.filter((F.col("conv_id") % HEAD_SPAN == 0) & (F.col("at") < HEAD_TURNS)).groupBy(F.col("conv_id").alias("first"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("at", "role", "key", "chars"))).alias("head"))  # at most five turns
    own = rows.groupBy("conv_id").agg(F.max("at").alias("own"))
    each = own.select("conv_id", "own", first.alias("first"), (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).cast("int").alias("h")).join(heads, "first", "left")
    each = each.withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.array().cast("array<struct<at:bigint,role:string,key:string,chars:bigint>>")))
    each = cut(each.withColumn("k", F.size("head")).select("conv_id", "h", "k", "head", (F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))).alias("n")))
    taken = each.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    rest = rows.join(each.select("conv_id", "h", "k"), "conv_id").filter(F.col("at") > F.col("h"))
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "role", "key", "chars")
    return taken.unionByName(rest), each.select("conv_id", "n")


def prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each conversation and depth: digest (x, y) of the prefix, (px, py) of its parent, characters of the last text and before it, length n."""
    rows = rows.select("conv_id", F.col("at").alias("depth"), F.shiftright("at", BLOCK.bit_length() - 1).alias("block"), "chars", *_hashes(F.col("at")))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"), F.sum("chars").alias("bc"))
    over = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carry = sums.select("conv_id", "block", *[F.coalesce(f(c).over(over), zero).alias(c) for f, c in ((F.bit_xor, "bx"), (F.bit_xor, "by"), (F.sum, "bc"))])
    run = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "block", "depth", "chars", "hx", "hy", F.bit_xor("hx").over(run).alias("rx"), F.bit_xor("hy").over(run).alias("ry"), F.sum("chars").over(run).alias("rc"))
    rows = rows.join(carry, ["conv_id", "block"]).withColumn("x", F.col("rx").bitwiseXOR(F.col("bx"))).withColumn("y", F.col("ry").bitwiseXOR(F.col("by")))
    deep = rows.join(lengths, "conv_id").select(
        "conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "chars",
        (F.col("rc") + F.col("bc") - F.col("chars")).alias("before"), "n")
    return deep.unionByName(lengths.select("conv_id", *[zero.alias(c) for c in ("depth", "x", "y", "px", "py", "chars", "before")], "n"))


class Sketch:
    """Counters that stop at two, as a bit for "seen" and a bit for "seen again" in each row."""

    def __init__(self, cells: int):
        self.cells = cells

    def places(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Counter of each digest in each row."""
        x, y = x.view(np.uint64), y.view(np.uint64)
        return [((x + np.uint64(r) * y) >> np.uint64(20)) % np.uint64(self.cells) for r in range(ROWS)]

    def counted(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(row, piece, seen, again) of the prefixes of a partition, pieces without any left out."""
        counts = np.zeros((ROWS, self.cells), np.uint8)
        for pdf in batches:
            for row, at in zip(counts, self.places(pdf["x"].to_numpy(), pdf["y"].to_numpy())):
                once, n = np.unique(at, return_counts=True)
                row[once] = np.minimum(row[once] + np.minimum(n, 2), 2)
        for r, row in enumerate(counts):
            for p, piece in enumerate(row.reshape(-1, SLICE)):
                if piece.any():
                    bits = [np.packbits(piece >= k, bitorder="little").tobytes() for k in (1, 2)]
                    yield pd.DataFrame({"r": [r], "piece": [p], "seen": bits[:1], "again": bits[1:]})

    @staticmethod
    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each (row, piece) of a partition: counters added up to two."""
        held: dict[tuple[int, int], tuple[int, int]] = {}
        for pdf in batches:
            for r, p, seen, again in zip(pdf["r"], pdf["piece"], pdf["seen"], pdf["again"]):
                s, a = int.from_bytes(seen, "little"), int.from_bytes(again, "little")
                s0, a0 = held.get((r, p), (0, 0))
                held[r, p] = s | s0, a | a0 | (s & s0)
        size = SLICE // 8
        yield pd.DataFrame({"r": [k[0] for k in held], "piece": [k[1] for k in held], "again": [a.to_bytes(size, "little") for _, a in held.values()]})


def screened(rows: DataFrame) -> DataFrame:
    """Rows with ``shared`` and ``under``: whether the prefix, and its parent, may be shared; false is proven."""
    spark, deep = rows.sparkSession, rows.filter("depth > 0")
    wanted = min(8 * deep.count(), MOST_CELLS)
    cells = max(LEAST_CELLS, 1 << max(0, wanted - 1).bit_length())
    sketch = Sketch(cells)
    parts = deep.select("x", "y").mapInPandas(sketch.counted, "r int, piece int, seen binary, again binary")
    pieces = parts.repartition("r", "piece").mapInPandas(sketch.merged, "r int, piece int, again binary").collect()  # MOST_CELLS bits a row
    again = np.zeros((ROWS, cells // 8), np.uint8)
    for r in pieces:
        again[r["r"], r["piece"] * (SLICE // 8) : (r["piece"] + 1) * (SLICE // 8)] = np.frombuffer(bytes(r["again"]), np.uint8)
    sent = spark.sparkContext.broadcast(again)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value

        def twice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.ones(len(x), bool)
            for row, at in zip(bits, sketch.places(x, y)):
                out &= (row[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return out

        for pdf in batches:
            depth = pdf["depth"].to_numpy()
            yield pdf.assign(shared=(depth == 0) | twice(pdf["x"].to_numpy(), pdf["y"].to_numpy()), under=(depth <= 1) | twice(pdf["px"].to_numpy(), pdf["py"].to_numpy()))

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("shared", T.BooleanType()), T.StructField("under", T.BooleanType())]))


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the joined ids of each node, streamed in the order of a partition sorted by node and ids."""
    node, digest = None, None
    for pdf in batches:
        out = []
        for *key, ids in zip(pdf["depth"].tolist(), pdf["x"].tolist(), pdf["y"].tolist(), pdf["ids"]):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["depth", "x", "y", "ends"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["depth", "x", "y", "ends"])


def ends(shared: DataFrame) -> DataFrame:
    """Digest of the ids that end at each shared node: ids join in short runs first, so that a node with many is a stream of few rows."""
    last = shared.filter("depth = n").groupBy(*NODE, F.shiftright("conv_id", ENDS_SHIFT).alias("run"))
    runs = last.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    return runs.repartition(*NODE).sortWithinPartitions(*NODE, "run").select(*NODE, "ids").mapInPandas(_ends, "depth long, x long, y long, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, as the module says."""
    rows = cut(screened(cut(prefixes(*rebuilt(cut(turns(conversations)))))))
    shared, alone, last = rows.filter("shared"), rows.filter("NOT shared"), F.col("depth") == F.col("n")
    low = cut(shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max("n").alias("longest"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("before").alias("before")))

    # for each conversation: r, the depth from which on it represents its prefixes (none: after its end), the text before that, and whether it stands for a childless node
    begin = F.struct("depth", "before", "px", "py").alias("s")
    ends_in = shared.filter(last).select("conv_id", F.lit(None).cast("struct<depth:bigint,before:bigint,px:bigint,py:bigint>").alias("s"), F.lit(False).alias("leaf"), "n", (F.col("before") + F.col("chars")).alias("whole"))
    nodes = low.select("conv_id", begin, (F.col("longest") == F.col("depth")).alias("leaf"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("whole"))
    tails = alone.filter(F.col("under") | last).select("conv_id", begin, last.alias("leaf"), "n", F.lit(None).cast("long").alias("whole"))
    each = nodes.unionByName(tails).unionByName(ends_in).groupBy("conv_id").agg(F.min("s").alias("s"), F.max("leaf").alias("leaf"), F.max("n").alias("n"), F.max("whole").alias("whole"))
    each = each.select("conv_id", "leaf", F.coalesce("s.depth", F.col("n") + 1).alias("r"), F.coalesce("s.before", "whole").alias("upto"), F.col("s.px").alias("px"), F.col("s.py").alias("py"))
    above = low.select((F.col("depth") + 1).alias("r"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("above"))
    each = cut(each.join(above, ["r", "px", "py"], "left").select("conv_id", "r", "upto", "leaf", "above"))

    nothing, parent = F.lit(hashlib.sha256(b"").hexdigest()), F.when(F.col("r") < F.col("depth"), F.col("conv_id")).otherwise(F.col("above"))
    met, zero, one = shared.join(each, "conv_id"), F.lit(0).cast("long"), F.lit(1).cast("long")
    child = (F.col("n") > F.col("depth")) & (F.col("r") <= F.col("depth") + 1)
    grouped = met.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", parent.alias("parent"))).alias("least"), F.count(F.lit(1)).alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.greatest(zero, F.col("upto") - F.col("before"))).alias("saved_tokens"))
    grouped = grouped.join(ends(shared), list(NODE), "left").select(
        F.col("least.conv_id").alias("conv_id"), "depth", F.col("least.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"))
    own = F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)
    single = lambda df, above: df.select(
        "conv_id", "depth", above.alias("parent_conv_id"), one.alias("n_convs"), (F.col("n") > F.col("depth")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own.alias("ends_sha256"))
    return grouped.unionByName(single(alone.filter("under").join(each, "conv_id"), parent)).unionByName(single(alone.filter("NOT under"), F.col("conv_id")))
