"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

A source's documents fall by a hash into blocks of about equal size. Its blocks, in a permuted order and once more for a
second pass, are taken until its target is met to the word; that gives each source's exact quota of blocks. The quotas are
split over the output shards by a tree: each node deals half of its blocks to either side by selection sampling, so that the
counts of the sources are multivariate-hypergeometric and add up. A shard gets the next blocks of each source's permuted
order, as many as its leaf says, and orders its documents by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import ROW, join_small, packed, split_words, uniform, whole_text
from tickweave.session import cut

#: Weights of the sources by code point, repeating; null comes last.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix for each word of the input, and the most that a source gives for each of its words.
GROWTH, MOST = 1.5, 2.0
#: Words of a block at least; larger inputs have larger blocks, so that the tree deals at most about MAX_BLOCKS for each pass.
BLOCK_WORDS, MAX_BLOCKS = 1 << 17, 1 << 16
#: Levels of the tree: 2 to this power output shards.
LEVELS, SEED = 4, 7


def targets(sources: DataFrame, weights=WEIGHTS, growth: float = GROWTH, most: float = MOST) -> DataFrame:
    """Target of each source (source, source_size): shares by weight, filled up to ``most`` times its size, the rest reshared.

    Filling is exact: in order of size over weight, sources are full while their weight's share of what is left is more
    than they can give. One row per source passes one task.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))))
    df = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.greatest(growth * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    df = df.withColumn("level", left / heavy)
    full = F.col("level") * F.col("weight") >= F.col("limit")
    df = df.withColumn("open", F.max(F.when(~full, F.col("level"))).over(every))
    return df.withColumn("target", F.when(full | F.col("open").isNull(), F.col("limit")).otherwise(F.least(F.col("open") * F.col("weight"), F.col("limit"))))


def _halves(quotas: Column, node: Column, seed: int) -> Column:
    """The left half's counts of a node's quotas: each block goes left with the share of places that are left."""
    def deal(state: Column, k: Column, s: Column) -> Column:
        one = lambda a, i: F.struct(
            (a.n - 1).alias("n"), F.when(uniform(seed, node, s, i) * a.n < a.m, a.m - 1).otherwise(a.m).alias("m"))
        after = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(state.n.alias("n"), state.m.alias("m")), one)
        return F.struct(after.n.alias("n"), after.m.alias("m"), F.concat(state.got, F.array(state.m - after.m)).alias("got"))

    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("n"), F.floor(total / 2).alias("m"), F.array().cast("array<bigint>").alias("got"))
    numbered = F.transform(quotas, lambda k, s: F.struct(k.alias("k"), s.alias("s")))
    return F.aggregate(numbered, start, lambda a, x: deal(a, x.k, x.s)).got


def split_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """From quotas (rank from 0, quota), one row each, the counts of each shard: (rank, ends), where ends[j] is the number of
    a source's blocks that go to shards 0 to j."""
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", F.col("quota").cast("long").alias("quota")))).alias("all"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), F.col("all.quota").alias("quota"), F.col("all.rank").alias("ranks"))
    for level in range(levels):
        nodes = cut(nodes.withColumn("left", _halves(F.col("quota"), F.col("node"), seed + level)))
        rest = F.zip_with("quota", "left", lambda a, b: a - b)
        sides = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quota")), F.struct((2 * F.col("node") + 1).alias("node"), rest.alias("quota")))
        nodes = nodes.select("ranks", F.explode(sides).alias("x")).select("x.node", "x.quota", "ranks")
    leaves = nodes.select("node", F.explode(F.arrays_zip(F.col("ranks").alias("rank"), F.col("quota").alias("quota"))).alias("x")).select("node", "x.*")
    counts = leaves.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("node", "quota"))).alias("c"))
    running = F.aggregate("c", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0).cast("long")) + x.quota)))
    return counts.select("rank", running.alias("ends"))


def draws(docs: DataFrame, weights=WEIGHTS, growth: float = GROWTH, most: float = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """Draws of each row of documents (doc_id, text, source): ``__row``, size, source_size, target and draws, an array of
    (pass, shard, taken) with the words taken in each draw.

    Words of a row are counted over its whole text; null text has none, and such a row is never drawn. A null source is a
    source of its own. Rows with one doc_id are rows of their own; equal ones share a block. Empty tables give empty results.
    """
    sized = packed(docs, "doc_id", "source", "text").withColumn("size", F.size(split_words(whole_text())).cast("long"))
    slim = cut(sized.select("doc_id", "source", "size"))
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(per_source, weights, growth, most)
    block_words = F.greatest(F.lit(float(BLOCK_WORDS)), F.sum("source_size").over(Window.partitionBy()) / F.lit(MAX_BLOCKS))
    aims = cut(aims.withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1))).withColumn("words", F.round("target").cast("long")).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "rank", "source_size", "target", "words", "n_blocks"))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks")).alias("block")
    placed = join_small(slim.select("doc_id", "size", key.alias("key")), aims.select("key", "rank", "n_blocks"), "key").select("rank", block, "doc_id", "size")
    blocks = placed.groupBy("rank", "block").agg(F.sum("size").alias("block_size"))
    passes = F.array(*[F.lit(k) for k in range(int(-(-most // 1)))])
    tokens = join_small(blocks.withColumn("pass", F.explode(passes)), aims.select("rank", "words"), "rank")
    order = Window.partitionBy("rank").orderBy("pass", F.xxhash64("block", F.lit(seed), "pass"), "block")
    tokens = tokens.withColumn("start", F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tokens = tokens.withColumn("place", F.row_number().over(order)).withColumn("draw", F.least(F.col("block_size"), F.col("words") - F.col("start")))
    tokens = cut(tokens.filter("draw > 0").select("rank", "block", "pass", "place", "block_size", "draw"))
    quotas = aims.select("rank").join(tokens.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), "rank", "left").select("rank", F.coalesce("quota", F.lit(0)).alias("quota"))
    ends = split_tree(quotas, levels, seed)
    shard = F.size(F.filter("ends", lambda e: e < F.col("place")))
    dealt = join_small(tokens, cut(ends), "rank").select("rank", "block", F.struct("pass", shard.alias("shard"), "draw", (F.col("draw") < F.col("block_size")).alias("part")).alias("t"))
    drawn = cut(dealt.groupBy("rank", "block").agg(F.sort_array(F.collect_list("t")).alias("tokens")).withColumn("part", F.get(F.filter("tokens", lambda t: t.part), F.lit(0)).draw))
    # a partly drawn block gives its documents in the order of a hash up to a cut
    parts = join_small(placed, drawn.filter("part is not null").select("rank", "block", "part"), ["rank", "block"], "inner")
    parts = parts.groupBy("rank", "block", "part", _turn(seed).alias("turn")).agg(F.sum("size").alias("size")).filter("size > 0")
    start = F.coalesce(F.sum("size").over(Window.partitionBy("rank", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = parts.withColumn("rest", F.col("part") - start).filter("rest > 0 and rest <= size").select("rank", "block", F.struct("turn", "rest", "size").alias("cut"))
    drawn = cut(drawn.drop("part").join(cuts, ["rank", "block"], "left"))
    rows = join_small(sized.withColumn("key", key), aims.select("key", "rank", "n_blocks", "source_size", "target"), "key").withColumn("block", block)
    rows = join_small(rows, drawn, ["rank", "block"])
    turn, at = _turn(seed), F.col("cut")
    some = F.when(turn < at.turn, F.col("size")).when(turn == at.turn, F.floor(F.col("size") * at.rest / at["size"])).otherwise(0)
    drawn_here = F.transform("tokens", lambda t: F.struct(t["pass"].alias("pass"), t.shard.alias("shard"), F.when(t.part, some).otherwise(F.col("size")).cast("long").alias("taken")))
    drawn_here = F.coalesce(F.filter(drawn_here, lambda d: d.taken > 0), F.array().cast("array<struct<pass:int,shard:int,taken:bigint>>"))
    return rows.select(ROW, "size", "source_size", "target", drawn_here.alias("draws"))


def _turn(seed: int) -> Column:
    return F.xxhash64("doc_id", F.lit(seed + 1))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, and to its own end if it has no more words."""
    return F.when(n >= F.size(split_words(text)), text).otherwise(F.array_join(F.slice(split_words(text), 1, n.cast("int")), " "))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows of documents with one row for each draw, and shard; a partly drawn row holds its first words,
    one space apart, and its n_chars follows. Rows lie by shard, within it in the order of a hash."""
    rows = draws(docs, **settings).withColumn("d", F.explode("draws"))
    whole = F.col("d.taken") >= F.col("size")
    text = F.when(whole, F.col(f"{ROW}.text")).otherwise(first_words(F.col(f"{ROW}.text"), F.col("d.taken")))
    fields = [text.alias("text") if c == "text" else F.when(whole, F.col(f"{ROW}.n_chars")).otherwise(F.length(text)).cast("long").alias(c) if c == "n_chars" else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    order = F.xxhash64(f"{ROW}.doc_id", "d.pass", F.lit(settings.get("seed", SEED)))
    return rows.select(F.struct(*fields).alias(ROW), F.col("d.shard").alias("shard"), order.alias("order")).repartition("shard").sortWithinPartitions("shard", "order").drop("order")
