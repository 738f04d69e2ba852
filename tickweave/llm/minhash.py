"""Near-duplicate documents by HyperMinHash sketches, banding, estimation and verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import LOWER, UPPER, groups
from tickweave.llm.components import components
from tickweave.session import cut

#: 2 to this power buckets; a register keeps leading zeros and so many mantissa bits; registers of a band make one key.
BUCKET_BITS, MANTISSA_BITS, BAND = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Words of a shingle and least similarity in percent.
WORDS, SIMILAR = 2, 80
#: Estimates below the similarity by more than this are not verified: five standard errors of 128 registers.
SLACK = 0.18
#: Bands whose pairs are compared first, and rows of a bucket that one block holds when components are compared.
FIRST_BANDS, BLOCK_ROWS = 4, 2048
#: Expected share of colliding registers of unrelated large sets, from the sketch's published analysis (fixed value).
COLLISIONS = 0.169919487159739093975315012348

_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_REMEMBERED = 1 << 18


class _Hashes(dict):
    """Hashes of the words met so far; emptied when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(total)


#: Order in which an empty bucket looks for a full one, the same for all documents.
_BORROW = np.argsort(np.random.default_rng(5).random((BUCKETS, BUCKETS)), axis=1)
_FIRST = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)


def registers(shingles: np.ndarray) -> np.ndarray:
    """One 16-bit register for each bucket: leading zeros of the smallest hash and the bits after its leading one.

    An empty bucket borrows from the first full one in its own fixed random order, so that small sets, too, agree in a
    register with the probability of their similarity.
    """
    at = np.searchsorted(shingles, _FIRST)
    ends = np.r_[at[1:], len(shingles)]
    full = at < ends
    low = (shingles[np.minimum(at, len(shingles) - 1)] << np.uint64(BUCKET_BITS)) >> np.uint64(12)
    part, bits = np.frexp(low.astype(np.float64))
    zeros = np.where(low > 0, 52 - bits, 53).astype(np.uint16)
    mantissa = np.where(low > 0, (2 * part - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    out = (zeros << np.uint16(MANTISSA_BITS)) | mantissa
    if not full.all():
        source = np.argmax(full[_BORROW], axis=1)
        out = np.where(full, out, out[_BORROW[np.arange(BUCKETS), source]])
    return out


def _sketches(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Hashes()
        for pdf in batches:
            n, same, bands = [], [], []
            for text in pdf.text:
                s = shingle_set(text, words, seen)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(registers(s).view(np.int64) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_shingles": n, "same": same, "bands": bands})

    return run


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (rows of registers), less the registers expected to agree by chance."""
    ratio = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    chance = COLLISIONS * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA_BITS)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _promising(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.stack(pdf[c].to_numpy()).astype(np.int64).view(np.uint16) for c in ("bands_a", "bands_b"))
                pdf = pdf[estimate(a, b, pdf.n_a.to_numpy(float), pdf.n_b.to_numpy(float)) >= least]
            yield pdf[["a", "b"]]

    return run


def _verified(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, last, last_set = _Hashes(), None, None
        for pdf in batches:
            good = []
            for a, text_a, text_b in zip(pdf.a, pdf.text_a, pdf.text_b):
                if a != last:
                    last, last_set = a, shingle_set(text_a, words, seen)
                other = shingle_set(text_b, words, seen)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                good.append(100 * common >= percent * (len(last_set) + len(other) - common))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    return run


def _confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the estimate and then the comparison of full sets."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("bands").alias("bands_a"), F.col("n_shingles").alias("n_a"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("bands").alias("bands_b"), F.col("n_shingles").alias("n_b"))
    # a set can only be similar to one of about its size
    sized = pairs.join(right, "b").join(left, "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = cut(sized.mapInPandas(_promising(percent / 100 - SLACK), "a long, b long"))
    with_b = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return cut(both.mapInPandas(_verified(words, percent), "a long, b long").distinct())


def _small_sets(words: int):
    """Sets as sorted 32-bit hashes, enough to tell all but close calls."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Hashes()
        for pdf in batches:
            sets = [np.unique((shingle_set(t, words, seen) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in pdf.text]
            yield pdf[["doc_id"]].assign(members=sets)

    return run


def _across(percent: int, least: float):
    """Pairs of a block pair that are linked, or may be, and lie in different components.

    A pair is looked at in the first band that it shares only. Components that a sure link has joined are one from then on.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, "bucket", "i", "j"):
            if len(g) < 2 or g.c.nunique() < 2:
                continue
            ids, n, c, block = (g[k].to_numpy() for k in ("doc_id", "n_shingles", "c", "block"))
            bands = np.stack(g.bands.to_numpy()).astype(np.int64)
            registers_, band = bands.view(np.uint16), int(g.band.iloc[0])
            sets = [np.frombuffer(m, np.uint32) for m in g.members]
            alone = g.i.iloc[0] == g.j.iloc[0]
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    x = y
                return x

            found = []
            for k in range(len(g)):
                others = np.arange(k + 1, len(g)) if alone else np.flatnonzero(block != block[k]) if block[k] == g.i.iloc[0] else ()
                if not len(others):
                    continue
                others = others[(c[others] != c[k]) & (100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k]))]
                if not len(others):
                    continue
                likely = estimate(registers_[others], registers_[k][None], n[others].astype(float), np.full(len(others), float(n[k]))) >= least
                others = others[likely]
                others = others[np.argmax(bands[others] == bands[k], axis=1) == band]
                for o in others.tolist():
                    if top(c[k]) == top(c[o]):
                        continue
                    a, b = sets[k], sets[o]
                    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    # hashes that fall together change the count by less than two but once in some billion pairs
                    if 100 * (common + 2) >= percent * (n[k] + n[o] - common - 2):
                        found.append((min(ids[k], ids[o]), max(ids[k], ids[o])))
                        if 100 * (common - 2) >= percent * (n[k] + n[o] - common + 2):
                            up[max(top(c[k]), top(c[o]))] = min(top(c[k]), top(c[o]))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILAR) -> DataFrame:
    """Components of similar documents: (doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents with equal sets are one node. Each band's bucket first compares all its nodes with one of them, drawn by a
    hash, so that a large group is linked by several nodes of it at a cost in proportion to its size. Buckets that still
    hold more than one component are then compared across components, block by block, so a link between documents that
    share a bucket is not lost. Two documents of similarity 0.8 share no bucket with probability 5e-8.

    Null text and text without words have an empty set and link with nothing. Rows that share a doc_id are one node each
    for their text's set; rows without one link with nothing and are kept. Other columns are not looked at; empty tables
    give empty results.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = cut(base.mapInPandas(_sketches(words), "doc_id long, n_shingles long, same binary, bands array<long>"))
    linked = sketched.filter("n_shingles > 0 and doc_id is not null")
    first = cut(linked.groupBy("same").agg(F.min("doc_id").alias("rep")))
    reps = cut(linked.join(first.select(F.col("rep").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"]).select("doc_id", "n_shingles", "bands"))
    rows = reps.select("doc_id", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "doc_id")
    drawn = F.min(F.struct(F.xxhash64("doc_id", "bucket").alias("h"), "doc_id")).alias("drawn")
    pivots = rows.groupBy("bucket").agg(drawn, F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.col("drawn.doc_id").alias("pivot"))
    shared = cut(rows.join(pivots, "bucket"))
    texts = cut(base.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"))
    pairs = shared.filter("doc_id != pivot").groupBy(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).agg(F.min("band").alias("band"))
    pairs = cut(pairs)
    # the first bands link most of a group; pairs of later ones within one component need no comparison any more
    links = _confirm(pairs.filter(F.col("band") < FIRST_BANDS).select("a", "b"), reps, texts, words, percent)
    labels = cut(components(links))
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
    rest = pairs.filter(F.col("band") >= FIRST_BANDS).join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    links = links.unionByName(_confirm(rest, reps, texts, words, percent))
    labels = components(links).select(F.col("id").alias("doc_id"), "component")
    named = cut(shared.select("bucket", "band", "doc_id").join(labels, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component"))
    split = named.groupBy("bucket").agg(F.count_if(F.lit(True)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    split = split.select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    open_ = cut(named.join(split, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    small = texts.join(open_.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInPandas(_small_sets(words), "doc_id long, members binary")
    each = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("bucket", "band", "doc_id", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = each.join(reps.dropDuplicates(["doc_id"]).join(small, "doc_id"), "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    close = cut(dealt.mapInPandas(_across(percent, percent / 100 - SLACK), "a long, b long").distinct())
    late = _confirm(close, reps, texts, words, percent)
    found = cut(components(links.unionByName(late)))
    out = sketched.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(first, "same", "left")
    out = out.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and every row without words or doc_id.

    Of rows that repeat a kept doc_id one stays.
    """
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("__gone"))
    kept = docs.join(cut(gone.distinct()), docs["doc_id"] == F.col("__gone"), "left_anti")
    return kept
