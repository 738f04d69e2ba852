import math
import os
import random
import re
from collections import Counter

import pytest

from tickweave.llm import mixing, quality, queries
from tickweave.llm.common import ROW

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_measures_of_whole_table(spark, sample):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    got = queries.op9_quality_rules(spark, sample).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_awkward_rows(odd, none):
    got = quality.quality(odd).select(ROW, *COLUMNS, "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == base(r[ROW]["text"])
        assert r[ROW]["words"] == 7 and r[ROW]["a b"] == 0
    assert quality.quality(none).count() == 0


def test_distance_sets_junk_apart(spark):
    clean = "the cat and the dog sat on the mat while a bird in the tree sang to them, and so it was for a long day of rest. "
    rnd = random.Random(1)
    rows = [(k, clean + " ".join("".join(rnd.choices("etaoinshrdlu", k=5)) for _ in range(100)) + ".", "en") for k in range(30)]
    rows += [(100, "### *** $$$ " + " ".join(f"%%{j}@@&&{j * 7}||" for j in range(120)), "en")]
    got = {r[ROW]["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].class_distance > quality.MAX_CLASS_DISTANCE and not got[100].kept
    assert all(got[k].class_distance < quality.MAX_CLASS_DISTANCE and got[k].kept for k in range(30))
    want = plain_distances(rows)
    assert all(got[i].class_distance == pytest.approx(a, abs=1e-12) and got[i].word_distance == pytest.approx(b, abs=1e-12) for i, (a, b) in want.items())


def plain_distances(rows):
    """Jensen-Shannon distances of (doc_id, text, lang) rows to their language by counting; languages are common ones."""
    kinds = ["[a-z]", "[A-Z]", "[0-9]", "[#*$%&|<>]", "[^\x00-\x7F]"]

    def classes(t):
        c = [len(re.findall(k, t)) for k in kinds]
        return [*c, len(t) - sum(c) - len(re.findall("[\x20\x09-\x0D]", t))]

    def far(p, q):
        p, q = [[x / sum(v) for x in v] for v in (p, q)]
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
        return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))

    words = lambda t: re.split(r"[\W\d_]+", t.lower())
    out = {}
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        every = [sum(c) for c in zip(*(classes(t) for _, t, _ in own))]
        counted = Counter(w if len(w) <= quality.COMMON_LETTERS else "" for _, t, _ in own for w in words(t))
        top = sorted((w for w in counted if w), key=lambda w: (-counted[w], w))[: quality.COMMON_WORDS]
        for i, t, _ in own:
            here = Counter(words(t))
            p = [here[w] for w in top]
            q = [counted[w] for w in top]
            out[i] = far(classes(t), every), far([*p, sum(here.values()) - sum(p)], [*q, sum(counted.values()) - sum(q)])
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_verdicts_of_the_table(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.collect()]
    known = {x for x, n in Counter(r[2] for r in rows).items() if n >= quality.MIN_LANGUAGE_DOCS}
    assert len(known) > 1
    want, n = plain_distances([r for r in rows if r[2] in known]), 0
    for r in quality.quality(docs).collect():
        i = r[ROW]["doc_id"]
        if i in want and r.n_words >= quality.COMPARED_WORDS:
            a, b = want[i]
            assert (r.class_distance, r.word_distance) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))
            assert r.kept == (not r.base_failed and a <= quality.MAX_CLASS_DISTANCE and b <= quality.MAX_WORD_DISTANCE)
            n += 1
    assert n > 50


def fill(sizes):
    """Targets by giving, cutting and giving again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {s: 0.0 for s in order}, set(order), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_targets(spark, sample):
    source = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    got = queries.op5_mix_sources(spark, sample).collect()
    again = queries.op5_mix_sources(spark, sample).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(source)
    sizes, taken = Counter(), Counter()
    for r in got:
        s, n = source[r.doc_id]
        sizes[s] += n
        taken[s] += r.taken
        assert r["size"] == n and 0 <= r.taken <= 2 * n
        assert r.taken == sum(d.taken for d in r.draws) and len({d["pass"] for d in r.draws}) == len(r.draws)
    want = fill(sizes)
    for r in got:
        s, _ = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_tree_deals_every_block_once(spark):
    quotas = {0: 37, 1: 0, 2: 500, 3: 1}
    ends = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "rank long, quota long"), levels=3, seed=1)
    ends = {r["rank"]: r.ends for r in ends.collect()}
    assert all(len(e) == 8 and e[-1] == quotas[k] and e == sorted(e) for k, e in ends.items())
    shards = [sum(e[j] - (e[j - 1] if j else 0) for e in ends.values()) for j in range(8)]
    assert max(shards) - min(shards) <= 1
    big = [ends[2][j] - (ends[2][j - 1] if j else 0) for j in range(8)]
    assert min(big) > 45 and sum(big) == 500


def test_split_has_the_hypergeometric_mean(spark):
    """Left halves of 200 trees over (30, 10): the first source's mean is 15, with a variance of 30 * 10 / 40 * 20 / 39 / 2."""
    from pyspark.sql import functions as F

    left = spark.range(200).select(mixing._halves(F.array(F.lit(30).cast("long"), F.lit(10).cast("long")), F.col("id"), 3).alias("x")).collect()
    first = [r.x[0] for r in left]
    assert all(sum(r.x) == 20 and r.x[0] <= 30 and r.x[1] <= 10 for r in left)
    mean = sum(first) / 200
    spread = sum((x - mean) ** 2 for x in first) / 200
    assert abs(mean - 15) < 0.5 and 1.2 < spread < 2.9


def test_mixed_rows(odd, none):
    drawn = mixing.draws(odd).collect()
    assert len(drawn) == odd.count()
    want = {(r[ROW]["doc_id"], r[ROW]["text"]): sum(d.taken for d in r.draws) for r in drawn}
    out = mixing.mix(odd).collect()
    assert set(out[0][ROW].asDict()) == set(odd.columns)
    got = Counter()
    for r in out:
        row = r[ROW]
        assert row["n_chars"] == len(row["text"]) and row["a b"] == 0
        key = next(k for k in want if k[0] == row["doc_id"] and k[1] and (k[1] == row["text"] or WORD.findall(k[1])[: len(WORD.findall(row["text"]))] == WORD.findall(row["text"])))
        got[key] += len(WORD.findall(row["text"]))
    assert all(got[k] in (n, 2 * n) for k, n in want.items())
    assert mixing.draws(none).count() == 0 and mixing.mix(none).count() == 0
