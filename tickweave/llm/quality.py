"""Quality rules by the divergence of a document's histograms from those of its language, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import ROW, SPACE_RUN, join_small, packed, split_words, whole_text
from tickweave.session import cut

#: Character classes: each is what its pattern takes out of a text. White space is left out; other characters are the rest.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+", "foreign": "[^\\x00-\\x7F]+"}
#: Words of at most so many letters can be common words of a language; each language keeps so many of them.
COMMON_LETTERS, COMMON_WORDS = 6, 16
#: Base rule: fewer words fail. Documents below the second number are too short to be compared with a language.
MIN_WORDS, COMPARED_WORDS = 50, 100
#: Languages with fewer documents are no reference.
MIN_LANGUAGE_DOCS = 20
#: Base rule: share of repeated words in percent above which a document fails.
MAX_REPEATED = 50
#: Jensen-Shannon distances (0 to 1) above which a document is rejected.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.40


def js_distance(p: str, q: str, p_total: str, q_total: str) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histograms of the same bins; null if one is empty.

    Takes names of columns: an expression inside a lambda would be worked out again for each bin.
    """
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    pt, qt = F.col(p_total), F.col(q_total)
    both = F.zip_with(F.col(p), F.col(q), lambda a, b: (part(a / pt, b / qt) + part(b / qt, a / pt)) / 2)
    return F.when((pt > 0) & (qt > 0), F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def with_class_counts(df: DataFrame) -> DataFrame:
    """Add characters of each class, of white space and of all kinds.

    Each class is taken out of what the classes before it have left, so all but the first, the commonest, read short texts.
    """
    df = df.withColumns({"_all": F.length("text"), "_rest": F.col("text")})
    for name, pattern in (CLASSES | {"space": SPACE_RUN}).items():
        df = df.withColumn("_less", F.regexp_replace("_rest", pattern, "")).withColumn(f"_{name}", F.length("_rest") - F.length("_less")).drop("_rest").withColumnRenamed("_less", "_rest")
    return df.drop("_rest")


def _classes() -> Column:
    known = sum((F.col(f"_{k}") for k in CLASSES), F.col("_space"))
    return F.array(*[F.col(f"_{k}").cast("double") for k in CLASSES], (F.col("_all") - known).cast("double"))


def references(docs: DataFrame) -> DataFrame:
    """One row per language with enough documents, and one for all documents (ref_key empty, else = and lang): histogram of character
    classes, common words and their counts.

    Counts cover all documents. Partial sums per language and word leave the map side, so a language that holds most
    rows weighs no more in the shuffle than its distinct short words. Without documents there is no row.
    """
    base = docs.select("lang", whole_text().alias("text"))
    sized = with_class_counts(base).select("lang", _classes().alias("c"))
    sums = [F.sum(F.get("c", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    by_lang = cut(sized.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums))
    short = lambda x: (F.length(x) > 0) & (F.length(x) <= COMMON_LETTERS)
    words = F.transform(F.split(F.lower("text"), "[^\\p{L}]+"), lambda x: F.when(short(x), x).otherwise(""))
    counted = cut(base.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("m")))
    key = F.concat(F.lit("="), "lang").alias("ref_key")
    every = F.lit("").alias("ref_key")
    total = by_lang.agg(F.sum("n").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in range(len(sums))]).filter("n > 0").select(every, "*")
    counts = counted.filter("lang is not null").select(key, "word", "m").unionByName(counted.groupBy("word").agg(F.sum("m").alias("m")).select(every, "word", "m"))
    every_word = counts.groupBy("ref_key").agg(F.sum("m").cast("double").alias("ref_words"))
    best = F.row_number().over(Window.partitionBy("ref_key").orderBy(F.desc("m"), "word"))
    top = counts.filter("word != ''").withColumn("best", best).filter(f"best <= {COMMON_WORDS}").groupBy("ref_key").agg(F.sort_array(F.collect_list(F.struct("best", "word", "m"))).alias("top"))
    known = by_lang.filter(f"lang is not null and n >= {MIN_LANGUAGE_DOCS}").select(key, "*").drop("lang").unionByName(total)
    return cut(known.join(top, "ref_key", "left").join(every_word, "ref_key", "left").select(
        "ref_key", F.array(*[F.col(f"c{k}") for k in range(len(sums))]).alias("ref_classes"),
        F.coalesce("top.word", F.array().cast("array<string>")).alias("common"), F.coalesce(F.col("top.m").cast("array<double>"), F.array().cast("array<double>")).alias("common_counts"),
        F.coalesce("ref_words", F.lit(0.0)).alias("ref_words")))


def measured(df: DataFrame) -> DataFrame:
    """Add words and base measures to rows with a text.

    Repeated words are found within the row: hashes of the three-word windows are sorted with their places, equal
    neighbours mark places, and the words they cover are counted, so the work is n log n in a document's words.
    """
    df = with_class_counts(df.withColumn("text", whole_text())).withColumn("words", split_words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    df = df.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))
    w = F.col("words")
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("grams", F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    some = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("ordered", F.when(some, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    o = F.col("ordered")
    same = F.filter(o, lambda x, k: (x.h == F.get(o, k - 1).h).eqNullSafe(True) | (x.h == F.get(o, k + 1).h).eqNullSafe(True))
    df = df.withColumn("again", same)
    covered = F.array_distinct(F.flatten(F.transform("again", lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    return df.withColumns({
        "n_repeat_words": F.when(F.col("again").isNull(), 0).otherwise(F.size(covered)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "word_chars": (F.col("_all") - F.col("_space")).cast("long"), "n_symbols": F.col("_symbol").cast("long"), "classes": _classes(),
    }).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).drop("again", "ordered", "grams", "lines")


def quality(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Base measures, distances and verdict for each row of documents (text, lang; other columns may have any name).

    Returns ``__row`` (the row as it came) and the new columns. A document is rejected by a base rule, or if a distance to
    its language's reference exceeds its limit; an unknown or rare language is compared with all documents. Null text
    counts as empty; fewer than MIN_WORDS words fail by the base rule, fewer than COMPARED_WORDS are not judged by distance. Equal rows get equal results;
    an empty table gives an empty result.
    """
    refs = references(docs) if refs is None else refs
    rows = packed(docs, "text", "lang").withColumn("ref_key", F.concat(F.lit("="), "lang"))
    # a language without a reference takes the row of all documents
    known = join_small(rows, refs.filter("ref_key != ''").select("ref_key", F.lit(True).alias("has_ref")), "ref_key")
    known = known.withColumn("ref_key", F.when(F.col("has_ref"), F.col("ref_key")).otherwise("")).drop("has_ref", "lang")
    df = measured(join_small(known, refs, "ref_key"))
    common = F.col("common")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    df = df.withColumn("letters", F.split(F.lower("text"), "[^\\p{L}]+")).withColumn("short", F.filter("letters", lambda x: F.array_contains(common, x)))
    df = df.withColumn("found", F.transform("common", lambda c: F.size(F.filter("short", lambda x: x == c)).cast("double")))
    df = df.withColumns({
        "p_words": F.concat("found", F.array((F.size("letters") - F.size("short")).cast("double"))), "p_total": F.size("letters").cast("double"),
        "q_words": F.concat("common_counts", F.array(F.col("ref_words") - total(F.col("common_counts")))), "c_total": total(F.col("classes")), "r_total": total(F.col("ref_classes")),
    })
    df = df.withColumn("class_distance", js_distance("classes", "ref_classes", "c_total", "r_total")).withColumn("word_distance", js_distance("p_words", "q_words", "p_total", "ref_words"))
    guard = F.col("n_words") >= COMPARED_WORDS
    far = guard & ((F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE))
    return df.withColumn("kept", ~F.col("base_failed") & ~far).select(
        ROW, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def passing(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """The rows of documents that the rules keep.

    The verdict goes through a generator: a filter right on it would be pushed below the steps that work it out, with
    their arrays written into each other's lambdas and worked out again for each element.
    """
    judged = quality(docs, refs).select(ROW, F.explode(F.array("kept")).alias("stays"))
    return judged.filter("stays").select(f"{ROW}.*")
