"""Personal data: patterned values, and terms that reveal them by co-occurrence, in DataFrame functions only.

A value found by a pattern is a protected entity. For each term near an entity the corpus gives p(entity | term), the share of
the term's texts in which it stands near that entity; the bits by which a term discloses an entity of information content
-log2 p(entity) are that content less -log2 p(entity | term). A term that leaves at most ``doubt`` bits is generalised, one
that leaves none is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import ROW, SPACE_RUN, SPACES, join_small, packed, whole_text
from tickweave.session import cut

#: Patterns (fixed values) in the order of the kinds. A match begins at the start of a run or where the last one ended, which
#: says the same as trying every place and keeps long runs linear; what a run has taken is not given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Terms are runs of letters of at least so many; those within so many words of an entity are near it.
TERM_LETTERS, NEAR_WORDS = 4, 6
#: Different contexts in which a term must stand near an entity, and the bits of doubt below which it discloses it.
CONTEXTS, DOUBT = 3, 1.0
_MARK, _OTHER = "\ue000", "\ue001"
_SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _spans(text: Column, kind: str, pattern: str, good) -> Column:
    """Matches of a pattern in order as (kind, start, stop, value), found by putting marks around them and splitting."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)

    def step(a: Column, x: Column) -> Column:
        stop = a.at + F.length(x)
        span = F.struct(F.lit(kind).alias("kind"), a.at.alias("start"), stop.alias("stop"), x.alias("value"))
        return F.struct(stop.alias("at"), (~a.odd).alias("odd"), F.when(a.odd & good(x), F.concat(a.found, F.array(span))).otherwise(a.found).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(_SPAN).alias("found"))
    return F.aggregate(parts, start, step).found


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


_GOOD = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.regexp_like(x, F.lit(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")),
    "card": lambda x: F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def with_entities(df: DataFrame) -> DataFrame:
    """Add ``plain`` (the text without the mark used here, of equal length) and an array of spans for each kind."""
    text = whole_text()
    df = df.withColumn("plain", F.when(F.contains(text, F.lit(_MARK)), F.regexp_replace(text, _MARK, _OTHER)).otherwise(text))
    plain = F.col("plain")
    return df.withColumns({
        f"{k}_spans": F.when(F.contains(plain, F.lit("@")) if k == "email" else F.regexp_like(plain, F.lit(HINTS[k])), _spans(plain, k, p, _GOOD[k])).otherwise(F.array().cast(_SPAN))
        for k, p in PATTERNS.items()
    })


def _entities() -> Column:
    return F.concat(*[F.col(f"{k}_spans") for k in PATTERNS])


def _terms(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: F.length(x) >= TERM_LETTERS))


def disclosing_terms(found: DataFrame, contexts: int = CONTEXTS, doubt: float = DOUBT) -> DataFrame:
    """(term, left): terms that disclose an entity, and the bits of doubt left, from rows with entities.

    Only the surroundings of entities become rows; different texts are counted, so copies count once. Texts with a term
    are counted over the whole corpus for the terms that stand near one entity often enough.
    """
    spans = found.filter(F.size(_entities()) > 0).select("plain", "text_key", F.explode(_entities()).alias("s"))
    # NEAR_WORDS words on either side lie in a stretch of bounded length unless a word is longer than 40 letters
    before = F.substring("plain", F.greatest(F.col("s.start") + 1 - 40 * NEAR_WORDS, F.lit(1)), F.least(F.col("s.start"), F.lit(40 * NEAR_WORDS)))
    after = F.substring("plain", F.col("s.stop") + 1, F.lit(40 * NEAR_WORDS))
    words = lambda c: F.split(F.btrim(c, F.lit(SPACES)), SPACE_RUN)
    around = F.concat_ws(" ", F.slice(F.reverse(words(before)), 1, NEAR_WORDS), F.slice(words(after), 1, NEAR_WORDS))
    near = spans.select(F.concat("s.kind", F.lit(":"), F.lower("s.value")).alias("entity"), F.xxhash64(around).alias("context"), "text_key", F.explode(_terms(around)).alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("text_key").alias("together")).filter(F.col("contexts") >= contexts)
    # a term stands in at least as many texts as those in which it is near any entity: most need no count over the corpus
    some = near.groupBy("term").agg(F.countDistinct("text_key").alias("some"))
    pairs = cut(pairs.join(some, "term").filter(F.col("together") * 2.0**doubt >= F.col("some")).select("entity", "term", "together"))
    asked = cut(pairs.select("term").distinct())
    if asked.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("left")).limit(0)
    each = found.select("text_key", F.explode(_terms(F.col("plain"))).alias("term"))
    counts = join_small(each, asked, "term", "left_semi").groupBy("term").agg(F.countDistinct("text_key").alias("documents"))
    left = -F.log2(F.least(F.col("together") / F.col("documents"), F.lit(1.0)))
    return cut(pairs.join(counts, "term").withColumn("left", left).groupBy("term").agg(F.min("left").alias("left")).filter(F.col("left") <= doubt))


def personal_data(docs: DataFrame, contexts: int = CONTEXTS, doubt: float = DOUBT) -> DataFrame:
    """Spans of each row of documents (text; other columns may have any name): ``__row``, plain, an array of spans for each
    kind, and term_spans, whose value says ``generalise`` or ``remove``.

    Offsets are code points, ends exclusive. Null text counts as empty. Equal texts get equal spans; an empty table gives
    an empty result. Terms are marked wherever they stand, also in texts without an entity.
    """
    found = with_entities(packed(docs, "text")).withColumn("text_key", F.xxhash64("plain"))
    terms = disclosing_terms(found, contexts, doubt)
    if terms.isEmpty():
        return found.drop("text_key").withColumn("term_spans", F.array().cast(_SPAN))
    held = found.select("text_key", F.explode(_terms(F.col("plain"))).alias("term"))
    held = join_small(held, terms, "term", "inner").groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("term", "left"))).alias("held"))
    rows = join_small(found, cut(held), "text_key")
    any_of = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("held.term", "|"), F.lit(r")(?!\p{L})"))
    raw = _spans(F.col("plain"), "term", any_of, lambda x: F.lit(True))
    sure = F.map_from_entries(F.transform("held", lambda h: F.struct(h.term, (h.left <= 0).alias("sure"))))
    spans = F.transform(raw, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"), F.when(F.try_element_at(sure, F.lower(s.value)), "remove").otherwise("generalise").alias("value")))
    return rows.withColumn("term_spans", F.when(F.col("held").isNotNull(), spans).otherwise(F.array().cast(_SPAN))).drop("held", "text_key")


def sanitised(rows: DataFrame) -> Column:
    """The text of rows from ``personal_data`` with entities replaced by their kind and terms generalised or removed.

    Overlapping spans are replaced as one, by the tag of the first.
    """
    spans = F.array_sort(F.transform(F.concat(_entities(), F.col("term_spans")), lambda s: F.struct(s.start.alias("start"), (-s.stop).alias("back"), s.kind.alias("kind"), s.value.alias("value"))))
    text = whole_text(f"{ROW}.text")

    def step(a: Column, s: Column) -> Column:
        tag = F.when(s.kind != "term", F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))).when(s.value == "remove", "").otherwise("[TERM]")
        more = F.concat(a.out, F.substring(text, a.at + 1, s.start - a.at), tag)
        return F.struct(F.greatest(a.at, -s.back).alias("at"), F.when(s.start >= a.at, more).otherwise(a.out).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(done.out, F.substring(text, done.at + 1, F.length(text)))).otherwise(F.col(f"{ROW}.text"))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """The rows of documents with personal data replaced; n_chars follows the text."""
    rows = personal_data(docs, **settings)
    rows = rows.withColumn("clean", sanitised(rows))
    fields = [F.col("clean").alias(c) if c == "text" else F.when(F.col("clean").eqNullSafe(F.col(f"{ROW}.text")), F.col(f"{ROW}.n_chars")).otherwise(F.length("clean")).cast("long").alias(c) if c == "n_chars" else F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*fields)
