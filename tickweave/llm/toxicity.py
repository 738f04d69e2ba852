"""Toxicity by a weighted finite-state grammar over clauses, with an insult lexicon learned from labelled documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.session import cut

#: Labelled rows to learn from at most, taken in the order of a hash; the only bound of this operator, and only on learning.
LABELLED_ROWS = 20_000
#: Word starts of these lengths, beside whole words, can be learned, so that inflected and compounded insults are met.
STEMS = range(3, 8)
#: A feature needs so many toxic documents, such odds against the others (natural logarithm), and the lexicon holds so many.
LEAST_DOCUMENTS, LEAST_ODDS, LEXICON = 5, 3.0, 5_000
#: Score from which a document is predicted toxic.
TOXIC = 0.3

#: Words of the four languages that the transducers know.
TARGETS = frozenset("you your youre yourself ye he she they them him her du dich dir ihr euch sie er tu toi te vous il elle ils tú ti usted ustedes él ella this that these those".split())
NEGATIONS = frozenset("not no never isnt arent wasnt nobody without nicht kein keine keinen nie ne pas jamais sans ni nunca sin tampoco".split())
REPORTS = frozenset("said says called quote quoted wrote reported alleged sagte sagt nannte schrieb zitiert dit disait appelé écrit dijo dice llamó escribió according".split())
THREATS = frozenset("kill hurt destroy beat burn stab shoot hang punish töten schlagen vernichten umbringen tuer frapper détruire brûler matar golpear destruir quemar".split())
INTENTS = frozenset("will shall gonna going must should werde wird werden soll vais va allons veux voy va vamos quiero".split())
#: Weights of the grammar (fixed values): what a target adds to an insult, a negation or a report leaves of it, and a threat is worth.
AIMED, NEGATED, REPORTED, THREAT = 1.25, 0.6, 0.6, 1.0
#: Words that a negation reaches.
REACH = 3

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n,()\"“”„«»]")
_ENDS, QUOTES = frozenset(".!?;:\n()\"“”„«»"), frozenset("\"“”„«»")
_KEPT = 1 << 19


@dataclass
class Lexicon:
    """Learned weights of words and of word starts, and the logistic that turns a document's sum into a score."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -2.0

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for k in STEMS:
            if len(word) <= k:
                break
            best = max(best, self.stems.get(word[:k], 0.0))
        return best


class _Weights(dict):
    """Weights of the words met so far; emptied when full."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = value = self.lexicon.weight(word)
        return value


def clauses(text: str | None) -> Iterator[tuple[list[str], str]]:
    """Lower-case words of each clause and the sign that ends it: a stop, a line end, a quotation mark, or none at the text's end.

    Commas stay inside as a sign; signs that follow each other have empty clauses between them.
    """
    clause: list[str] = []
    for token in _WORD.findall((text or "").lower()):
        if token in _ENDS:
            yield clause, token
            clause = []
        else:
            clause.append(token)
    yield clause, ""


def matched(clause: list[str], weights, reported: bool = False) -> tuple[float, float, bool]:
    """Weight of a clause under the composed transducers, its weight were all of it reported, and the report state at its end.

    Each is a small machine over the clause's words: targets open an aim, negations a reach of some words, reports a state
    that lasts to the clause's end (or is open from its start), intents a readiness for threats. An insult or threat takes
    negation, report and readiness as they are where it is read and waits for its target until the clause's end, so the
    target may stand on either side. A threat without a target adds nothing, and neither does a clause without either.
    """
    aimed = ready = False
    reach, insults, threats = 0, [0.0, 0.0], [0.0, 0.0]
    for word in clause:
        if word == ",":
            reach = 0
            continue
        if word in NEGATIONS:
            reach = REACH + 1
        elif word in REPORTS:
            reported = True
        aimed = aimed or word in TARGETS
        insult = weights[word]
        if insult or (word in THREATS and ready):
            value = (insult or THREAT) * (NEGATED if reach > 0 else 1.0)
            held = insults if insult else threats
            held[0] += value * (REPORTED if reported else 1.0)
            held[1] += value * REPORTED
        ready = ready or word in INTENTS
        reach = max(0, reach - 1)
    read, told = (AIMED * (i + t) if aimed else i for i, t in zip(insults, threats))
    return read, told, reported


def raw_score(text: str | None, weights) -> float:
    """Sum over the clauses of a text, with the report state carried between them.

    A report goes on over a colon into the next clause and over a quotation mark into the whole quotation; a report in the
    clause that directly follows a quotation reaches back into it. A quotation that is not closed ends with its paragraph
    and counts as read.
    """
    total, read, told = 0.0, 0.0, 0.0  # the last two: the quotation that is open or waits for what follows it
    inside = led = follows = report = False
    before = ""
    for clause, sign in clauses(text):
        if clause:
            as_read, as_told, report = matched(clause, weights, report)
            if inside:
                read, told = read + as_read, told + as_told
            else:
                total += as_read + (told if follows and report else read)
                read = told = 0.0
                follows = False
        if sign in QUOTES:
            if inside:
                inside, follows, report = False, not led, False
                if led:
                    total += told
                    read = told = 0.0
            else:
                total += read
                read = told = 0.0
                inside, led, follows = True, report, False
        elif sign != ":" and not (sign == "\n" and before == ":" and not clause):
            report = False
            if not inside or sign == "\n" == before and not clause:
                total += read
                read = told = 0.0
                inside = follows = False
        before = before if sign == "\n" and before == ":" and not clause else sign
    return total + read


def held_out(doc_id: Column) -> Column:
    """The fold that learning never sees."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _features(text: str | None) -> set[str]:
    words = {t for t in _WORD.findall((text or "").lower()) if t[0].isalpha()}
    return {"w" + w for w in words} | {f"s{w[:k]}" for w in words for k in STEMS if len(w) > k}


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either label for each feature of toxic documents that the partition holds; all others are left for later."""
    for pdf in batches:
        count: Counter = Counter()
        for text in pdf.text:
            count.update(_features(text))
        yield pd.DataFrame({"feature": list(count), "n": list(count.values())})


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents outside the held-out fold.

    Features are counted first over toxic documents; only those met often enough are counted over the others. Rows without
    a label or text count as clean and empty; labels that contradict each other for one doc_id count as toxic.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # broadcast: at most ``rows`` rows of two numbers
    texts = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic"))
    n_toxic, n_clean = (texts.filter(f"toxic {op} 0").count() for op in ("!=", "="))
    bad = texts.filter("toxic != 0").select("text").mapInPandas(_counted, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("bad"))
    bad = cut(bad.filter(F.col("bad") >= LEAST_DOCUMENTS))
    good = texts.filter("toxic = 0").select("text").mapInPandas(_counted, "feature string, n long").join(bad, "feature", "left_semi").groupBy("feature").agg(F.sum("n").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.coalesce("good", F.lit(0)) + 0.5) / (n_clean + 1))
    ranked = bad.join(good, "feature", "left").withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    best = ranked.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "feature").limit(LEXICON).collect()
    # bounded by LEXICON
    lexicon = Lexicon({r.feature[1:]: r.odds for r in best if r.feature[0] == "w"}, {r.feature[1:]: r.odds for r in best if r.feature[0] == "s"})
    return _calibrated(texts, lexicon)


def _calibrated(texts: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fit the logistic to histograms of the sums of either label."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = _Weights(lexicon)
        for pdf in batches:
            sums = [min(60, round(2 * raw_score(t, weights))) for t in pdf.text]
            yield pd.DataFrame({"bin": sums, "toxic": pdf.toxic}).groupby(["bin", "toxic"]).size().rename("n").reset_index().astype(int)

    rows = texts.mapInPandas(run, "bin long, toxic long, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect()
    points = [(r.bin / 2, float(r.toxic != 0), float(r.n)) for r in rows]
    total = sum(n for _, _, n in points) or 1.0
    a, b = 1.0, -2.0
    for _ in range(200):  # Newton steps with a small ridge
        ga, gb, haa, hab, hbb = 0.02 * (1.0 - a), 0.02 * (-2.0 - b), 0.02, 0.0, 0.02
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            w = n * p * (1 - p) / total
            ga, gb = ga + n * (y - p) * x / total, gb + n * (y - p) / total
            haa, hab, hbb = haa + w * x * x, hab + w * x, hbb + w
        d = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / d, (haa * gb - hab * ga) / d
        a, b = a + max(-1.0, min(1.0, da)), b + max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    lexicon.slope, lexicon.offset = max(a, 0.05), b
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row (doc_id, text): 0 to 1, from the clauses of the whole text alone.

    Null and empty texts get the score of a text without matched clauses. Rows that share a doc_id, or have none, are rows
    of their own; empty tables give none.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = _Weights(lexicon)
        for pdf in batches:
            z = [lexicon.slope * raw_score(t, weights) + lexicon.offset for t in pdf.text]
            yield pdf[["doc_id"]].assign(score=[1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
