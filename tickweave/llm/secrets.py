"""Secrets: patterned values, and credential values that are hard to guess by a minimum-cost segmentation."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns (fixed values) in the order of the kinds, and the least length of the value.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words before a value that make it a credential, beyond those of the pattern above. Other parts of a name may stand before
#: them (DB_PASS, dbPass).
CONTEXT = re.compile(r"""(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:(?:pwd|pass|passphrase|passcode|pin|credentials?|auth(?:orization)?|bearer|private_?key|access_?key|secret_?key|client_?secret|login|key))["']?[\x20\t]*(?::=|=>|[:=]|\x20is\x20|\x20)[\x20\t]*(?:[Bb]earer\x20+)?["'`]?([A-Za-z0-9+/_.=!@#$%^&*~-]{6,})""")
#: A whole name of several parts with a value assigned to it; a part of it may be such a word wherever it stands (KEY_ID).
NAMED = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)++)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:[Bb]earer\x20+)?["'`]?([A-Za-z0-9+/_.=!@#$%^&*~-]{6,})""")
PART = re.compile(r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:pwd|pass|passphrase|passcode|pin|credentials?|auth(?:orization)?|bearer|private_?key|access_?key|secret_?key|client_?secret|login|key)(?![A-Za-z])")
#: A value is a secret from this many decimal digits of guesses on; shorter context values than six signs are none.
HARD = 10.0
#: So many more for a value of letters alone, which costs as much as a rare word does as long as it is short.
LETTERS = 10.0

#: Words of the corpus that guessing tries after the fixed ones, and their least letters: the commonest ones.
CORPUS_WORDS, CORPUS_LETTERS = 30_000, 4

#: Words that guessing tries first, the likelier the earlier.
WORDS = (
    "password the and you that for are with his they this have from one had word but not what all were when your can said there use each which she how their "
    "will other about out many then them these some her would make like him into time has look two more write see number way could people my than first water "
    "been call who oil its now find long down day did get come made may part admin root user login welcome test guest master default secret token key pass "
    "letmein dragon monkey shadow sunshine princess football baseball superman batman summer winter spring autumn monday friday love hello freedom whatever "
    "qwerty abc iloveyou trustno1 ninja mustang michael jordan hunter killer george computer internet service cheese coffee server data base prod dev stage "
    "change changeme null none true false example sample placeholder dummy your here value string secure private public access client").split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
FIXED = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}
_PLAIN = str.maketrans("@4301!5$7", "aaeoiisst")
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
_NEAR = {}
for _r, _row in enumerate(ROWS):
    for _c, _sign in enumerate(_row):
        _NEAR[_sign] = {x for q in (_r - 1, _r, _r + 1) if 0 <= q < 4 for x in ROWS[q][max(0, _c - 1) : _c + 2]}


def _alphabet(sign: str) -> int:
    return 10 if sign.isdigit() else 26 if sign.isalpha() else 33


class Guesser:
    """Costs of values for words ranked by how early guessing tries them; answers for short values are kept."""

    def __init__(self, ranks: dict[str, int] = FIXED):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self._known = lru_cache(maxsize=100_000)(self._short)

    def _short(self, value: str) -> float:
        return _cheapest(value, self.ranks, self.longest)

    def digits(self, value: str) -> float:
        """Decimal digits of the guesses for a value."""
        return self._known(value) if len(value) <= 128 else _cheapest(value, self.ranks, self.longest)


def ranked(docs: DataFrame, most: int = CORPUS_WORDS) -> dict[str, int]:
    """Ranks of the fixed words and, after them, of the corpus's ``most`` commonest words of letters a to z (ties by word).

    Words are counted over all texts and combined before the shuffle; at most ``most`` short strings reach the driver.
    """
    words = F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word")
    counted = docs.select(words).filter(F.length("word").between(CORPUS_LETTERS, 24)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]
    return FIXED | {w: len(FIXED) + k + 1 for k, w in enumerate(w for w in best if w not in FIXED)}


def _cheapest(value: str, ranks: dict[str, int] = FIXED, longest: int = 24) -> float:
    """Decimal digits of the guesses for a value: the cheapest cut into words, dates, repeats, keyboard walks and spans
    found by trying all signs.

    best[k] is the least cost of the first k signs; words are bounded by the longest one and other pieces are known from
    their ends, so the work is linear in the value's length.
    """
    n = len(value)
    small = value.lower()
    plain = small.translate(_PLAIN)
    best = [0.0] + [math.inf] * n
    walk, same = [1] * (n + 1), [1] * (n + 1)
    for k in range(1, n):
        if small[k] in _NEAR.get(small[k - 1], ()) and small[k] != small[k - 1]:
            walk[k] = walk[k - 1] + 1
        if small[k] == small[k - 1]:
            same[k] = same[k - 1] + 1
    again, dates = _repeats(small), {}
    for m in _DATE.finditer(value):
        dates.setdefault(m.end(), []).append(m.start())
    for end in range(1, n + 1):
        options = [best[end - 1] + math.log10(_alphabet(value[end - 1]))]
        for start in range(max(0, end - longest), end - 1):
            piece = small[start:end]
            rank = ranks.get(piece)
            swapped = rank is None and (rank := ranks.get(plain[start:end])) is not None
            if rank is not None:
                case = 2 if value[start:end] != piece else 1
                options.append(best[start] + math.log10(rank + 1) + math.log10(case * (4 if swapped else 1)) + 0.3)
        for start in dates.get(end, ()):
            options.append(best[start] + (4.6 if end - start > 4 else 2.1))
        if walk[end - 1] >= 4:
            length = walk[end - 1]
            options.append(best[end - length] + math.log10(47 * 8) + 0.5 * math.log10(4) * (length - 1))
        if same[end - 1] >= 3:
            length = same[end - 1]
            options.append(best[end - length] + math.log10(_alphabet(value[end - 1]) * length))
        options += [best[end - period] + 0.3 for period in again.get(end, ())]  # the block before, once more
        best[end] = min(options)
    return best[n]


def _repeats(value: str) -> dict[int, list[int]]:
    """For each place the lengths of the blocks that end there and stand a second time right before: of up to eight signs
    all, of more those whose signs all were last met, four by four, at the block's distance."""
    out: dict[int, list[int]] = {}
    n = len(value)
    for period in range(2, min(9, n // 2 + 1)):
        run = 0
        for k in range(period, n):
            run = run + 1 if value[k] == value[k - period] else 0
            if run >= period:
                out.setdefault(k + 1, []).append(period)
    last: dict[str, int] = {}
    run = before = 0
    for k in range(n - 3):
        four = value[k : k + 4]
        distance = k - last.get(four, k)
        last[four] = k
        run, before = (run + 1 if distance == before else 4) if distance else 0, distance
        if distance > 8 and run >= distance:
            out.setdefault(k + 4, []).append(distance)
    return out


def _cases(value: str) -> float:
    """Decimal digits of the guesses for where the capitals stand, none for a word in lower case, in capitals or with one first."""
    capitals = sum(x.isupper() for x in value)
    return 0.0 if capitals in (0, len(value)) or value[1:].islower() else math.log10(math.comb(len(value), capitals))


def spans(text: str | None, hard: float = HARD, guesser: Guesser | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Base spans (kind, start, stop) by start and kind, and values of the method (kind ``guess``, start, stop, digits)."""
    text, guesser = text or "", guesser or Guesser()
    small = text.lower()
    assigns = list(ASSIGN.finditer(text)) if any(w in small for w in ("password", "passwd", "secret", "token", "api")) else []
    base = [("assign", m.start(), m.end()) for m in assigns if len(m[2]) >= LEAST["assign"]]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] if "AKIA" in text else []
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    order = {"assign": 0, "access": 1, "hex": 2}
    base.sort(key=lambda s: (s[1], order[s[0]]))
    values = []
    hinted = any(w in small for w in ("pass", "pwd", "pin", "credential", "auth", "bearer", "key", "secret", "login"))
    contexts, named = (CONTEXT.finditer(text), (m for m in NAMED.finditer(text) if PART.search(m[1]))) if hinted else ((), ())
    for found, group in ((assigns, 2), (contexts, 1), (named, 2)):
        for m in found:
            value, digits, least = m[group], guesser.digits(m[group]), hard
            if value.rstrip(".=-_!").isalpha():
                digits, least = digits + _cases(value), hard + LETTERS
            if len(value) >= LEAST["assign"] and digits >= least:
                values.append(("guess", m.start(group), m.end(group), digits))
    return base, sorted(set(values), key=lambda s: s[1:])


def _scan(hard: float, ranks: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guesser = Guesser(ranks)
        for pdf in batches:
            both = [spans(t, hard, guesser) for t in pdf.text]
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "base": [[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x, _ in both],
                "values": [[{"kind": k, "start": a, "stop": b, "digits": d} for k, a, b, d in y] for _, y in both]})

    return run


def scanned(docs: DataFrame, hard: float = HARD, most: int = CORPUS_WORDS) -> DataFrame:
    """(doc_id, base, values) for each row (doc_id, text): spans in code points, ends exclusive.

    Words are ranked by their frequency in all texts, so that a value made of common words is easy to guess.

    Null text counts as empty. Rows that share a doc_id, or have none, are rows of their own; empty tables give none.
    """
    schema = "doc_id long, base array<struct<kind:string,start:long,stop:long>>, values array<struct<kind:string,start:long,stop:long,digits:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scan(hard, ranked(docs, most)), schema)
