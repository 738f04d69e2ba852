"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

The distinct stretches between word starts of a batch are joined into one text and indexed by a suffix array. Every piece is
looked up in it by binary search; its range of suffixes is its places. These edges, sorted by position, are relaxed from left
to right: a prefix of a text has one encoding, so each place keeps one last piece, the one whose edge starts at a place
whose own last piece stays apart from it, which holds if both together encode to just these two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

#: Place of the model; a parameter of every function here. The file lies at this path on every node.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What a worker keeps at most: encoded stretches of so many characters, those used last, and answers on pairs; and the
#: answers after which the new ones join the sorted ones.
REMEMBERED, KEPT_CHARS, MOST_PAIRS, NEW_PAIRS = 400_000, 64, 1_000_000, 4096
#: Characters that one index covers, and characters of texts that are taken together, unless one is longer.
INDEX_CHARS, BATCH_CHARS = 1 << 18, 1 << 21
_GAP = "\0"


class _Encodings(dict):
    """Encodings that are kept, in two generations, and those of the batch at hand.

    What the younger one lacks comes from the older one or the batch. A full younger one becomes the older one, so that
    stretches used again and again stay.
    """

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        if (ids := self.older.get(stretch)) is None:
            return self.other[stretch]
        self[stretch] = ids
        return ids

    def grown(self, most: int) -> None:
        if len(self) >= most // 2:
            self.older = dict(self)
            self.clear()


class Pieces:
    """A model's pieces, their ids and the order in which they merge."""

    def __init__(self, model: str):
        p = sentencepiece.SentencePieceProcessor(model_file=model)
        normal = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.ids = {self.names[i]: i for i in normal}
        self.score = {self.names[i]: p.get_score(i) for i in normal}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(p.get_piece_size()) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = p.unk_id()
        self.shown = ["" if p.is_control(i) else name for i, name in enumerate(self.names)]
        self.longest = max(map(len, self.ids))
        # no piece reaches over the start of a word, so texts can be cut there
        self.cuts = not any(SPACE in name.lstrip(SPACE) for name in self.ids)
        # nor, in some models, from a letter to another character or back
        turn = re.compile(f"[^\\W\\d_](?:[\\W\\d_])|(?:[^{SPACE}\\w]|[\\d_])[^\\W\\d_]")
        if self.cuts and not any(turn.search(name) for name in self.ids):
            self.stretch = re.compile(f"{SPACE}*(?:[^\\W\\d_]+|(?:[^{SPACE}\\w]|[\\d_])+)|{SPACE}+")
        else:
            self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.cuts else re.compile(r".+", re.S)
        names = sorted(self.ids)
        codes = np.zeros((len(names), self.longest), np.uint32)  # of characters
        for row, name in enumerate(names):
            codes[row, : len(name)] = np.frombuffer(name.encode("utf-32-le"), np.uint32)
        self.table, self.order, self.lengths = codes, names, np.array([len(n) for n in names])
        self.id_of = np.array([self.ids[n] for n in names] + [-1])
        self.text_of, self.strange = list(names), {}
        self.pairs, self.answers = np.empty(0, np.int64), np.empty(0, bool)
        self.apart: dict[int, bool] = {}
        self.done = _Encodings()

    def merged(self, text: str) -> list[str]:
        """The merges of a short text as the model defines them: best score first, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, char: str) -> int:
        """Number of a character that is no piece: numbers from 0 are pieces in order, these follow."""
        if (n := self.strange.get(char)) is None:
            n = self.strange[char] = len(self.order) + len(self.strange)
            self.text_of.append(char)
        return n

    def stay(self, keys: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side (numbers plus one, 0 for the start of a text) are the encoding of their text,
        for sorted distinct pairs. Answers known before are looked up in a sorted array."""
        at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), bool)
        out[known] = self.answers[at[known]]
        unknown = np.flatnonzero(~known)
        if len(unknown):
            out[unknown] = [self._answer(key) for key in keys[unknown].tolist()]
            if len(self.apart) >= NEW_PAIRS:
                if len(self.pairs) >= MOST_PAIRS:
                    self.pairs, self.answers = np.empty(0, np.int64), np.empty(0, bool)
                new = np.fromiter(self.apart, np.int64, len(self.apart))
                pairs, answers = np.r_[self.pairs, new], np.r_[self.answers, np.fromiter(self.apart.values(), bool, len(new))]
                order = np.argsort(pairs, kind="stable")
                self.pairs, self.answers = pairs[order], answers[order]
                self.apart.clear()
        return out

    def _answer(self, key: int) -> bool:
        if (answer := self.apart.get(key)) is None:
            left, right = key >> 32, key & 0xFFFFFFFF
            b = self.text_of[right - 1]
            a = self.text_of[left - 1] if left else ""
            answer = self.apart[key] = self.merged(a + b) == ([a, b] if left else [b])
        return answer

    def spelled(self, number: int) -> list[int]:
        if number < len(self.order):
            return [int(self.id_of[number])]
        raw = self.text_of[number].encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]


@lru_cache(maxsize=4)
def load(model: str) -> Pieces:
    return Pieces(model)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes by their first ``depth`` codes, by doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    done = 1
    while done < depth:
        ahead = np.zeros_like(rank)
        ahead[:-done] = rank[done:]
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        done *= 2
    return np.argsort(rank, kind="stable")


def ranges(codes: np.ndarray, order: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last suffix that starts with each piece, by binary search for one more code at a time."""
    padded = np.r_[codes, np.zeros(table.shape[1] + 1, codes.dtype)]
    low, high = np.zeros(len(table), np.int64), np.full(len(table), len(order), np.int64)
    for depth in range(table.shape[1]):
        live = np.flatnonzero((lengths > depth) & (low < high))
        if not len(live):
            break
        want = table[live, depth]
        for bound, past in ((low, False), (high, True)):
            a, b = low[live].copy(), high[live].copy()
            if past:
                a = first
            while (open_ := a < b).any():
                middle = (a + b) >> 1
                seen = padded[order[np.minimum(middle, len(order) - 1)] + depth]
                right = open_ & ((seen <= want) if past else (seen < want))
                a, b = np.where(right, middle + 1, a), np.where(open_ & ~right, middle, b)
            if past:
                low[live], high[live] = first, a
            else:
                first = a
    return low, high


def _edges(p: Pieces, codes: np.ndarray, joints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of every place of a piece in the text; a character that is no piece is an edge of its own."""
    order = suffix_array(codes, p.longest)
    low, high = ranges(codes, order, p.table, p.lengths)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    piece = np.repeat(found, count)
    first = np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) if len(found) else np.empty(0, np.int64)
    at = order[np.repeat(low[found], count) + np.arange(len(piece)) - first] if len(found) else np.empty(0, np.int64)
    length = p.lengths[piece]
    alone = np.ones(len(codes), bool)
    alone[joints] = False
    alone[at[length == 1]] = False
    strange = np.flatnonzero(alone)
    numbers = np.fromiter((p.number(chr(c)) for c in codes[strange].tolist()), np.int64, len(strange))
    return np.r_[at, strange], np.r_[at + length, strange + 1], np.r_[piece, numbers]


def _relax(p: Pieces, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> list[bytes]:
    """Encodings of the stretches begin[k] to end[k] of the text from its edges.

    Edges are sorted by the distance of their end from the stretch's begin, and all stretches move on together, one
    character at a time: of the edges that end at a place, the one whose piece stays beside the last piece at its start
    is that place's last piece. Then all walk back from their ends.
    """
    size = int(end.max()) + 1
    stretch = np.searchsorted(begin, starts, side="right") - 1
    away = ends - begin[stretch]
    by_place = np.argsort(away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away, kind="stable")
    starts, ends, piece, away = starts[by_place], ends[by_place], piece[by_place], away[by_place]
    fences = np.r_[0, np.flatnonzero(np.diff(away)) + 1, len(away)] if len(away) else np.zeros(1, np.int64)
    last, before = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    last[begin] = 0
    for k in range(len(fences) - 1):
        part = slice(fences[k], fences[k + 1])
        left = last[starts[part]]
        keys, where = np.unique((left << 32) | (piece[part] + 1), return_inverse=True)
        good = p.stay(keys)[where]
        to = ends[part][good]
        last[to], before[to] = piece[part][good] + 1, starts[part][good]
    live, here, steps = np.arange(len(begin)), end.copy(), []
    while len(live):
        steps.append((live, last[here]))
        here = before[here]
        on = here > begin[live]
        live, here = live[on], here[on]
    owner, number = np.concatenate([x[0] for x in steps]), np.concatenate([x[1] for x in steps]) - 1
    turn = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
    sorted_ = np.lexsort((-turn, owner))
    owner, number = owner[sorted_], number[sorted_]
    bounds = np.searchsorted(owner, np.arange(len(begin) + 1)).tolist()
    ids = p.id_of[np.minimum(number, len(p.order))].astype(np.int32)
    strange = set(owner[number >= len(p.order)].tolist())
    raw, out = ids.tobytes(), []
    for k in range(len(begin)):
        if k in strange:
            whole = [i for n in number[bounds[k] : bounds[k + 1]].tolist() for i in p.spelled(n)]
            out.append(np.array(whole, np.int32).tobytes())
        else:
            out.append(raw[4 * bounds[k] : 4 * bounds[k + 1]])
    return out


def _index(p: Pieces, stretches: list[str]) -> list[bytes]:
    """Encodings of some stretches, indexed together."""
    codes = np.frombuffer(_GAP.join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
    end = np.cumsum(lengths + 1) - 1
    return _relax(p, end - lengths, end, *_edges(p, codes, end[:-1]))


def encode(texts: list[str | None], model: str = MODEL, remembered: int = REMEMBERED) -> list[np.ndarray]:
    """Ids of each text, the model's own encoding; null and empty texts have none. About ``remembered`` stretches are kept."""
    p = load(model)
    cut = [p.stretch.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    done, here = p.done, {}
    group, size = [], 0

    def flush(group: list[str]) -> None:
        for s, ids in zip(group, _index(p, group)):
            (done if len(s) <= KEPT_CHARS else here)[s] = ids

    # sorted by length, so that a long stretch keeps no short ones waiting
    for s in sorted(set().union(*cut).difference(done, done.older), key=len):
        if _GAP in s:
            here[s] = _index(p, [s])[0]
            continue
        group.append(s)
        size += len(s) + 1
        if size >= INDEX_CHARS:
            flush(group)
            group, size = [], 0
    if group:
        flush(group)
    done.other = here
    out = [np.frombuffer(b"".join(map(done.__getitem__, parts)), np.int32) for parts in cut]
    done.other = {}
    done.grown(remembered)
    return out


def decode(ids, model: str = MODEL) -> str:
    """Text of ids: pieces joined, runs of bytes as UTF-8 with the replacement sign for what is none, marks as spaces
    and the first space dropped. Control pieces are empty; ids beyond the model raise IndexError."""
    p, bytes_ = load(model), load(model).byte_of
    numbers = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
    out = []
    if bytes_.keys().isdisjoint(numbers):
        out = [p.shown[i] for i in numbers]
    else:
        for is_byte, run in groupby(numbers, bytes_.__contains__):
            out += [bytes(bytes_[i] for i in run).decode("utf-8", "replace")] if is_byte else [p.shown[i] for i in run]
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def _encoder(model: str, back: bool, remembered: int = REMEMBERED):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # taken in parts, so that memory follows BATCH_CHARS or the longest text
            part = np.cumsum(pdf.text.str.len().fillna(0).to_numpy()) // BATCH_CHARS
            for _, rows in pdf.groupby(part, sort=False):
                ids = encode(rows.text.tolist(), model, remembered)
                out = rows[["doc_id"]].assign(n_pieces=[len(x) for x in ids], ids=ids)
                yield out.assign(round_trip=[decode(x, model) == (t or "") for x, t in zip(ids, rows.text)]) if back else out

    return run


def encoded(docs: DataFrame, model: str = MODEL, column: str = "text") -> DataFrame:
    """``doc_id``, n_pieces and ids of each row; rows that share a doc_id, or have none, are rows of their own.

    Whole texts are encoded; null and empty ones have no pieces. Other columns are not looked at; empty tables give none.
    """
    return docs.select("doc_id", docs[column].alias("text")).mapInPandas(_encoder(model, False), "doc_id long, n_pieces long, ids array<int>")


def with_round_trip(docs: DataFrame, model: str = MODEL, column: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """As ``encoded``, with round_trip: whether the decoded ids are the text (null as empty). A text that holds the
    model's own mark for a space, or unpaired surrogates, does not come back."""
    return docs.select("doc_id", docs[column].alias("text")).mapInPandas(_encoder(model, True, remembered), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def _decoder(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="ids").assign(text=[None if x is None else decode(x, model) for x in pdf.ids])

    return run


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and text of rows with ids; null ids have a null text."""
    return rows.select("doc_id", "ids").mapInPandas(_decoder(model), "doc_id long, text string")
