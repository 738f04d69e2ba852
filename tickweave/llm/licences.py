"""Licence notices by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import LOWER, UPPER

#: Phrases whose consecutive words are a place of their own, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices; a block that holds enough of one's words gets its label.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at www apache org licenses license 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "all rights reserved": "reserved",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
}
#: Whole public notices.
NOTICES = {
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
    the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
    Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
    IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
    WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions
    of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
    above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
    SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
    OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
    OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
    IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""": "bsd",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
    License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
    distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License.""": "apache",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
    Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
    have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""": "gpl",
    """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
    http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""": "cc-by",
}
#: Share of a template's words that a block must hold, and a block's length in template lengths.
CONTAINED, BLOCK_LENGTH = 0.8, 1.25

_SPACED = bytes(
    LOWER.encode()[UPPER.encode().index(c)] if c in UPPER.encode() else c if c >= 0x80 or chr(c) in LOWER + "0123456789" else 0x20 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters a to z after lowering A to Z, and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def _vocabulary(templates) -> dict[bytes, int]:
    return {w: k for k, w in enumerate(sorted({w for t in templates for w in tokens(t)}))}


def frequencies(docs: DataFrame, templates=(*PHRASES, *TEMPLATES, *NOTICES)) -> dict[bytes, int]:
    """How often each word of the templates stands in all texts; as many rows as the templates have words reach the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = _vocabulary(templates)
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for pdf in batches:
            for text in pdf.text:
                total += np.bincount(np.fromiter((vocabulary.get(w, -1) + 1 for w in tokens(text)), np.int64), minlength=len(total))
        yield pd.DataFrame({"word": [w.decode() for w in vocabulary], "n": total[1:]})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in _vocabulary(templates)} | {r.word.encode(): r.n for r in rows}


class _Template:
    """A template's words from the rarest on, and how many of them must meet."""

    def __init__(self, text: str, label: str, rank: dict[bytes, int], vocabulary: dict[bytes, int], contained: float, stretch: float):
        words = tokens(text)
        self.label, self.words = label, np.array([vocabulary[w] for w in words])
        rarest = sorted(set(words), key=rank.__getitem__)
        self.ordered = [vocabulary[w] for w in rarest]
        self.need = int(np.ceil(contained * len(rarest) - 1e-9))
        # a block that lacks all of these cannot hold enough of the others
        self.prefix = self.ordered[: len(rarest) - self.need + 1]
        self.length = int(np.ceil(stretch * len(words)))
        self.member = np.zeros(len(vocabulary) + 1, bool)
        self.member[self.ordered] = True


class Scanner:
    """Places of phrases and blocks that hold templates in a text, for words ranked by their global frequency."""

    def __init__(self, frequency: dict[bytes, int], contained: float = CONTAINED, stretch: float = BLOCK_LENGTH, phrases=PHRASES, templates=TEMPLATES | NOTICES):
        self.vocabulary = _vocabulary((*phrases, *templates))
        order = sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: k for k, w in enumerate(order)}
        self.phrases = [_Template(t, label, rank, self.vocabulary, 1.0, 1.0) for t, label in phrases.items()]
        self.templates = [_Template(t, label, rank, self.vocabulary, contained, stretch) for t, label in templates.items()]
        self.first = np.zeros(len(self.vocabulary) + 1, bool)
        for t in (*self.phrases, *self.templates):
            self.first[t.prefix] = True

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Number of words, phrase places (start, label), and blocks (start, stop, label, share of the template held)."""
        words = tokens(text)
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(self.first[ids])
        if not len(known):
            return len(words), [], []
        places, blocks = [], []
        where: dict[int, np.ndarray] = {}
        for word in np.unique(ids[known]).tolist():
            where[word] = known[ids[known] == word]
        for t in self.phrases:
            at = where.get(t.prefix[0])
            if at is None:
                continue
            for offset in np.flatnonzero(t.words == t.prefix[0]).tolist():
                starts = at - offset
                starts = starts[(starts >= 0) & (starts + len(t.words) <= len(ids))]
                for k, w in enumerate(t.words.tolist()):
                    starts = starts[ids[starts + k] == w]
                places += [(int(s), t.label) for s in starts]
        present = set(np.unique(ids).tolist())
        for t in self.templates:
            # length filter: too few of the template's words anywhere in the text
            if sum(w in present for w in t.ordered) < t.need:
                continue
            hits = [where[w] for w in t.prefix if w in where]
            if hits:
                blocks += self._blocks(t, ids, np.unique(np.concatenate(hits)))
        return len(words), sorted(set(places)), sorted(blocks)

    def _blocks(self, t: _Template, ids: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Stretches of overlapping blocks of t.length words that hold enough of the template and one of its prefix words."""
        found: list[list] = []
        # stretches of places around hits that are closer than a block
        cuts = np.flatnonzero(np.diff(hits) >= t.length)
        for a, b in zip(np.r_[0, cuts + 1], np.r_[cuts, len(hits) - 1]):
            low, high = max(0, int(hits[a]) - t.length + 1), min(len(ids), int(hits[b]) + t.length)
            inside = low + np.flatnonzero(t.member[ids[low:high]])
            # length filter: a stretch with too few of the template's words, repeats included, holds no block
            if len(inside) < t.need:
                continue
            # positional filter: the block that ends at a place holds no more words than stand from its first place to this one
            first = np.searchsorted(inside, inside - t.length + 1)
            can = np.arange(1, len(inside) + 1) - first >= t.need
            if not can.any():
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, can, False]))
            for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                self._verified(t, ids, inside, int(first[begin]), begin, end, found)
        return [tuple(f) for f in found]

    @staticmethod
    def _verified(t: _Template, ids: np.ndarray, inside: np.ndarray, first: int, begin: int, end: int, found: list[list]) -> None:
        """Count distinct words of the blocks that end at the places begin to end, and join those that hold enough."""
        count: dict[int, int] = {}
        for k in range(first, end):
            place, word = int(inside[k]), int(ids[inside[k]])
            count[word] = count.get(word, 0) + 1
            while place - int(inside[first]) >= t.length:
                gone = int(ids[inside[first]])
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
                first += 1
            if k >= begin and len(count) >= t.need:
                start, stop, share = int(inside[first]), place + 1, len(count) / len(t.ordered)
                if found and start < found[-1][1]:
                    found[-1][1], found[-1][3] = stop, max(share, found[-1][3])
                else:
                    found.append([start, stop, t.label, share])


def scanned(docs: DataFrame, contained: float = CONTAINED, stretch: float = BLOCK_LENGTH) -> DataFrame:
    """(doc_id, n_words, places, blocks) for each row (doc_id, text): places of phrases (start, label) and blocks
    (start, stop, label, share), in words from 0.

    Null text has no words. Rows that share a doc_id, or have none, are rows of their own; empty tables give none.
    """
    frequency = frequencies(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(frequency, contained, stretch)
        for pdf in batches:
            n, places, blocks = zip(*[scanner.scan(t) for t in pdf.text]) if len(pdf) else ((), (), ())
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "n_words": list(n), "places": [[{"start": s, "label": x} for s, x in p] for p in places],
                "blocks": [[{"start": a, "stop": b, "label": x, "share": c} for a, b, x, c in p] for p in blocks]})

    schema = "doc_id long, n_words long, places array<struct<start:long,label:string>>, blocks array<struct<start:long,stop:long,label:string,share:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
