"""Token ids in files of directly addressable codes.

Each id is cut into 8-bit chunks, the lowest first. Level 0 holds the first chunk of every id, level 1 the second chunk of the
ids that have one, and so on. Beside each level but the last a bitmap says which of its chunks go on, and a rank directory says
how many do before each block of 512 bits; the chunk of the next level is found by that count. Any token is read by touching
a few bytes of each level; no block is decoded.

A file is one segment: whole documents in ascending doc_id order, until SEGMENT_TOKENS ids are reached. All numbers little-endian:

    magic     8 bytes  TWDAC01 and a zero byte
    header    6 int64  documents, ids, levels, place of the partition, place in the partition, size of the segment in bytes
    doc_id    int64 each; nulls: a byte each, 1 where the doc_id is null
    starts    int64 each and one more: ids of the segment before the document
    per level int64 number of chunks; then, each padded to 8 bytes: the chunks; but for the last level the bitmap as uint64
              words and the directory as a uint32 for every 512 bits and one more
    a line feed (Spark's text sink ends a row with it)

Writing: documents are ranged by doc_id, sorted, encoded and cut into segments as they stream; a worker holds one segment.
Spark's text sink writes the raw bytes of one row a file, through its commit protocol and to any file system it knows, so a
lost executor leaves no half-written file. Reading: Spark's binaryFile source.

Encoding uses the tokenizers library. A text is cut into words where the library cuts it, each word is asked of the library's
model once and its ids are kept and joined; texts with characters beyond U+024F go to the library whole. Text that looks like
a special token is ordinary text.

Defined results: null text is empty and has the end id alone; a null doc_id comes first; rows with one doc_id stay separate,
ordered by a hash of the text; an empty table gives no rows and no files. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickweave.llm.common import whole_text
from tickweave.session import cut

MODEL = public_tokenizers.path("byte_bpe_50k.json")
END = 2
MAGIC = b"TWDAC01\0"
#: Ids after which a segment takes no further document.
SEGMENT_TOKENS = 1 << 21
#: Words whose ids a worker keeps, in two generations: those of the younger one and, of the older one, those met again.
KEPT_WORDS = 600_000
BLOCK = 512

#: Letters, digits and white space up to U+024F as the tokenizer's word pattern takes them.
LETTERS, DIGITS, WHITE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\r\\x0b\\x0c\\x85\\xa0"
WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{WHITE}{LETTERS}{DIGITS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
FAR = re.compile("[^\\x00-\\x1b\\x20-ɏ]")


def _shown() -> dict[int, str]:
    """Byte-level models read a byte as the character of its number where that is printable, and the others, in order, as
    characters from U+0100 on."""
    plain = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(256 + k) for k, b in enumerate(rest)}


SHOWN = _shown()


class _Words(dict):
    """Ids of words as bytes, asked of a model when first met; one of the older generation joins the younger when met again."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (raw := self.older.get(word)) is None:
            ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(SHOWN))])
            if sys.byteorder == "big":
                ids.byteswap()
            raw = ids.tobytes()
        self[word] = raw
        return raw

    def grown(self, most: int) -> None:
        if len(self) > most // 2:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, model: str = MODEL, kept: int = KEPT_WORDS):
        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.encode_special_tokens = True
        self.words, self.kept = _Words(self.tokenizer.model), kept

    def encode(self, text: str) -> bytes:
        if FAR.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        raw = b"".join(map(self.words.__getitem__, WORDS.findall(text)))
        self.words.grown(self.kept)
        return raw


@cache
def encoder(model: str) -> Encoder:
    return Encoder(model)


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def levels(ids: np.ndarray) -> Iterator[bytes]:
    """Parts of the file for each level of the ids."""
    rest = ids.astype(np.uint32)
    while True:
        on = rest > 255
        yield np.int64(len(rest)).tobytes() + _padded((rest & 255).astype(np.uint8).tobytes())
        if not on.any():
            return
        bits = _padded(np.packbits(on, bitorder="little").tobytes())
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.uint32)
        yield bits + _padded(np.r_[0, counts.cumsum()].astype("<u4").tobytes())
        rest = rest[on] >> 8


def segment(docs: list[tuple[int | None, np.ndarray]], place: int = 0, turn: int = 0) -> bytes:
    """The bytes of one file for (doc_id, ids) rows."""
    ids = np.concatenate([i for _, i in docs]) if docs else np.empty(0, np.uint32)
    parts = list(levels(ids))
    body = [
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), _padded(bytes(d is None for d, _ in docs)),
        np.r_[0, np.cumsum([len(i) for _, i in docs], dtype=np.int64)].astype("<i8").tobytes(), *parts,
    ]
    size = len(MAGIC) + 48 + sum(map(len, body))
    return MAGIC + np.array([len(docs), len(ids), len(parts) // 2 + 1, place, turn, size], "<i8").tobytes() + b"".join(body)


class Segment:
    """Reads a segment in place; nothing is decoded until asked for."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_ids, depth, self.place, self.turn, size = map(int, np.frombuffer(raw, "<i8", 6, 8))
        if len(raw) < size:
            raise ValueError("a file of directly addressable codes is cut short")
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at) if n else np.empty(0, kind)
            at += -(-out.nbytes // 8) * 8
            return out

        self.doc_ids, self.nulls, self.starts = take("<i8", self.n_docs), take("u1", self.n_docs), take("<i8", self.n_docs + 1)
        self.levels = []
        for level in range(depth):
            n = int(take("<i8", 1)[0])
            chunks, more = take("u1", n), level < depth - 1
            self.levels.append((chunks, take("<u8", -(-n // 64)) if more else None, take("<u4", -(-n // BLOCK) + 1) if more else None))

    def at(self, i: int) -> int:
        """The id at one place, by a chunk, a bit and a rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if bits is None or not int(bits[i >> 6]) >> (i & 63) & 1:
                break
            first, word = i // BLOCK * (BLOCK // 64), i >> 6
            below = int(bits[word]) & ((1 << (i & 63)) - 1)
            i = int(ranks[i // BLOCK]) + int(np.bitwise_count(bits[first:word]).sum()) + below.bit_count()
        return value

    def between(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids from place a to place b (exclusive): one rank a level, then runs of chunks."""
        chunks, bits, ranks = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        if bits is not None and a < b:
            low, block, word = a // 64 * 64, a // BLOCK, a >> 6
            on = np.unpackbits(bits[word : -(-b // 64)].view(np.uint8), bitorder="little")[a - low : b - low].view(bool)
            first = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK // 64) : word]).sum()) + (int(bits[word]) & ((1 << (a & 63)) - 1)).bit_count()
            out[on] |= self.between(first, first + int(np.count_nonzero(on)), level + 1) << np.uint32(8)
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the segment, ids) of each document."""
        for d, null, a, b in zip(self.doc_ids.tolist(), self.nulls, self.starts[:-1].tolist(), self.starts[1:].tolist()):
            yield None if null else d, a, self.between(a, b)


def _encoded(batches: Iterable[pd.DataFrame], model: str, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
    code, tail = encoder(model), np.uint32(end).tobytes()
    for pdf in batches:
        for ident, none, text in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"]):
            yield None if none else ident, np.frombuffer(code.encode(text) + tail, "<u4")


def _segments(model: str, end: int, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        place, turn, docs, n = TaskContext.get().partitionId(), 0, [], 0
        for row in _encoded(batches, model, end):
            docs.append(row)
            n += len(row[1])
            if n >= most:
                yield pd.DataFrame({"content": [segment(docs, place, turn)]})
                turn, docs, n = turn + 1, [], 0
        if docs:
            yield pd.DataFrame({"content": [segment(docs, place, turn)]})

    return run


def write(docs: DataFrame, folder: str, model: str = MODEL, end: int = END, most: int = SEGMENT_TOKENS) -> None:
    """Encode all documents and write their ids, in ascending doc_id order, as files of directly addressable codes."""
    ident = F.col("doc_id").cast("long")
    rows = docs.select(ident.isNotNull().alias("known"), F.coalesce(ident, F.lit(0)).alias("doc_id"), F.xxhash64(whole_text()).alias("tie"), whole_text().alias("text"))
    ordered = rows.repartitionByRange("known", "doc_id", "tie").sortWithinPartitions("known", "doc_id", "tie").select("doc_id", (~F.col("known")).alias("no_id"), "text")
    files = ordered.mapInPandas(_segments(model, end, most), "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for raw in pdf["content"]:
            if len(raw) > 1:
                part = Segment(raw)
                ids, starts = part.between(0, part.n_ids).astype("<u4", copy=False), part.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                doc = pd.arrays.IntegerArray(part.doc_ids.astype(np.int64), part.nulls.astype(bool))
                yield pd.DataFrame({"doc_id": doc, "at": starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": np.array(crc, np.int64), "place": part.place, "turn": part.turn})


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(path, part.place, part.turn, part.n_ids) for path, part in ((p, Segment(r)) for p, r in zip(pdf["path"], pdf["content"]) if len(r) > 1)]
        yield pd.DataFrame(rows, columns=["path", "place", "turn", "n"])


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _firsts(parts: DataFrame) -> DataFrame:
    """(place, turn, n, first) of segments from (place, turn, n): the ids before each, by partition and within it."""
    per = parts.groupBy("place").agg(F.sum("n").alias("n"))
    before = per.select("place", (F.sum("n").over(W.orderBy("place")) - F.col("n")).alias("before"))  # a row for each partition written
    return parts.join(before, "place").select("place", "turn", "n", (F.col("before") + F.sum("n").over(W.partitionBy("place").orderBy("turn")) - F.col("n")).alias("first"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a folder; the files are read once."""
    rows = cut(files(spark, folder).select("content").mapInPandas(_read, "doc_id long, at long, n_tokens long, ids_crc32 long, place long, turn long"))
    firsts = _firsts(rows.groupBy("place", "turn").agg(F.sum("n_tokens").alias("n"))).select("place", "turn", "first")
    return rows.join(firsts, ["place", "turn"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for raw, wanted, first in zip(pdf["content"], pdf["wanted"], pdf["first"]):
            part = Segment(raw)
            yield pd.DataFrame({"position": wanted, "id": [part.at(int(p) - int(first)) for p in wanted]})


def lookup(spark: SparkSession, folder: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """(position, id) for places in the whole sequence of ids; each file that holds some is read, none is decoded.

    Positions that are null, negative or beyond the last id give no row, repeated ones one row.
    """
    heads = files(spark, folder).mapInPandas(_heads, "path string, place long, turn long, n long")
    spans = heads.join(_firsts(heads.select("place", "turn", "n")).drop("n"), ["place", "turn"]).filter("n > 0")
    cell = lambda c: F.shiftright(c, 20)
    cells = spans.select("path", "first", "n", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("n") - 1))).alias("cell"))
    wanted = positions.select(F.col(position).cast("long").alias("position")).distinct().withColumn("cell", cell(F.col("position")))
    met = wanted.join(cells, "cell").filter((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n")))
    per = met.groupBy("path", "first", "cell").agg(F.collect_list("position").alias("wanted"))  # at most the 2^20 places of a cell
    return per.join(files(spark, folder), "path").select("content", "wanted", "first").mapInPandas(_looked_up, "position long, id long")
