"""Helpers shared by the text operators: words in JVM expressions, checked broadcasts, rows that carry foreign columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.session import prepare

#: The white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: The only letters that lower() of the contracts touches.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table of short rows counts as small enough to broadcast.
BROADCAST_ROWS = 100_000
ROW = "__row"


#: Bytes of rows that go to a Python worker at once; whole texts are long, and Spark's own bound of rows alone says little.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    """Words of a text as an array, empty for a text without any."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator needs beside all columns as one struct, so that no other name can clash with its own."""
    return df.select(*needed, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def join_small(left: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a written table: broadcast when its counted rows are few, else Spark's choice with skew handling."""
    return left.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on, how)


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on nothing but its parts."""
    hashed = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def groups(batches: Iterator[pd.DataFrame], *key: str) -> Iterator[pd.DataFrame]:
    """Rows with one key, from the batches of a partition sorted by it."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        keys = pdf[list(key)].to_numpy()
        bounds = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[bounds[-1] :]
    if rest is not None and len(rest):
        yield rest
