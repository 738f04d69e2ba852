"""Documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import minhash, mixing, pieces, privacy
from tickweave.llm import quality as rules
from tickweave.llm.common import ROW, table
from tickweave.session import shared_folder

#: Words of a shingle in the near-duplicate stage; op1 alone compares pairs of words, which link more.
STAGE_WORDS = 5
#: Encoded stretches that a worker keeps in the last stage.
KEPT_STRETCHES = 60_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, compared with the languages of all documents."""
    return rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once."""
    return minhash.without_near_duplicates(docs, words=STAGE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that reveal it replaced."""
    return privacy.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, one row for each draw of a document."""
    return mixing.mix(docs).select(f"{ROW}.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each drawn text. Python workers outlive a stage, so they keep few encodings beside those of other stages."""
    return pieces.with_round_trip(docs, remembered=KEPT_STRETCHES)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: No SQL: the near-duplicate search, the mix and the tokenizer are not SQL; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
