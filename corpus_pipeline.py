"""A training-corpus pipeline of five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it again as the next one's docs. The quality classifier drops what it rejects, near-duplicates leave one
document of each group, contaminated documents go, personal data is replaced by the name of its kind, and the texts that
remain are encoded. Null texts and ids are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import decontam, neardup, pii, quality, sentencepiece_codec
from tallymark.llm.common import read, stash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose probability of a grade of 1 or more is under a half go."""
    return quality.select(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5's stage: the document with the smallest id of each component stays (five-word shingles, a Jaccard
    similarity of 0.8 or more, which fingerprints within 4 bits can't decide: see the README)."""
    return neardup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a twentieth or more of their words in benchmark windows go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every span becomes the name of its kind in brackets; n_chars follows the text."""
    return pii.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents with their token ids, and whether decoding them gives the text again."""
    return sentencepiece_codec.encode(docs, check="round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode),
]

#: The stages train a model and hash with XXH64, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
