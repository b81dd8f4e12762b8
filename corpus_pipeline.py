"""The corpus pipeline: five stages, each of which works on all that the one before kept.

Every stage but the last returns the columns of documents. The check tool writes each stage's rows and
reads them again; ``run`` does the same in the shared folder, so that no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeledger.llm import mixing, near_dedup, pii, piece_codec, quality
from treeledger.llm.common import Scratch, table
from treeledger.llm.queries import piece_model_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on labelled ones of them."""
    classifier = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, classifier)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, on shingles of five words at 0.8."""
    return near_dedup.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, is replaced by its kind."""
    return pii.redact_table(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice in all; every document stays."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return piece_codec.digest_table(docs, piece_model_path())


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("PII", without_personal_data),
    ("mixing to target weights", mixed),
    ("SentencePiece encoding", encoded),
]

#: Random projections, hashed minima and the tokenizer's merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
