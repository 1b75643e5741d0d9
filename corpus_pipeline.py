"""A corpus from documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but
the last return the columns of documents.  ORACLE_SQL is None: a trained network, a noisy
top-k and signatures can't be expressed in SQL; the stages are tested against brute force.
An empty table gives an empty one at every stage, and columns of any name are carried along,
but for those of the last stage's results, which replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bagminhash import deduplicated
from gridloom.llm.bpe import bpe_round_trip
from gridloom.llm.common import drop, new_folder, stored, table
from gridloom.llm.langid import HELD_OUT, identified_documents
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.resample import resampled_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without letters or in no clear language go."""
    return identified_documents(docs, docs.where(~F.expr(HELD_OUT)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled as good.

    Null and empty texts go; repeated rows stay or go together; without labels of good rows all texts stay.
    """
    return resampled_documents(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; all rows with a null text stay.

    A null id comes last; of rows that are repeated with their id one stays.
    """
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or repeated, at most three times.

    Texts without a word are never taken; a null source is a source of its own.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their number of tokens and digests of ids and decoded bytes; a null text counts as empty, rows as often as they occur."""
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, passed=tuple(docs.columns))


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it; what a stage has read is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "stage")
        docs = stored(stage(spark, docs, sf_dir), path=path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
