"""The registered queries of the operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.bagminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.covertree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.line_rules import line_rules

    return line_rules(table(spark, sf_dir, "documents"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.unigram import token_counts, zipf_vocabulary

    return token_counts(table(spark, sf_dir, "documents"), zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import HELD_OUT, identify, learn

    docs = table(spark, sf_dir, "documents")
    net = learn(docs.where(~F.expr(HELD_OUT)))
    return identify(docs, net, passed={"held_out": F.expr(HELD_OUT)})


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.licenses import learn, scan

    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.shards import write_shards

    return write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_stripe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_masked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.runs import periodic_runs, planted

    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.crosspolytope import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
