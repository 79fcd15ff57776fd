"""The corpus pipeline: stages that take documents and return documents, run one after the other.

Every stage but the last returns the columns it was given, extra ones and such with clashing names included. Defined results:

* Null and empty texts are the same to all stages: they get the score of texts without neighbours, are copies of one another (the
  row with the largest id stays), have no shingles, and no words, so the mix never takes them.
* Rows without an id pass the filters like others; as near copies they are linked with nothing; in the mix they share one number.
* Repeated rows of one id are copies by their texts; an id is dropped as a near copy only with all rows of it that stayed so far.
* Ties go to the largest id among exact copies, to the smallest among near copies, and by hashes of ids in the mix.
* A null source is a source of its own. Very long texts are read whole. Without documents, or without labels, the stages
  give empty tables, or keep all texts as not toxic.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import bpe, exact_dedup, near_dedup, source_mix, toxicity
from sievemark.llm.frames import small_batches, table, written
from sievemark.llm.queries import toxicity_model

#: Not expressible in SQL (the toxicity model); tested against a plain version instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return near_dedup.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, at most three times."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
