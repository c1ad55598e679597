"""The training-data pipeline: each stage works on what its predecessor kept and wrote.

Every stage but the last returns the columns of ``documents`` as they came, whatever other columns there are. Rows are
judged one by one whatever their number: null ids, sources and texts are values like others, repeated rows are rows
each unless a stage says otherwise, very long texts are read whole, and without documents a stage gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicewin.llm import decontaminate, mixing, neardup, quality, sharding
from slicewin.llm.common import materialize, table

#: The quality classifier is a trained model, which SQL cannot express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are no junk and stay; equal texts are judged alike."""
    return quality.keep_accepted(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (shingles of five words, similarity 0.8), that of the smallest id.

    Of rows of one id one stays; rows without id are compared like others and stand behind all ids. Null, empty and
    wordless texts are in no group with others.
    """
    return neardup.keep_one_of_each(docs, 5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item, nor the whole of an item of one to nine words.

    Null and empty texts stay; equal texts stay or go together.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document comes as many times as its source's epochs take it, in part at the cut counting as whole.

    Null sources are a source of their own; rows of one id and source share what the mix takes of them evenly;
    documents without words stay once.
    """
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of each row of the mix; equal rows have places of their own, in any order."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
