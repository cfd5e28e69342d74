"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of `docs`, extra ones included; an empty table gives an empty table in every stage.  SQL cannot express signatures, span classification or packing, so the pipeline has no SQL; tests
hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthledger import ship
from hearthledger.llm import minhash_dedup, mixing, packing, pii, quality_rules
from hearthledger.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have no words and go; repeated rows are judged one by one alike; very long texts count whole.
    """
    return quality_rules.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles: the one with the smallest id.

    Texts without words and rows with a null id resemble nothing and stay; rows that repeat an id stay or go together.
    """
    ship(spark)
    return minhash_dedup.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every personal span replaced by its kind.

    Null and empty texts stay as they are; repeated rows are masked alike; very long texts are read whole.
    """
    ship(spark)
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut so that each source comes to its target.

    Null texts have no words and are not drawn; the null source is a source, ranked last; repeated rows are documents of their own.
    """
    ship(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences.

    A null or empty text is one piece, the end id; repeated rows are documents of their own; very long texts give many whole pieces.
    """
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
