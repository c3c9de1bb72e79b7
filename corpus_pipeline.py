"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each works on all that its predecessor kept.
Every stage is written as a table below ``spark.checkpoint.dir`` and read again
by the next, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwatch.llm import exact_dedup, near_copies, quality
from lotwatch.llm.pack import REMEMBERED_AFTER_STAGES
from lotwatch.llm.queries import packed
from lotwatch.session import stored

# Documents that score less are rejected.
LEAST_QUALITY = 0.3


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit to them and the labels, scores at least ``LEAST_QUALITY``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, least=LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of 0.8 or more: the one with the smallest id.

    Candidates are the SimHash links of three bits and, as fingerprints of 64
    bits are too coarse for all of that similarity, those of min-hash bands;
    whole texts are compared (see ``near_copies``).
    """
    return near_copies.keep_one(docs, width=5, least=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place for each piece of at most 2048 tokens of every document left."""
    return packed(docs, REMEMBERED_AFTER_STAGES)


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

# The classifier and the links of near copies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
