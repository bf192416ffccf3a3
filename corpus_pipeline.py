"""Corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``
(the last: packed pieces).  ``run`` writes every stage's result to the shared folder
and reads it again for the next, so a lost executor costs one stage's tasks.

In every stage null ids, empty tables, very long texts and extra columns of any name
pass through; columns other than those named in a stage are carried along unread.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import exact_dedup, langid, near_dedup, packing, substring_dedup
from kestrel.session import ship
from kestrel.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones; ``und`` and weak scores go.

    Null text and text without a letter are ``und``; repeated rows are judged alike; without labels all go.
    """
    return langid.accept(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the smallest doc_id stays; of repeated rows one; of null ids one a text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class by five-word shingles, Jaccard similarity 0.8 or more, stays.

    SimHash fingerprints within two bits by pigeonring come first, a prefix filter finds the links they cannot.
    Null and word-less texts are alike; of ties (repeated rows) one stays.
    """
    return near_dedup.deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again anywhere are cut; ``n_chars`` follows the text.

    Rows that lose nothing keep their text as it is, null and empty ones too; rows that lose every word go.
    """
    cut = substring_dedup.clean(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: which words of which document fill which place.

    Null and word-less texts have no piece; repeated rows are packed each.
    """
    return packing.pack(docs)


def _with_code(stage):
    """The stage, after its executors have been given the package."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _with_code(language)),
    ("exact_dedup", _with_code(exact)),
    ("simhash_near_dedup", _with_code(near)),
    ("substring_dedup", _with_code(substrings)),
    ("best_fit_packing", _with_code(packed)),
]

#: Learned language ID, fingerprints and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialize(docs, name)
    return docs
