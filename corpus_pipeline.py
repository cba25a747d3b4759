"""Corpus pipeline: the stages in order, each calling one operator of ``lexiflow.llm``.

A stage gets (spark, docs, sf_dir) and returns the rows that go on, with the columns of
``documents``; the last returns the packed pieces. ``run`` writes each stage's rows as
Parquet in the shared folder and reads them back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiflow.llm import exact_dedup, lang_id, mixing, ngram_join, packing
from lexiflow.llm.common import documents, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the trees have learned.

    Null texts, texts without a letter and texts that cost more bits than any training text
    allows go (``lang_id.keep_identified``). Null ids and languages, repeated rows and
    ties stay as they are; an empty table gives an empty one; extra columns are kept, and
    names that begin with ``__ppm_`` are taken.
    """
    return lang_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z folded): the largest doc_id.

    Null text counts as empty, a null id as smallest; of repeated rows one stays; an empty
    table gives an empty one; extra columns are kept, names with ``__dedup_`` are taken.
    """
    return exact_dedup.exact_dedup(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by Jaccard similarity of 0.8 over five-word shingles.

    Null and empty texts link with nothing and stay; a null id counts as largest; of
    repeated rows one stays; an empty table gives an empty one; extra columns are kept.
    """
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rows and files in the order of the Pfair schedule.

    A null source is a source; repeated rows, null texts and ids are places of their own, ties
    are broken by a hash; an empty table gives an empty one; extra columns are kept.
    """
    return mixing.mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stayed; the sequences follow the order of the rows, the schedule.

    Null and empty texts are their end id alone; repeated rows and null ids get pieces of
    their own; long texts are cut; an empty table gives an empty one; extra columns are not read.
    """
    return packing.pack_in_order(docs)


STAGES = [("language ID", identify), ("exact dedup", deduplicate), ("n-gram Jaccard join", drop_near),
          ("mixing", mix), ("best-fit packing", pack)]

#: Language models, near-duplicate groups and tokens have no SQL; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
