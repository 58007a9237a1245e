"""The corpus pipeline: quality classifier, toxicity, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first three return the columns
of documents. Classifiers are fitted on the documents that the stage is given and on the labels of the corpus.
Documents may have further columns, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spectrallake.llm import ngram_jaccard, packing, quality, toxicity
from spectrallake.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes; as many as have an advantage of 0 or more.

    Null, empty and very short texts have next to no n-grams and stand at the prior, which keeps all but about one in a
    thousand. Rows of one doc_id share their noise; a null doc_id is judged like others. Equal keys stay or go together.
    """
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, each row by its text alone; null and empty texts score like labelled texts without words."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id. Rows of one doc_id with different texts are judged apart; texts without words all stay."""
    return ngram_jaccard.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; null and empty texts make one piece of one token, repeated rows are packed each."""
    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", duplicate_stage), ("packing", packing_stage)]

#: Trained classifiers and tokenizers can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
