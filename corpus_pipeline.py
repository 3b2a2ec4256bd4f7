"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Stages but the last return the columns of documents, whatever other columns there are.  Defined results, by stage (the modules in tesserae.llm say more):

* language ID rejects null texts, texts without letters, and those in no known language; null identifiers don't matter
* exact dedup keeps the row with the smallest doc_id of equal texts, one of repeated rows; a null doc_id is larger than all others
* the near-duplicate join keeps the smallest doc_id of a group; rows with null doc_id, and texts without words, are in none
* substring dedup leaves rows with null doc_id and texts of fewer than 50 words as they are
* packing gives each document, however long, all its pieces, a null doc_id included
* an empty table goes through all stages and gives no sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.exact import drop_copies
from tesserae.llm.langid import keep_identified
from tesserae.llm.ngram_join import drop_near_copies
from tesserae.llm.packing import pack_documents
from tesserae.llm.substring import cut_repeats
from tesserae.llm.text import spread

#: Naive Bayes and a near-duplicate closure have no counterpart in SQL; the tests compare with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be identified go."""
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram Jaccard pairs connect, the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first and are cut elsewhere; documents of which nothing is left go."""
    return cut_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed sequence, with the doc_ids in it."""
    return pack_documents(docs)


STAGES = [("language id", language), ("exact dedup", exact_copies), ("n-gram jaccard join", near_copies), ("substring dedup", repeated_passages), ("best-fit packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
