"""Corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes what the one before kept, as Parquet. All but the last return the columns of documents, in their order.
Null texts stay null and are kept by every filter; empty texts are kept, also those that a stage has emptied. Rows with null
ids are kept: of equal texts among them, only as near-duplicates are. Rows that repeat an id are rows of their own until the
second stage, which keeps one of rows equal in id and text. Other columns, whatever their names, are carried along;
``n_chars`` follows the text. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, tune, written
from quarry.llm.neardup import one_of_each
from quarry.llm.packing import pack_documents
from quarry.llm.pii import sanitise
from quarry.llm.suffixes import without_repeats
from quarry.llm.tokenizer_files import tokenizer_path
from quarry.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below the threshold; all of them where the labels have one class only. Null texts score as
    texts without letters."""
    return without_toxic(docs, table(tune(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) the document with the least id. Texts without words
    are alike to nothing."""
    tune(spark)
    return one_of_each(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur more than once; a character goes if all its bytes do."""
    tune(spark)
    return without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced or removed."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences; a null or empty text is one piece, the end id."""
    tune(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL has no words for the first and last stage; ``tests/llm/test_pipeline.py`` holds a run against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
