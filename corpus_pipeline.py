"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of documents; packing returns one row per piece of a token window.

Edge cases, of all stages: null and repeated doc_ids lose no row, as rows go by a hash of id and text; an empty
table gives an empty table; other columns stay as they are, whatever their names; each stage says what null and
empty texts, ties and repeated rows come to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, jaccard, langid, mixing, packing
from tidemark.llm.common import materialize, reachable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one told below the calibrated level, go.

    Null texts and those without a letter have none; repeated rows go or stay together; no order matters."""
    reachable(spark)
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: most code points, then the smallest id, null last.

    Null counts as empty, so of empty texts one stays; of rows alike in id and text, one."""
    reachable(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of Jaccard similarity 0.8 or more stays.

    Texts without words are linked with nothing and stay; ties go by id, then by the row's hash."""
    reachable(spark)
    return jaccard.keep_one(docs, 5, 80, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it (not at all for 0).

    Texts without words are taken 0 times; a null source is a source; rows alike in id, source and size share one
    fate; ties in rank go by id and size."""
    reachable(spark)
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents (repeats are documents of their own) in windows of 1024 tokens.

    Null counts as empty: the end token alone. Only doc_id and text are read; ties are cut in any fixed order."""
    reachable(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard", near), ("mix_sources", mix), ("pack_windows", pack)]

#: Not expressible: a trained classifier, and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
