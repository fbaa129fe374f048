"""From raw documents to packed training sequences, in five stages.

Each stage is one operator over all that its predecessor kept, and its result
is written as Parquet and read again as the next one's documents: a stage that
fails is run again from there, and no plan grows over stages. All but the last
keep the columns of `documents` as they are.

Defined results: documents whose text is null, empty or without a letter go in
the first stage; of repeated rows one stays in the second; a null id is kept,
unless a document with an id has the same text; an empty table gives no rows;
further columns, whatever their names, come through to the last stage, which
reads only id and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforest.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from spanforest.llm.common import swept, table, written


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return language_id.keep_known(docs, language_id.learn(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, with their ids."""
    return packing.pack(docs, cache_pieces=100_000, text_bytes=1 << 20)  # workers that have run all stages have less memory to spare


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", recognised),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_contents),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Learned classifiers, signatures and tokenizers aren't SQL: tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with swept(spark) as kept:  # a stage's own tables go when its result is written
            docs = written(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
