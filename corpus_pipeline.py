"""Corpus preparation: reject low quality, drop near-duplicates, mix sources to target weights, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes each
stage's rows as Parquet into the shared folder and reads them back as the next one's input.

In every stage null texts count as empty ones, rows that repeat an id are rows of their own, other columns
pass through (the last stage drops them) whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.bpe import encoded
from tapeloom.llm.common import find_package, kept, table
from tapeloom.llm.ftrl import accepted
from tapeloom.llm.mixing import sampled
from tapeloom.llm.simhash import one_of_each


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels it rejects none."""
    find_package(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; empty texts are one group, and of a group without any id one row stays."""
    find_package(spark)
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics approach their target shares; null values form one of their own."""
    find_package(spark)
    return sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    find_package(spark)
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("mixing", mix_sources), ("bpe", encode)]

#: A trained classifier, similarity components and byte-pair merges have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
