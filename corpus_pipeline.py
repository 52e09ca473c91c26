"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's docs.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8).
3. repeated_text: strings of 100 bytes that also start earlier in the corpus are cut from the texts.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left is packed into sequences of 2048 tokens; returns their pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, minhash, packing, suffix_dedup, toxicity
from strandlake.llm._common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the classifier learns from the rows that op8 learns from, so that held-out rows measure this stage too
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_text", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained weights, sorted suffixes and alignments have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
