"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Each stage gets all that the one before kept, as read again from Parquet, and returns the columns of ``documents``;
the last returns the packed pieces. Null texts count as empty, and are empty from the third stage on; rows that
repeat are exact copies, of which one stays; extra columns pass through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.llm import neardup, packing, quality, suffix, toxicity
from evidencelake.llm.common import cut, labelled_sample, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier scores under 0.5."""
    weights = quality.train(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality.SAMPLE_ROWS))
    return quality.accepted(docs, weights)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of a score of 0.7 or more."""
    lexicon = toxicity.learn(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.SAMPLE_ROWS))
    return toxicity.accepted(docs, lexicon)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the first document of each group."""
    return neardup.distinct_documents(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of texts, at whole characters; documents stay, if need be with an empty text."""
    return suffix.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    with open(WORDS, encoding="utf-8") as file:
        return packing.pack(cut(packing.pieces(docs, file.read())))


STAGES = [
    ("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_dedup", suffix_stage), ("best_fit_packing", packing_stage),
]
#: Classifiers, similarity groups and packing are not SQL's; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs.select(*(F.col(c) for c in docs.columns))
