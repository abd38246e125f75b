"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage works on all that the one before it kept; all but the last return
the columns of documents, extra ones included, whatever their names. Null
texts count as empty, whole texts are read however long they are, and an
empty table passes through every stage as an empty one. Rows without a doc_id
are learnt from and counted nowhere, but stay as rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import cut, forget
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import take_mix
from tidemark.llm.quality import keep_quality
from tidemark.llm.sentencepieces import sample_pieces
from tidemark.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of its training fold.

    An empty text is scored like any other; rows that repeat are judged each,
    alike; without positive labels all documents stay.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more share, but in the largest doc_id of each.

    No document goes; one that loses all its lines stays with an empty text.
    """
    return dedup_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id.

    Ties of rows that repeat it go to the smallest hash of the text; texts
    without words are one group.
    """
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeats are rows of their own, what it leaves is gone.

    A null source is a source of its own, the last; ties of keys go by doc_id.
    """
    return take_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its sampled segmentations (ids included); an empty text has one empty segmentation."""
    return sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The classifier's fit can't be told in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote is deleted once the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), "pipeline")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
