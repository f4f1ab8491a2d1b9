"""The corpus pipeline: quality rules, near-duplicate removal, sanitisation, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. ``run`` applies the
stages to documents and keeps the intermediate tables beside the session's checkpoints; a stage's table goes when the next
one is written, so only the table the result is read from is left.

Every stage takes null doc_ids, texts, langs and sources, empty and very long texts, repeated rows and ids, an empty table
(the result is empty) and columns of its operators' own names; what it makes of them is said at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, mixing, pii, quality, simhash
from factloom.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the divergence from their language reject go; rows that stay are unchanged.

    A null or empty text goes (too few words), however long ones are judged whole; equal rows stay or go together; a null or
    unknown lang is compared with all languages; further columns are passed on.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, unchanged.

    It is the one of the least doc_id (null last), ties going by a digest of the text and then by the row's JSON form; rows
    with different texts are told apart though their doc_id is one; texts without a word (null ones too) are one component.
    """
    return simhash.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; no row goes.

    Null and empty texts stay as they are; equal texts become equal texts; n_chars follows the text, other columns are passed on.
    """
    return pii.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target shares: documents repeat by epochs and end at the budgets.

    A null source is a source of its own; rows without a word stay once; rows that tie on a source's cut share what is left;
    a document cut inside keeps its first words and n_chars follows.
    """
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of the mix, repeats included; a null text counts as empty."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Language statistics, fingerprints and BPE have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _drop(spark, before)
            before = path
    return docs
