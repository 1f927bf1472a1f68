"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.  Between stages the rows are
written as Parquet to the shared folder and read again.

An empty table stays empty through all stages.  Columns beyond those of documents pass
through the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import jaccard_join, langid, mixing, packing, secrets
from lodestar.llm.scratch import Scratch

#: Languages, automata and token ids are not SQL's to express: tested against plain Python instead.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear.

    Learned from all documents with text and lang.  Null texts, texts without a letter
    and narrow choices go; equal texts are judged alike; null ids and sources stay.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without words and null ids are no copies of anything and stay; rows with one id
    stay or go together.
    """
    return jaccard_join.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars counted again.

    Formats are learned from the documents of this stage.  Null texts stay null, empty
    ones empty; equal texts are cleaned alike.
    """
    return secrets.redact(docs, secrets.fit(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights ask for, in training order.

    Documents without words are never taken.  A null source is one of its own, the last
    by weight; ties in order go by a hash of the id, then the id; repeated rows are taken
    one by one.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences.

    A document that stands several times is packed as often; null ids are packed like any
    other.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
