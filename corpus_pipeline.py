"""A training corpus from `documents`: toxic texts go, repeated lines go, near-copies go, sources are mixed, texts become ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import bpe, line_dedup, mixing, simhash, toxicity
from schemaloom.llm.queries import table, vocabulary
from schemaloom.llm.work import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it is trained on labelled ones among docs."""
    return toxicity.keep_clean(spark, docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays. Every document stays, if need be with an empty text."""
    out = line_dedup.dedup(spark, docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in four fifths of their five-word shingles the first stays."""
    return simhash.keep_one(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return mixing.mixed(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of ids and of the text that they decode to."""
    return bpe.encoded(spark, docs, vocabulary(), keep=("doc_id", "lang", "source"), more=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained models, hashed lots and tokenizers are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written to the shared folder and read again."""
    tables, docs = Tables(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Tables.passing():  # a stage's work tables go when its result is written, and so does its input
            out = tables.cut(stage(spark, docs, sf_dir))
        tables.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
