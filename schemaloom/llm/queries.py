"""Queries of the text operators over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.llm import bpe, embedding_dedup, html_extract, line_dedup, lm_score, mixing, oracles, quality_rules, simhash, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the box keeps a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(spark, table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs, model, ("doc_id",)).withColumn("kept", ~F.col("toxic"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(spark, table(spark, sf_dir, "documents"), full=False).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(spark, table(spark, sf_dir, "documents"), vocabulary(), keep=("doc_id",), more=())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extracted(spark, pages, html_extract.learn(pages))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(spark, table(spark, sf_dir, "documents"))
    return mix.dealt().select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "shards", "places")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ALL = (op1_embedding_dedup, op2_toxicity, op3_quality_rules, op4_substring_dedup, op5_simhash, op6_bpe, op7_html_extraction, op8_lm_score, op9_mixing, op10_line_dedup, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
