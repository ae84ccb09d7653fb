"""The training-data pipeline: documents to packed sequences, five stages of ``fleetspark.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept.  The first four return rows with the columns of ``documents``; the last one
returns the placed pieces.  Null, empty or repeated rows and empty tables have the
results that the operators' docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import mixing, outliers, packing, simhash, suffix
from fleetspark.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no robust outlier of their language and source."""
    return outliers.kept_documents(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each SimHash class."""
    return simhash.one_of_each(docs.select(*COLUMNS), words=3, radius=2)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier; ``n_chars`` follows the text."""
    left = suffix.deduplicated(docs.select(*COLUMNS), with_text=True)
    return left.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    mixed = mixing.mix_documents(docs.select(*COLUMNS), labels, carry=["text", "lang", "n_chars"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return mixed.where("times > 0").select(*COLUMNS, copies.alias("copy")).select(*COLUMNS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each with its sequence and place."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), added=True)
    return packing.pack_pieces(pieces)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", suffix_dedup),
          ("mixing sources to target weights", source_mix), ("best-fit packing", best_fit)]

#: SQL cannot express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
