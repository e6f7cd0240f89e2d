"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and
read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martflow.llm import decision_list, decontam, line_dedup, ngram_join, packing
from martflow.llm.common import Layers, table
from martflow.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return decision_list.keep_good(docs, decision_list.fit(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source taken out; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.packed(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_duplicates),
          ("decontamination", decontamination), ("packing", packing_stage)]

#: Learned rules and a tokenizer are outside SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = Layers(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = layers.write(stage(spark, docs, sf_dir))
    return docs
