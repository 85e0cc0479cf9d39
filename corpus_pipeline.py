"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, whatever
further ones there are and whatever their names.

Null text: no words, so the quality rules reject the row.  Null language or source: a group and a queue of their own.  Null or
repeated ids: rows are told apart by row numbers; of equal texts one row stays, and it may be one with a null id only if its group has
no other.  Texts of any length are taken whole.  Ties: the smallest id, or the first place, stays.  An empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import stored
from kmerloom.llm.decontam import decontaminate
from kmerloom.llm.packing import pack_documents
from kmerloom.llm.quality import apply_rules
from kmerloom.llm.simhash import near_dedup
from kmerloom.llm.suffix_dedup import suffix_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return apply_rules(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return near_dedup(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with later copies of repeated passages cut out of their texts; n_chars follows the text."""
    cut = suffix_dedup(docs, PASSAGE_BYTES, keep="first")
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: Bytes of a repeated passage: those of over 50 words are longer in all but very short-worded texts.
PASSAGE_BYTES = 200

STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for label, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), label.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
