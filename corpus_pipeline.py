"""The corpus pipeline: quality rules, exact and near duplicates, secrets, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, exact_dedup, minmax_dedup, packing, quality, secret_scan
from pathloom.llm.queries import FERTILITY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's fertility bands, all columns as they were. Null and short texts go; rows that repeat are
    judged each; an empty table gives an empty result."""
    judged = quality.quality(docs, tuple(map(public_tokenizers.path, FERTILITY)), carry=tuple(docs.columns))
    return judged.where("kept").select("carried.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; null and empty texts are one group. An empty table gives an empty
    result."""
    return exact_dedup.survivors(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of five-word shingle sets with a similarity of 0.8 or more connect. Documents
    without words have no links and stay, as do rows that repeat an id which stays. An empty table gives an empty result."""
    (key,) = common.free_names(docs, "key")
    stays = minmax_dedup.near_duplicates(docs, k=5, percent=80).where("kept").select(common.order_key("doc_id").alias(key)).distinct()
    left = docs.withColumn(key, common.order_key("doc_id")).join(stays.hint("shuffle_hash"), key, "left_semi")
    return left.select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars as it is then; a null text stays null."""
    clean = secret_scan.redact(docs, common.new_path(spark, "ledger"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 4096 tokens; a text without tokens is one piece, the end alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", sequences),
]

#: Tokens, shingle links and packing are beyond SQL; tests/llm/test_plain_versions.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that are left of the documents table, each stage written as Parquet and read again; tables of a stage go when the next one has its
    input. An empty table gives an empty result."""
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.mark()
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.clear(spark, begin, docs)
        common.release(spark)
    return docs
