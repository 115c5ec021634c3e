"""One thin query per operator over the whole documents table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, exact_dedup, line_dedup, lm_scoring, minmax_dedup, oracles, packing, phrase_dedup, pii_crf, quality, secret_scan

#: The vocabularies whose fertility is measured.
FERTILITY = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), tuple(map(public_tokenizers.path, FERTILITY)))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(documents(spark, sf_dir), k=2)


def op4_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.phrase_dedup(documents(spark, sf_dir))


def digest_spans(spans, kind: str = "kind"):
    """kind:start:end joined by commas, in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[kind], s["start"], s["end"])), ",")


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = documents(spark, sf_dir), common.new_path(spark, "ledger")
    secret_scan.update_ledger(docs, ledger)
    # the second run asks the ledger, scans nothing and joins findings back
    found = secret_scan.secret_scan(docs, ledger)
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest_spans(base), 256).alias("base_sha256"), digest_spans(F.col("found")).alias("spans"))


def op6_shape_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.personal_data(documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(digest_spans(base), 256).alias("base_sha256"), digest_spans(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_found"))


def op7_digest_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_window_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.pseudo_likelihood(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_minmax_dedup": oracles.OP3_SQL, "op4_prefix_free_parse": oracles.OP4_SQL, "op5_blob_ledger": oracles.op5_sql(), "op7_digest_run_merge": oracles.OP7_SQL, "op8_line_runs": oracles.OP8_SQL}
