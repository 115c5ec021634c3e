"""Operator 7: exact duplicates by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, join_one, lower_ascii, written

#: Rounds of the merge tree; 2**ROUNDS runs are its leaves.
ROUNDS = 4


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True) -> DataFrame:
    """(id, row, sha, n, check): the digest of each row's text and two independent checks of it; row tells equal ids apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = lower_ascii(text) if fold_case else text
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").cast("long").alias("n"), F.xxhash64("norm").alias("check")
    )


def merge_runs(rows: DataFrame, keep: str = "max", rounds: int = ROUNDS) -> DataFrame:
    """(sha, n, check, best, size): for each text the row that stays, by a binomial tree: in round k each run whose bit k is set goes to the run without
    it, which merges the two.

    A leaf run is what some tasks have read. Within a run digests are dealt over all tasks, and each task sorts and merges its share before it moves
    (Spark's sort aggregate, on both sides of the exchange), so a digest that a third of all rows share arrives as one row a task. At every level a
    run keeps, for each digest, the smallest (or largest) identifier and the number of rows. A digest counts as verified as length and a second hash
    of another family are part of the key at every level: rows that differ there never merge.
    """
    pick = F.max if keep == "max" else F.min
    level = rows.select(F.pmod(F.spark_partition_id(), F.lit(1 << rounds)).alias("run"), "sha", "n", "check", F.struct("id", "row").alias("best"), F.lit(1).cast("long").alias("size"))
    for k in range(rounds):
        level = level.withColumn("run", F.col("run").bitwiseAND(~(1 << k))).groupBy("run", "sha", "n", "check").agg(pick("best").alias("best"), F.sum("size").alias("size"))
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fold_case: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group, the empty text. Rows that repeat both id and text count as rows of their group and exactly one row of
    a group is kept. A null id sorts below every other. An empty table gives an empty result; other columns are not read.
    """
    rows = written(digest_rows(docs, id_col, text_col, fold_case), "digests")
    # the tree's last run is read twice: a text that very many rows have reaches them where they are
    best = written(merge_runs(rows, keep), "last-run")
    out = join_one(rows, best, ["sha", "n", "check"], "size", rows.count())
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fold_case: bool = True) -> DataFrame:
    """The input rows that stay, all columns as they were, whatever they are called. Rows are known by id and digest, so an id that stands for several
    texts keeps those that stay. Of rows that repeat id and text one stays. Null and empty texts are one group, a null id is below every other, and an
    empty table gives an empty result."""
    key, digest = free_names(docs, "key", "digest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(digest, F.sha2(lower_ascii(text) if fold_case else text, 256))
    kept = exact_dedup(docs, id_col, text_col, keep, fold_case).where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(f"{digest}2"))
    left = rows.join(kept.hint("shuffle_hash"), (F.col(digest) == F.col(f"{digest}2")) & F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
    return left.dropDuplicates([id_col, digest]).select(docs.columns)
