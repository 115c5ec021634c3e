"""Operator 8: lines that many documents share, from levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_one, map_texts, order_key, remove, written

#: What is stripped at both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, least: int) -> bytes | None:
    """The 128-bit hash of a line's key; None for keys shorter than least code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, hash) for each different key of each row."""

    def make():
        def f(_, texts):
            rows, hashes = [], []
            for i, text in enumerate(texts):
                own = {key_of(x, least) for x in (text or b"").split(b"\n")} - {None}
                rows += [i] * len(own)
                hashes += own
            return [hashes], rows

        return f

    return map_texts(docs, [order_key(id_col)], text_col, make, "hash binary").withColumnRenamed("_k0", "id")


class LineRuns:
    """How many documents have each line, as runs sorted by hash: a run of level k holds what up to fanout**k batches brought.

    A run is a Parquet table in the shared folder with (hash, n), sorted within its files. When fanout runs of a level are there, they are
    merged into one of the next; so each count is rewritten once a level, and the number of runs grows with the logarithm of the batches. A
    hash that has reached enough is settled: later batches anti-join it away before their counts move.
    """

    def __init__(self, spark: SparkSession, enough: int, fanout: int = 4):
        self.spark, self.enough, self.fanout = spark, enough, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out.groupBy("hash").agg(F.sum("n").alias("n"))

    def settled(self) -> DataFrame | None:
        """Hashes found in enough documents so far, and in how many at least: a settled one isn't counted any more."""
        return self.merged(self.runs()).where(F.col("n") >= self.enough) if self.levels else None

    def add(self, batch: DataFrame) -> None:
        """A batch of (hash), one row for each document that has it."""
        known = self.settled()
        counts = batch.groupBy("hash").agg(F.count("*").alias("n"))
        if known is not None:
            counts = counts.join(known.select("hash"), "hash", "left_anti")
        self.put(0, counts)

    def put(self, level: int, counts: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(written(counts.sortWithinPartitions("hash"), f"lines-{level}"))
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.put(level + 1, self.merged(old))
            remove(*old)


def shared_lines(docs: DataFrame, id_col: str, text_col: str, documents: int, least: int, batches: int) -> tuple[DataFrame, LineRuns, DataFrame]:
    """The (id, hash) table, the runs, and the hashes found in so many documents. The rows come in batches by document,
    each a folder of the table, so a batch reads its own rows alone. Null and empty texts have no rows, nor have empty tables; a null id is one document."""
    spark = docs.sparkSession
    table = written(line_hashes(docs, id_col, text_col, least).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))).distinct(), "line-hashes", "batch")
    runs = LineRuns(spark, documents)
    for b in range(batches):
        runs.add(table.where(F.col("batch") == b).select("hash"))
    frequent = runs.settled()
    return table, runs, frequent


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 10, least: int = 1, batches: int = 4, texts: bool = False) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_sha256, and with texts the text that is left. Lines whose key is found in
    documents documents or more are dropped everywhere.

    Null and empty texts are one empty line, which has no key. Rows that repeat an id are one document as to the count, and each row loses its
    lines. A null id is a document of its own. Other columns are not read.
    """
    table, _, frequent = shared_lines(docs, id_col, text_col, documents, least, batches)
    # a line that a third of all documents have is known to each task, so its rows are not dealt to one of them
    hit = join_one(table.select("id", "hash"), frequent, ["hash"], "n", table.count()).groupBy("id").agg(F.collect_set("hash").alias("drop"))
    joined = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"), order_key(id_col).alias("id")).join(hit.hint("shuffle_hash"), "id", "left")
    schema = "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts

    def make():
        def f(heads, block):
            columns = [[] for _ in range(3 + texts)]
            for text, drop in zip(block, heads[1].to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                drop = set(drop or ())
                kept = [x for x in lines if key_of(x, least) not in drop] if drop else lines
                left = b"\n".join(kept)
                for c, x in zip(columns, (len(lines), len(lines) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")), strict=False):
                    c.append(x)
            return columns, None

        return f

    return map_texts(joined, [F.col("own"), F.col("drop")], "text", make, schema).drop("_k1").withColumnRenamed("_k0", id_col)
