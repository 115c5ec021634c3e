"""Operator 5: secret scans over an incremental ledger of content-addressed blobs (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from .common import free_names, remove, written


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group has so many characters at least. Base rules come first, in the order given."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns of the base kinds, and of kinds with a form of their own.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, base=True),
    # to the end line, else over the lines of base64 that follow
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[\s\S]{0,40000}?-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\r?\n[A-Za-z0-9+/=]{16,}){0,400})", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("hosted", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-)[A-Za-z0-9_-]{20,}"),
)

#: New addresses, of 32 bytes each, that are sent to where the texts are.
FEW = 100_000
SPAN = StructType([StructField("start", IntegerType()), StructField("rank", IntegerType()), StructField("end", IntegerType()), StructField("rule", StringType())])
LEDGER = StructType([StructField("blob", BinaryType()), StructField("done", ArrayType(StringType())), StructField("found", ArrayType(SPAN))])


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's matches as array<SPAN>, in code points: what lies between the matches gives their places."""
    pattern = F.lit(rule.pattern)
    none = F.lit(None).cast(ArrayType(SPAN))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(hits, F.length).alias("n"), sizes.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(ArrayType(SPAN)).alias("out"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["gap"]
        end = begin + F.coalesce(row["n"], F.lit(0))
        own = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.key).alias("rule"))
        return F.struct(end.alias("at"), F.when(row["size"] >= rule.least, F.array_append(state["out"], own)).otherwise(state["out"]).alias("out"))

    return F.when(F.rlike(text, pattern), F.aggregate(rows, start, step, lambda s: s["out"])).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def blob_of(text_col: str) -> Column:
    """A text's address: null is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def update_ledger(docs: DataFrame, path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
    """Scan what the ledger hasn't seen, (blob, rule and version) by pair, and append one row for each blob scanned; the number of these.

    The ledger is asked with addresses alone. Where it has them all, no text is moved; else the texts of the others are. Null and empty texts are the
    empty blob, which is scanned like any other."""
    spark = docs.sparkSession
    seen = read_ledger(spark, path).select("blob", F.explode("done").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("before"))
    missing = F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("before", F.array().cast("array<string>")))
    asked = docs.select(blob_of(text_col).alias("blob")).distinct().join(seen, "blob", "left").select("blob", missing.alias("todo")).where(F.size("todo") > 0)
    asked = written(asked, "unseen")
    new = asked.count()
    if new:
        bodies = docs.select(blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
        if new <= FEW:
            bodies = bodies.join(F.broadcast(asked.select("blob")), "blob", "left_semi")
        # the texts of a blob are equal: one is taken on the map side, so copies don't move
        todo = bodies.groupBy("blob").agg(F.first("body").alias("body")).join(asked, "blob")
        found = [F.when(F.array_contains("todo", r.key), spans(F.col("body"), r, i)) for i, r in enumerate(rules)]
        empty = F.array().cast(ArrayType(SPAN))
        todo.select("blob", F.col("todo").alias("done"), F.array_sort(F.flatten(F.array(*[F.coalesce(x, empty) for x in found]))).alias("found")).write.mode("append").parquet(path)
    remove(asked)
    return new


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, found) of the blobs with findings of these rules. Two runs that have scanned a blob at the same time have left equal rows, which count once."""
    now = F.array(*[F.lit(r.key) for r in rules])
    entries = read_ledger(spark, ledger).select("blob", F.filter("found", lambda s: F.array_contains(now, s["rule"])).alias("found")).where(F.size("found") > 0)
    return entries.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


def secret_scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row, found by its blob in the ledger at that path: id, blob (sha256), found (array of start, end, kind; base is
    whether the rule is one of the base rules), in order of start and rule.

    Every version of a file is a row; equal texts are one blob and are scanned once, now or in an earlier call with the same ledger. A rule with
    a new version is scanned over all blobs again, the others aren't. Null and empty texts have no findings; an empty table gives an empty
    result. Rows that repeat get the same findings. Other columns are not read.
    """
    update_ledger(docs, ledger, text_col, rules)
    one = findings(docs.sparkSession, ledger, rules)
    bases = F.array(*[F.lit(r.key) for r in rules if r.base])
    named = F.transform(
        F.coalesce("found", F.array().cast(ArrayType(SPAN))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring_index(s["rule"], "@", 1).alias("kind"), F.array_contains(bases, s["rule"]).alias("base")),
    )
    rows = docs.select(F.col(id_col).alias("own"), blob_of(text_col).alias("blob")).join(one, "blob", "left")
    return rows.select(F.col("own").alias(id_col), "blob", named.alias("found"))


def redact(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows, all columns as they were, whatever they are called, with each found span replaced by [SECRET]; overlapping spans become one. Null
    and empty texts stay as they are, rows that repeat stay, and an empty table gives an empty result."""
    update_ledger(docs, ledger, text_col, rules)
    blob, found = free_names(docs, "blob", "found")
    one = findings(docs.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("found").alias(found))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("[SECRET]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, kept).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    joined = docs.withColumn(blob, blob_of(text_col)).join(one, blob, "left")
    return joined.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(clean)).select(docs.columns)
