"""Shared pieces: shared-folder tables, and block-wise Arrow maps over documents."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables go when the session names no shared folder (tests, single machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/pathloom"
#: Text bytes that a map function is given at a time; a longer text comes alone.
BLOCK_BYTES = 4 << 20
#: The order key of a row whose id is null: before all others.
NULL_KEY = -(2**63)
#: A key is heavy if more than one row in HEAVY has it; so fewer than HEAVY keys are.
HEAVY = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder; a default is set only where there is neither, and only where driver and
    executors are one process: a cluster has no other place that all executors see, and this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not had.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = had.get() if had.isDefined() else LOCAL_CHECKPOINTS
        if not had.isDefined():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/pathloom/{what}-{uuid.uuid4().hex}"


#: Tables written by this process that are still there, in order.
_WRITTEN: list[str] = []
#: Lets Spark drop an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of the columns in by: lineage ends there, and lost executors cost nothing
    already written. The shuffle files that made it go at once, as nobody reads them again."""
    spark = df.sparkSession
    path, had = new_path(spark, what), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, had)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            # with a folder for each value, the files lie deeper
            folder = "/".join([x for x in file.rsplit("/", 1)[0].split("/") if "=" not in x])
            _delete(df.sparkSession, folder)
            _WRITTEN[:] = [p for p in _WRITTEN if p.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def mark() -> int:
    """A moment, for clear()."""
    return len(_WRITTEN)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since then, but for one. Operators return plans that read their tables, so these stay until the caller, who knows when
    the results have been used, clears them."""
    kept = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()[:1]} if keep is not None else set()
    for path in _WRITTEN[since:]:
        if path.rsplit("/", 1)[1] not in kept:
            _delete(spark, path)
    _WRITTEN[since:] = [p for p in _WRITTEN[since:] if p.rsplit("/", 1)[1] in kept]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order_key(id_col: str) -> Column:
    """An integer id as a join and order key without nulls; ids that are no integers raise."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY))


def join_one(rows: DataFrame, one: DataFrame, key: list[str], times: str, total: int) -> DataFrame:
    """rows joined on key with one, which has one row a key and no other names of rows. times is a column of one: how many rows have the key, or fewer;
    total is the number of all rows.

    Heavy keys, of which there are fewer than HEAVY at any size, go to every task, and their rows stay where they are: no task gets all rows of a key
    that very many have. The others are dealt out by key."""
    own = [c for c in one.columns if c not in key]
    heavy = F.col(times) * HEAVY > total
    marked = rows.join(F.broadcast(one.where(heavy)), key, "left")
    light = marked.where(F.col(times).isNull()).drop(*own).join(one.where(~heavy), key)
    return marked.where(F.col(times).isNotNull()).unionByName(light)


_HELD: dict[tuple, object] = {}


def held(key: tuple, load: Callable[[], object]) -> object:
    """What this worker remembers under a key. It outlives the task, until an operator asks for something else: workers run the tasks of all
    stages, and only one operator's memory is kept at a time."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = load()
    return _HELD[key]


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that the texts of a block hold BLOCK_BYTES or are a single one."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text_at)).to_pylist()
        start, total = 0, 0
        for k, n in enumerate(sizes):
            n = n or 0
            if k > start and total + n > BLOCK_BYTES:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(docs: DataFrame, keys: list[Column], text_col: str, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of schema from blocks of (keys..., text as bytes).

    make() runs once per task and gives f(key_arrays, texts) -> (columns, rows): texts is a list of bytes or None, columns the
    result's own columns after the keys, and rows the input row of each result row (None: one result per row, in order).
    """
    inner = docs.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text_col).cast("string").cast("binary").alias("_text"))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's objects have no cycles; visiting all that a worker remembers again and again would cost a fifth of its time
        gc.disable()
        try:
            f = make()
            for block in blocks(batches, n):
                heads = [block.column(i) for i in range(n)]
                columns, rows = f(heads, block.column(n).to_pylist())
                if rows is not None:
                    at = pa.array(rows, pa.int64())
                    heads = [h.take(at) for h in heads]
                own = [pa.array(c, type=t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, fields[n:], strict=True)]
                yield pa.RecordBatch.from_arrays(heads + own, names=names)
        finally:
            # the worker is used again, and what a task's functions leave behind does have cycles
            gc.enable()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    own = _parse_datatype_string(schema)
    full = StructType(inner.schema.fields[:n] + own.fields)
    fields = list(to_arrow_schema(full))
    names = [x.name for x in fields]
    return inner.mapInArrow(run, full)
