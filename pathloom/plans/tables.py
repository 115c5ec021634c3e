"""Tables between the stages of a plan, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no shared folder and driver and executors are one process.
LOCAL = "/tmp/checkpoints/pathloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's checkpoint folder. On a cluster that names neither there is no place that all
    executors see, and this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = had.get() if had.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table, so that the stages after it don't run those before it again and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pathloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
