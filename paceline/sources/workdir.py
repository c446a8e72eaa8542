"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: By this setting Spark deletes the shuffle files of an execution when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only in local mode without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="paceline-"))
    return _own[0]


def scratch(spark: SparkSession) -> str:
    """A new path in that folder, which goes when the application ends."""
    path = f"{work_dir(spark)}/paceline/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a table in that folder, read again: what uses it several times computes it once, and lost executors never
    recompute what came before. The shuffle files of what is stored go at once, as nothing reads them again. The table goes
    when the application ends, as what is returned lazily may still read it."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
