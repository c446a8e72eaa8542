"""A plan that is read by place: a table ranged and sorted by (rank, step), and a small index of the steps in its files.

A rank opens the table at any step: the index says which files hold steps from there on, and they are read one after the
other while the caller goes on. Nothing is sorted again, and files behind the caller or far ahead are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from paceline.sources.workdir import stored

#: Steps of a file, on average; what a reader holds at once.
PER_FILE = 50_000


def place(batches: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Write batches (rank, step, ...) to a new folder. Rows of one (rank, step) stay together; an empty table is one that
    no rank finds a step in."""
    spark, batches = batches.sparkSession, stored(batches)
    parts = max(1, -(-batches.count() // per_file))
    batches.repartitionByRange(parts, "rank", "step").sortWithinPartitions("rank", "step").write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.schema(batches.schema).parquet(f"{path}/rows")
    index = rows.groupBy("rank", F.col("_metadata.file_name").alias("file")).agg(F.min("step").alias("first"), F.max("step").alias("last"), F.count(F.lit(1)).alias("n"))
    index.write.parquet(f"{path}/index")


def index_from(spark: SparkSession, path: str, rank: int, step: int = 0) -> list[Row]:
    """The files that hold steps of a rank from `step` on, in order. One row a file of this rank."""
    index = spark.read.parquet(f"{path}/index")
    return index.filter((F.col("rank") == rank) & (F.col("last") >= step)).orderBy("first").collect()


def _of(spark: SparkSession, path: str, files: list[Row], rank: int, step: int) -> DataFrame:
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*(f"{path}/rows/{f['file']}" for f in files)) if files else spark.createDataFrame([], schema)
    return rows.filter((F.col("rank") == rank) & (F.col("step") >= step))


def rows_from(spark: SparkSession, path: str, rank: int, step: int = 0) -> DataFrame:
    """The batches of a rank from a step on, as a table of the files that the index names."""
    return _of(spark, path, index_from(spark, path, rank, step), rank, step)


def open_at(spark: SparkSession, path: str, rank: int, step: int = 0) -> Iterator[Row]:
    """The batches of a rank from a step on, in order; the caller holds one file's at a time."""
    for f in index_from(spark, path, rank, step):
        # a file is in order already; splits of it need not come in order
        yield from _of(spark, path, [f], rank, step).coalesce(1).sortWithinPartitions("step").toLocalIterator()
