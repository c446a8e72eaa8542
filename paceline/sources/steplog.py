"""A sink for profiles and ids of steps that holds each step once, however often a query fails and starts again.

It is a data source of Spark's Python API, for tables and for streams. A task writes one file for each rank it meets and
names them in its commit message; files get their final names when they are whole. Only when all tasks are done does the
driver write one small manifest with the names, by one rename: `commits/<run>.json` for a table, `commits/<stream>-<batch>.json`
for a batch of a stream. What no manifest names was never written, as far as `read_steps` is concerned. A run or batch that
comes again (its driver died between the manifest and Spark's own checkpoint) finds its manifest and drops its new files.

Rows need a column `rank` (null is a rank of its own); the other columns are free. Empty tables leave an empty manifest.
The path must be a folder that all executors share, as a URI that pyarrow can open (file, hdfs, s3).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "paceline_steps"
#: Files that a task holds open at once; a rank that comes back later gets another file.
OPEN = 64


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Files:
    """The files of one attempt of a task."""

    def __init__(self, path: str, schema: pa.Schema):
        self.fs, self.root = _opened(path)
        self.fs.create_dir(f"{self.root}/data", recursive=True)
        self.schema, self.open, self.done = schema, {}, []

    def close(self, rank: int | None) -> None:
        name, out = self.open.pop(rank)
        out.close()
        self.fs.move(f"{self.root}/data/_{name}", f"{self.root}/data/{name}")
        self.done.append(name)

    def write(self, rank: int | None, rows: pa.Table) -> None:
        if rank not in self.open:
            if len(self.open) >= OPEN:
                self.close(next(iter(self.open)))
            name = f"rank{'none' if rank is None else rank}-{uuid.uuid4().hex}.parquet"
            self.open[rank] = name, pq.ParquetWriter(f"{self.root}/data/_{name}", self.schema, filesystem=self.fs, compression="zstd")
        self.open[rank][1].write_table(rows)


def _write(path: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Written:
    files = _Files(path, schema)
    for batch in batches:
        rows = pa.Table.from_batches([batch]).cast(schema)
        for rank in pc.unique(rows["rank"]).to_pylist():
            files.write(rank, rows.filter(pc.is_null(rows["rank"]) if rank is None else pc.fill_null(pc.equal(rows["rank"], rank), False)))
    for rank in list(files.open):
        files.close(rank)
    return Written(files.done)


def _drop(path: str, messages: list) -> None:
    f, root = _opened(path)
    for name in (n for m in messages if m is not None for n in m.files):
        f.delete_file(f"{root}/data/{name}")


def _commit(path: str, name: str, messages: list) -> None:
    f, root = _opened(path)
    f.create_dir(f"{root}/commits", recursive=True)
    final = f"{root}/commits/{name}.json"
    if f.get_file_info(final).type != fs.FileType.NotFound:
        _drop(path, messages)
        return
    part = f"{root}/commits/_{uuid.uuid4().hex}"
    with f.open_output_stream(part) as out:
        out.write(json.dumps({"run": name, "files": sorted(n for m in messages for n in m.files)}).encode())
    f.move(part, final)


class _Table(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.run, self.schema = options["path"], options.get("run") or uuid.uuid4().hex, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, self.schema, iterator)

    def commit(self, messages: list) -> None:
        _commit(self.path, self.run, messages)

    def abort(self, messages: list) -> None:
        _drop(self.path, messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: pa.Schema):
        self.path, self.run, self.schema = options["path"], options.get("run", "stream"), schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, self.schema, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        _commit(self.path, f"{self.run}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _drop(self.path, messages)


class StepLog(DataSource):
    """Options: path, and run: the name under which a table or stream is written once."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _checked(self, schema: T.StructType, overwrite: bool) -> pa.Schema:
        if overwrite:
            raise ValueError("steps are appended; a new log takes a new path")
        if "rank" not in schema.names:
            raise ValueError("rows of steps need a column rank")
        return to_arrow_schema(schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Table:
        return _Table(self.options, self._checked(schema, overwrite))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> _Stream:  # noqa: N802
        return _Stream(self.options, self._checked(schema, overwrite))


def log_steps(rows: DataFrame, path: str, run: str | None = None, order: tuple[str, ...] = ("rank", "step")) -> None:
    """Append a table of steps. With `run` it is written once, whatever number of times this is called. Rows are ranged
    by `order`, so one rank is dealt to many tasks and a task holds few ranks."""
    rows.sparkSession.dataSource.register(StepLog)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.format(NAME).mode("append").option("path", path).option("run", run or "").save()


def stream_steps(rows: DataFrame, path: str, checkpoint: str, run: str = "stream", **trigger):
    """Start a stream that appends its steps; one run has one checkpoint."""
    rows.sparkSession.dataSource.register(StepLog)
    out = rows.writeStream.format(NAME).option("path", path).option("run", run).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def read_steps(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The committed steps. Which files count is decided by a join with the manifests, not on the driver."""
    named = spark.read.schema("files array<string>").json(f"{path}/commits").select(F.explode("files").alias("__file"))
    data = spark.read.schema(schema).parquet(f"{path}/data")
    return data.select("*", F.col("_metadata.file_name").alias("__name")).join(named, F.col("__name") == F.col("__file"), "left_semi").drop("__name")


def sweep(path: str, older: float = 86_400) -> int:
    """Delete files that no manifest names and that are older than so many seconds; how many went. Attempts that still
    run must be younger."""
    f, root = _opened(path)
    listed = lambda part: [i for i in f.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True)) if i.is_file]
    known = set()
    for i in listed("commits"):
        if not i.base_name.startswith("_"):
            with f.open_input_stream(i.path) as s:
                known |= set(json.loads(s.read())["files"])
    gone = [i.path for i in listed("data") if i.base_name not in known and i.mtime_ns / 1e9 < time.time() - older]
    for p in gone:
        f.delete_file(p)
    return len(gone)
