"""Streaming plans: count windows over the arrivals of each rank, grouped as they fill up.

Rows (rank, seq, sample_id, length, n_patches) may come out of order: state keeps them until those before have come. A
seq that has already been taken fails the query, or is left out with late="skip". A row with sample_id null marks the
end of its rank: what is left makes a short window. Micro-batches don't move window boundaries.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paceline.operators.planner import cut_groups
from paceline.operators.windows import ramp
from paceline.sources.samples import document_samples
from paceline.sources.workdir import scratch, stored

#: Rows of a file of arrivals, and files at least.
FILE_ROWS, FILES = 50_000, 6

OUT = "rank int, round long, group_idx long, size long, tokens long, sample_ids array<long>"


def plan_stream(rows: DataFrame, window: int, budget: int, max_patches: int = 0, warmup: bool = False, late: str = "fail") -> DataFrame:
    """Groups of every full window of a streaming DataFrame, each emitted once."""
    sizes = ramp(window, warmup)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, round_, wait, ready = state.get if state.exists else (0, 0, "{}", "[]")
        waiting, buffer, out = {int(k): v for k, v in json.loads(wait).items()}, json.loads(ready), []
        for frame in frames:
            for seq, sid, length, patches in frame[["seq", "sample_id", "length", "n_patches"]].itertuples(index=False):
                if seq < due or seq in waiting:
                    if late == "fail":
                        raise ValueError(f"rank {key[0]}: seq {seq} has already come")
                    continue
                waiting[int(seq)] = None if pd.isna(sid) else [int(length), int(sid), int(patches)]

        def close() -> None:
            nonlocal buffer, round_
            groups = cut_groups(sorted((tuple(x) for x in buffer if x[0] > 0), key=lambda x: x[0]), budget, max_patches)
            out.extend((key[0], round_, i, len(g), sum(x[0] for x in g), [x[1] for x in g]) for i, g in enumerate(groups))
            buffer, round_ = [], round_ + 1

        while due in waiting:
            row = waiting.pop(due)
            due += 1
            if row is not None:
                buffer.append(row)
            if buffer and (row is None or len(buffer) >= (sizes[round_] if round_ < len(sizes) else window)):
                close()
        state.update((due, round_, json.dumps(waiting), json.dumps(buffer)))
        yield pd.DataFrame(out, columns=["rank", "round", "group_idx", "size", "tokens", "sample_ids"])

    return rows.groupBy("rank").applyInPandasWithState(step, OUT, "due long, round long, waiting string, buffer string", "append", GroupStateTimeout.NoTimeout)


def plan_documents(spark: SparkSession, sf_dir: str, world: int, window: int, budget: int) -> DataFrame:
    """The documents as a stream of files, planned to the end: (rank, round, group_idx, size, tokens)."""
    s = document_samples(spark, sf_dir, world).withColumnRenamed("arrival_idx", "seq").drop("round")
    ends = s.groupBy("rank").agg((F.max("seq") + 1).alias("seq")).select(F.lit(None).cast("long").alias("sample_id"), "rank", "seq", F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("n_patches"))
    base = scratch(spark)
    s.unionByName(ends).repartition(6).write.parquet(f"{base}/in")
    rows = spark.readStream.schema("sample_id long, rank int, seq long, length long, n_patches long").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    plan = plan_stream(rows, window, budget)
    run = plan.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out").drop("sample_ids")


def plan_uneven(spark: SparkSession, sf_dir: str, samples: DataFrame, config) -> DataFrame:
    """Canonical samples as a stream of files, planned over all ranks: (kind, rank, round, slot, step, size, total_size,
    total_tokens). A file holds a range of arrivals of all ranks, in no order, so that what waits in state is about a file
    and not a share of the job."""
    from paceline.streaming.ranks import OUT as RANKS
    from paceline.streaming.ranks import plan_ranks

    none = F.lit(None)
    s = samples.select(F.lit(0).cast("long").alias("job"), F.lit(0).cast("long").alias("epoch"), "rank", F.col("arrival_idx").cast("long").alias("seq"), "sample_id", "length", "n_patches", none.cast("string").alias("error"))
    every = spark.range(config.world_size).select(F.col("id").cast("int").alias("rank"))
    ends = every.join(s.groupBy("rank").agg((F.max("seq") + 1).alias("seq")), "rank", "left")
    ends = ends.select(F.lit(0).cast("long").alias("job"), F.lit(0).cast("long").alias("epoch"), "rank", F.coalesce("seq", F.lit(0).cast("long")).alias("seq"), none.cast("long").alias("sample_id"), none.cast("long").alias("length"), none.cast("long").alias("n_patches"), none.cast("string").alias("error"))
    base = scratch(spark)
    every = stored(s.unionByName(ends))
    every.repartitionByRange(max(FILES, -(-every.count() // FILE_ROWS)), "seq").write.parquet(f"{base}/in")
    rows = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    run = plan_ranks(rows, config).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(RANKS).parquet(f"{base}/out").select("kind", "rank", "round", "slot", "step", "size", "total_size", "total_tokens")
