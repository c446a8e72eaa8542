"""Slots, padding, step records and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = -4201


def slot_emission(groups: DataFrame, slots: DataFrame, pos: str = "group_idx") -> DataFrame:
    """One row for each slot of (round, rank): its group by position, or idle. slots: (round, rank, slots)."""
    every = slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")
    return every.join(groups.withColumnRenamed(pos, "slot"), ["round", "rank", "slot"], "left").withColumn("is_idle", F.col("size").isNull())


def pad(members: DataFrame, tokens: str, by: tuple[str, ...]) -> DataFrame:
    """members with `tokens` padded by zeros to the longest of their group, and a mask."""
    longest = members.groupBy(*by).agg(F.max(F.size(tokens)).alias("padded_len"))
    d = members.join(longest, list(by))
    d = d.withColumn("mask", F.transform(F.sequence(F.lit(1), F.col("padded_len")), lambda i: i <= F.size(tokens)))
    return d.withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(0).cast("long"), F.col("padded_len") - F.size(tokens))))


def padding(groups: DataFrame) -> DataFrame:
    """Real and padded tokens over groups (size, tokens, max_len), and the share that is padding."""
    return groups.agg(F.sum("tokens").alias("real_tokens"), F.sum(F.col("size") * F.col("max_len")).alias("padded_tokens"), F.count(F.lit(1)).alias("steps")).withColumn("padding_ratio", F.round(1 - F.col("real_tokens") / F.greatest("padded_tokens", F.lit(1)), 6))


def write_id_log(plan: DataFrame, path: str) -> None:
    """One JSON line {step, ids} for each emitted batch, in a folder for each rank; empty batches have none."""
    d = plan.filter("status = 'emitted'").groupBy("rank", "step").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))
    d.write.mode("overwrite").partitionBy("rank").json(path)
