"""Cross-rank alignment of the groups of one round, as set operations over all ranks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def targets(groups: DataFrame, slots: DataFrame) -> DataFrame:
    """(round, rank, n_groups, slots, target): target groups of each round, over the ranks that have any.

    groups: one row for each group; slots: (round, rank, slots).
    """
    own = groups.groupBy("round", "rank").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n"))
    d = slots.join(own, ["round", "rank"], "left").withColumns({"n_groups": F.coalesce("n_groups", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    w = Window.partitionBy("round")
    active = F.col("n_groups") > 0
    most = F.max(F.when(active, F.col("n_groups"))).over(w)
    by_slots = F.coalesce(F.min(F.when(active & (F.col("slots") > 0), F.col("slots"))).over(w), most)
    by_n = F.coalesce(F.min(F.when(active & (F.col("n") > 0), F.col("n"))).over(w), most)
    return d.withColumn("target", F.greatest(F.least(most, by_slots, by_n), F.lit(1))).select("round", "rank", "n_groups", "slots", "target")


def aligned(members: DataFrame, target: DataFrame) -> DataFrame:
    """members with aligned_idx (null: recycled), exactly `target` groups for each rank.

    Too few groups: the longest samples that are not first in their group become groups of one, in order of length.
    Too many: the groups with most samples stay, ties by index.
    """
    d = members.drop("n_groups").join(target, ["round", "rank"])
    in_group = Window.partitionBy("round", "rank", "group_idx")
    d = d.withColumns({"first": F.row_number().over(in_group.orderBy("pos")) == 1, "size": F.count(F.lit(1)).over(in_group)})
    rank_ = Window.partitionBy("round", "rank")
    peel = F.sum(F.when(F.col("first"), 0).otherwise(1)).over(rank_.orderBy(F.desc("pos")))
    d = d.withColumn("alone", ~F.col("first") & (peel <= F.col("target") - F.col("n_groups")))
    place = F.dense_rank().over(rank_.orderBy(F.desc("size"), "group_idx"))
    d = d.withColumn("kept", place <= F.col("target"))
    begins = F.when(F.col("kept") & (F.col("first") | F.col("alone")), 1).otherwise(0)
    # an alone sample opens a group; what follows it in its old group is alone too, as samples are peeled from the end
    idx = F.sum(begins).over(rank_.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return d.withColumn("aligned_idx", F.when(F.col("kept"), idx)).drop("first", "alone", "kept", "size")


def aligned_groups(members: DataFrame) -> DataFrame:
    """(round, rank, aligned_idx, size, tokens) of the groups that stay."""
    return members.filter("aligned_idx is not null").groupBy("round", "rank", "aligned_idx").agg(F.count(F.lit(1)).alias("size"), F.sum("length").alias("tokens"), F.max("target").alias("target"))


def flipped(groups: DataFrame, flips: DataFrame) -> DataFrame:
    """groups with emit_pos: the aligned order, reversed where the rank flips. A round and rank without a flip fails."""
    d = groups.join(flips, ["round", "rank"], "left")
    missing = F.raise_error(F.concat(F.lit("no flip for round "), F.col("round"), F.lit(", rank "), F.col("rank"))).cast("boolean")
    return d.withColumn("emit_pos", F.when(F.coalesce("flip", missing), F.col("target") - 1 - F.col("aligned_idx")).otherwise(F.col("aligned_idx"))).drop("flip")


def totals(groups: DataFrame) -> DataFrame:
    """groups with the sums over ranks at each emitted position: total_size and total_tokens."""
    w = Window.partitionBy("round", "emit_pos")
    return groups.withColumns({"total_size": F.sum("size").over(w), "total_tokens": F.sum("tokens").over(w)})


def approximate_tokens(groups: DataFrame, before: DataFrame, target: DataFrame) -> DataFrame:
    """groups with approx_tokens: where any rank of the round was changed, the aligned size times the mean length of
    the group that had this position before, cut to a whole number; else the true tokens."""
    changed = target.filter("n_groups > 0").groupBy("round").agg(F.max(F.when(F.col("n_groups") != F.col("target"), 1).otherwise(0)).alias("changed"))
    d = groups.join(target.select("round", "rank", "n_groups"), ["round", "rank"]).join(changed, "round")
    d = d.withColumn("group_idx", F.least("aligned_idx", F.col("n_groups") - 1))
    old = before.select("round", "rank", "group_idx", F.col("size").alias("s0"), F.col("tokens").alias("t0"))
    d = d.join(old, ["round", "rank", "group_idx"])
    guess = F.floor(F.col("size") * (F.col("t0").cast("double") / F.col("s0")))
    return d.withColumn("approx_tokens", F.when(F.col("changed") == 1, guess).otherwise(F.col("tokens")).cast("long")).drop("s0", "t0", "changed", "n_groups", "group_idx")


def finish_state(info: DataFrame) -> DataFrame:
    """info (round, rank, slots, n_groups; -1: finished): whether the round ends all, and whether it emits nothing, with
    ranks drained (join) or not."""
    done = F.col("n_groups") == -1
    rest = F.min(F.when(~done, F.col("slots")))
    return info.groupBy("round").agg(
        F.bool_and(done).alias("finished_join"), F.bool_or(done).alias("finished_closure"),
        F.coalesce(rest == 0, F.lit(False)).alias("skip_join"), (~F.bool_or(done) & (F.min("slots") == 0)).alias("skip_closure"))
