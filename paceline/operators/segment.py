"""Greedy segmentation of a window into groups under a token budget.

A window sorted by length is cut from its longest sample down. The size limit of a group was set when the group
before it closed, from that group's last (shortest) sample; the first limit is 0, so the longest sample is alone.
Groups are numbered from the shortest. The fold runs in the JVM and holds one window, never more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BY = ("rank", "round")


def greedy_groups(rows: DataFrame, budget: int, max_patches: int = 0, by: tuple[str, ...] = BY, order: str = "arrival_idx") -> DataFrame:
    """rows (by, sample_id, length, n_patches, order) with length > 0: their group_idx, n_groups and place pos from 0
    by length, ties in buffer order."""
    member = F.struct("length", F.col(order).alias("ord"), "sample_id", "n_patches")
    d = rows.filter("length > 0").groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(member))).alias("m"))
    fit = f"greatest({budget} div x.length, 1)"
    if max_patches > 0:
        fit = f"if(x.n_patches > 0, least({fit}, greatest({max_patches} div x.n_patches, 1)), {fit})"
    over = f"(s.n > 0 and s.p + x.n_patches > {max_patches})" if max_patches > 0 else "false"
    n, p = f"if({over}, 0L, s.n) + 1", f"if({over}, 0L, s.p) + x.n_patches"
    closes = f"{n} >= s.size"
    fold = f"""aggregate(m,
      named_struct('starts', cast(array() as array<bigint>), 'size', 0L, 'n', 0L, 'p', 0L, 'i', 0L),
      (s, x) -> named_struct(
        'starts', if(s.n = 0 or {over}, concat(s.starts, array(s.i)), s.starts),
        'size', if({closes}, {fit}, s.size),
        'n', if({closes}, 0L, {n}),
        'p', if({closes}, 0L, {p}),
        'i', s.i + 1),
      s -> s.starts)"""
    # one generator holds the fold, which must run once for a window
    d = d.select(*by, "m", F.inline(F.array(F.struct(F.expr(fold).alias("starts")))))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("m").cast("long"))
    begin = lambda k: F.get("starts", k)
    part = lambda k: F.struct(begin(k).alias("begin"), F.slice("m", (begin(k) + 1).cast("int"), (end(k) - begin(k)).cast("int")).alias("x"))
    d = d.select(*by, F.size("starts").cast("long").alias("n_groups"), F.size("m").alias("n_in"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("starts") - 1), part)).alias("k", "g"))
    d = d.select(*by, "n_groups", "n_in", "k", "g.begin", F.posexplode("g.x").alias("j", "x"))
    pos, group = F.col("n_in") - 1 - F.col("begin") - F.col("j"), F.col("n_groups") - 1 - F.col("k")
    return d.select(*by, "x.sample_id", "x.length", "x.n_patches", F.col("x.ord").alias(order), pos.cast("long").alias("pos"), group.cast("long").alias("group_idx"), "n_groups")


def group_table(members: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """One row for each group: size, tokens, longest and shortest."""
    return members.groupBy(*by, "group_idx").agg(F.count(F.lit(1)).alias("size"), F.sum("length").alias("tokens"), F.max("length").alias("max_len"), F.min("length").alias("min_len"), F.sum("n_patches").alias("patches"))


def clamp(members: DataFrame, max_groups: int) -> DataFrame:
    """members with recycled: groups beyond the first (shortest) max_groups go back to the next window."""
    return members.withColumn("recycled", F.col("group_idx") >= max_groups)


def fixed_batches(samples: DataFrame, size: int) -> DataFrame:
    """The baseline: chunks of a fixed size in arrival order."""
    return samples.withColumn("batch_idx", F.floor(F.col("arrival_idx") / size).cast("long"))


def length_rank(rows: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Place of each row in its window by length, ties by arrival."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("length", "arrival_idx")) - 1)
