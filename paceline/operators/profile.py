"""Profiles of lengths that merge: a quantile sketch and moments for each rank and round, merged upwards.

The sketches are Spark's KLL aggregates. One pass over the samples makes them; a rank, a job, or any set of rounds is
then known from sketches alone. With k = 4096 a quantile's place is wrong by less than RANK_ERROR of all rows, and a group
of fewer rows than k is exact. `exact` gives exact quantiles of any number of rows, from counts of each length: what it
shuffles grows with the different lengths. Null lengths are left out; a group without others has n = 0 and null quantiles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 4096
#: The largest error of a quantile's place that is stated for K, as a share of the rows.
RANK_ERROR = 0.002


def length_sketches(rows: DataFrame, by: tuple[str, ...] = ("rank", "round"), length: str = "length", k: int = K) -> DataFrame:
    """(by, sketch, n, total, squares, least, most)."""
    x = F.col(length).cast("long")
    square = x.cast("decimal(19,0)") * x
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_bigint(x, k).alias("sketch"), F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0)).alias("total"),
        F.coalesce(F.sum(square), F.lit(0)).cast("decimal(38,0)").alias("squares"), F.min(x).alias("least"), F.max(x).alias("most"))


def merged(sketches: DataFrame, by: tuple[str, ...] = ("rank",), k: int = K) -> DataFrame:
    """Sketches of finer groups as those of coarser ones; combined in each task before they travel."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum("squares").cast("decimal(38,0)").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))


def quantile(p: float) -> Column:
    """The least length that a share p of the rows doesn't exceed."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)))


def variation() -> Column:
    """Population deviation of lengths over their mean; null where there is none."""
    mean = F.col("total") / F.col("n")
    return F.when(F.col("total") > 0, F.sqrt(F.greatest(F.col("squares").cast("double") / F.col("n") - mean * mean, F.lit(0.0))) / mean)


def exact(rows: DataFrame, shares: dict[str, float], by: tuple[str, ...] = ("rank",), length: str = "length") -> DataFrame:
    """(by, n, total, squares, least, most) and for each name of `shares` the least length that this share of the rows
    doesn't exceed. Lengths are counted in each task before they travel; a running sum over the different lengths of a
    group places the quantiles."""
    x, k = F.col("__x"), F.col("__k")
    counts = rows.groupBy(*by, F.col(length).cast("long").alias("__x")).agg(F.count(F.col(length).cast("long")).alias("__k"))
    n = F.coalesce(F.sum("__k"), F.lit(0)).alias("n")
    sums = counts.groupBy(*by).agg(
        n, F.coalesce(F.sum(x * k), F.lit(0)).alias("total"),
        F.coalesce(F.sum(x.cast("decimal(19,0)") * x * k), F.lit(0)).cast("decimal(38,0)").alias("squares"), F.min(x).alias("least"), F.max(x).alias("most"))
    upto = counts.withColumn("__upto", F.sum(k).over(Window.partitionBy(*by).orderBy(x)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    of = upto.join(sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("n").alias("__n")), same)
    # a share is taken as the decimal that it is written as, so that a place that is whole stays so
    at = of.groupBy(*by).agg(*(F.min(F.when(F.col("__upto") >= F.lit(Decimal(str(p))) * F.col("__n"), x)).alias(name) for name, p in shares.items()))
    both = at.select(*(F.col(c).alias(f"__{c}") for c in by), *shares)
    return sums.join(both, same).select(*sums.columns, *shares)
