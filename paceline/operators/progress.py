"""Progress over steps: running totals, budgets, accumulation and scheduler ticks.

Running sums are taken in blocks of steps, and blocks are put after each other by their sums, so that no task holds all
steps of a job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Steps of one block.
BLOCK = 1 << 16


def running_total(d: DataFrame, value: Column, into: str, order: str = "step", block: int = BLOCK) -> DataFrame:
    """d with the sum of value over the rows of the job up to each one, by `order` (a whole number)."""
    d = d.withColumns({"__block": F.floor(F.col(order) / block), "__value": value})
    sums = d.groupBy("job", "__block").agg(F.sum("__value").alias("__sum"))
    upto = Window.partitionBy("job").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0))).drop("__sum")
    within = Window.partitionBy("job", "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(sums, ["job", "__block"]).withColumn(into, F.col("__before") + F.sum("__value").over(within))
    return d.drop("__block", "__value", "__before")


def numbered(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """groups (job, round, group_idx, ...) with step: their number over the rounds of the job, from 0."""
    own = groups.groupBy("job", "round").agg(F.count(F.lit(1)).alias("__n"))
    own = running_total(own, F.col("__n"), "__upto", "round", block)
    return groups.join(own, ["job", "round"]).withColumn("step", (F.col("__upto") - F.col("__n") + F.col("group_idx")).cast("long")).drop("__n", "__upto")


def sample_budget(n: int | None, epochs: float, explicit: int | None = None, legacy: bool = False) -> int:
    """Samples to train on: as given, or the epochs times the size of the source, rounded up (legacy: down)."""
    if not explicit and n is None:
        raise ValueError("the size of the source is unknown: give the sample budget")
    out = explicit if explicit else (math.floor if legacy else math.ceil)(n * epochs)
    if out <= 0:
        raise ValueError("the sample budget must be positive")
    return out


def max_steps(desired: int, existing: int | None, policy: str = "overwrite") -> int:
    if not existing or existing <= 0 or existing == desired:
        return desired
    if policy == "error":
        raise ValueError(f"max steps {existing} is set, {desired} is asked for")
    return {"overwrite": desired, "preserve": existing}[policy]


def progress(steps: DataFrame, budget: int, epochs: float = 1.0) -> DataFrame:
    """steps (job, step, samples) with total and epoch."""
    d = running_total(steps, F.col("samples"), "total")
    return d.withColumn("epoch", F.round(F.col("total").cast("double") / budget * epochs, 6))


def until_budget(steps: DataFrame, budget: int) -> DataFrame:
    """Steps up to the one that reaches the budget."""
    d = running_total(steps, F.col("samples"), "total")
    return d.filter(F.col("total") - F.col("samples") < budget)


def optimizer_steps(steps: DataFrame, accumulation: int) -> DataFrame:
    """(job, opt_step, samples, substeps, extra_ticks, total_ticks): scheduler ticks follow samples: all but one are extra."""
    d = steps.withColumn("opt_step", F.floor(F.col("step") / accumulation).cast("long")).groupBy("job", "opt_step").agg(F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("substeps"))
    d = d.withColumn("extra_ticks", F.greatest(F.col("samples") - 1, F.lit(0)))
    return running_total(d, F.col("extra_ticks") + 1, "total_ticks", "opt_step")


def capped(optimizer_steps: DataFrame, most: int) -> DataFrame:
    """The first so many optimizer steps."""
    return optimizer_steps.filter(F.col("opt_step") < most)


def unscaled_mean(steps: DataFrame, loss: str, scale: str) -> DataFrame:
    """(job, n, mean) of the loss before scaling, over the steps whose scale is not 1."""
    some = F.when(F.col(scale) != 1, F.col(loss))
    return steps.groupBy("job").agg(F.count(some).alias("n"), F.avg(some).alias("mean"))
